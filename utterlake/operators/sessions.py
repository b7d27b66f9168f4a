"""Sessions whose allowed gap depends on what they already hold."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .fold import ordered_fold


class _TwoTier:
    """A session ends after a longer gap while it is young, and after a shorter one once it is established."""

    def __init__(self, row: dict, key: str, at: str, early: int, late: int, established: int):
        self.key, self.at, self.gaps, self.established = key, at, (early, late), established
        self.id, self.number, self.n = row[key], 0, 0
        self.start = self.last = row[at]

    def push(self, row: dict) -> list[tuple]:
        out = []
        if self.n and row[self.at] - self.last > self.gaps[self.n >= self.established]:
            out = self.close()
            self.number, self.n, self.start = self.number + 1, 0, row[self.at]
        self.n, self.last = self.n + 1, row[self.at]
        return out

    def close(self) -> list[tuple]:
        return [(self.id, self.number, self.start, self.last, self.n)]


def two_tier_sessions(frames: DataFrame, key: str, at: str, tie: str, early: int, late: int, established: int) -> DataFrame:
    """Sessions of each source: session, start_us, end_us, n."""
    rows = frames.select(key, at, tie)
    return ordered_fold(rows, [key], [at, tie], lambda row: _TwoTier(row, key, at, early, late, established), f"{key} long, session long, start_us long, end_us long, n long")

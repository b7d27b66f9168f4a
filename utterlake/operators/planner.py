"""Chunk plans: where to cut a long recording, at silences where they are well placed.

Only the cuts depend on each other; they are a fold that holds the silences of one chunk at most.  What
a chunk is, given the cut before it, is a window over the cuts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .fold import ordered_fold


@dataclass(frozen=True)
class SplitConfig:
    """Seconds; the defaults are the reference parameters of offline transcription."""

    target: float = 35.0
    search: float = 5.0
    max_chunk: float = 40.0
    min_silence: float = 0.4
    fallback_silence: float = 0.2
    hard_overlap: float = 1.5
    silence_overlap: float = 0.4
    allow_hard_overlap: bool = True

    def __post_init__(self) -> None:
        broken = [f"{name} < max_chunk" for name in ("target", "hard_overlap", "silence_overlap") if getattr(self, name) >= self.max_chunk]
        if broken:
            raise ValueError("; ".join(broken))

    def overlap(self, kind: str) -> float:
        """How far the chunk after a cut of this kind reaches back."""
        wanted = {"silence": self.silence_overlap, "hard": self.hard_overlap}[kind]
        return min(max(wanted, 0.0), self.max_chunk - 1e-3) if self.allow_hard_overlap else 0.0


def ranked(silences: np.ndarray, cursor: float, duration: float, cfg: SplitConfig) -> np.ndarray:
    """Middles of the silences (rows of start, end) that a chunk from ``cursor`` can end in, best first.

    Tiers: long and within reach of the target, short and within reach, then both again up to the longest
    chunk.  Within a tier the distance to the target counts, less 0.3 of the length; then the earlier one.
    """
    target, last = cursor + cfg.target, min(duration, cursor + cfg.max_chunk)
    lo, hi = max(cursor, target - cfg.search), min(last, target + cfg.search)
    start, end = silences[:, 0], silences[:, 1]
    middle, length = (start + end) / 2, end - start
    within = lambda reach: (end > lo) & (start < reach) & (middle <= reach)
    tier = np.where(within(hi), 0, 2) + (length < cfg.min_silence)
    usable = within(last) & (middle > cursor) & (length >= cfg.fallback_silence) & (np.minimum(end, last) > np.maximum(start, lo)) & (hi > lo)
    order = np.lexsort((start, np.abs(middle - target) - 0.3 * length, tier))
    return middle[order][usable[order]]


class Cuts:
    """The cuts of one recording as its silences come in order: (place, kind), and at last the end as tail."""

    def __init__(self, duration: float, cfg: SplitConfig = SplitConfig()):
        self.duration, self.cfg, self.cursor, self.near = duration, cfg, 0.0, []

    def _cut(self) -> tuple[float, str]:
        best = ranked(np.array(self.near, float).reshape(-1, 2), self.cursor, self.duration, self.cfg)
        cut = (float(best[0]), "silence") if len(best) else (min(self.duration, self.cursor + self.cfg.max_chunk), "hard")
        self.cursor = cut[0]
        self.near = [s for s in self.near if s[1] > self.cursor]
        return cut

    def _short(self) -> bool:
        return self.duration - self.cursor <= self.cfg.max_chunk + 1e-6

    def silence(self, start: float, end: float) -> Iterator[tuple[float, str]]:
        while start >= self.cursor + self.cfg.max_chunk and not self._short():
            yield self._cut()
        self.near.append((start, end))

    def finish(self) -> Iterator[tuple[float, str]]:
        while not self._short():
            yield self._cut()
        if self.cursor < self.duration - 1e-6:
            yield self.duration, "tail"


class _Recording:
    def __init__(self, row: dict, key: str, cfg: SplitConfig):
        self.key, self.cuts, self.n = row[key], Cuts(row["duration"], cfg), 0

    def _rows(self, cuts: Iterator[tuple[float, str]]) -> Iterator[tuple]:
        for at, kind in cuts:
            yield self.key, self.n, at, kind
            self.n += 1

    def push(self, row: dict) -> Iterator[tuple]:
        return self._rows(self.cuts.silence(row["start"], row["end"])) if row["start"] is not None else iter(())

    def close(self) -> Iterator[tuple]:
        return self._rows(self.cuts.finish())


def chunks_of(cuts: DataFrame, key: str, cfg: SplitConfig) -> DataFrame:
    """Chunks between the cuts (key, chunk, at, kind): each begins before the cut before it, by that one's overlap."""
    order = W.partitionBy(key).orderBy("chunk")
    at, kind = F.lag("at").over(order), F.lag("kind").over(order)
    back = F.when(kind == "hard", cfg.overlap("hard")).otherwise(cfg.overlap("silence"))
    shown: list[Column] = [
        F.round(F.greatest(F.coalesce(at - back, F.lit(0.0)), F.lit(0.0)), 3).alias("audio_start"), F.round("at", 3).alias("audio_end"), F.col("kind"),
        F.when((back > 0) | (kind == "hard"), at).alias("drop_before"),
    ]
    return cuts.select(key, "chunk", *shown)


def chunk_plans(durations: DataFrame, silences: DataFrame, key: str, cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """Plans of all recordings: key, chunk, audio_start, audio_end, kind, drop_before.

    ``durations`` has one row per recording (key, duration); ``silences`` has key, start, end, sorted
    or not, and apart from each other.
    """
    rows = durations.select(key, F.col("duration").cast("double")).join(silences.select(key, F.col("start").cast("double"), F.col("end").cast("double")), key, "left")
    cuts = ordered_fold(rows, [key], ["start", "end"], lambda row: _Recording(row, key, cfg), f"{key} long, chunk int, at double, kind string")
    return chunks_of(cuts, key, cfg)

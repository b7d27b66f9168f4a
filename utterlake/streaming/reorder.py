"""Finals in order: a message goes out once all before it have come."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class OrderedFinals:
    """Reorder buffer: ``None`` marks a message that will not come; what is late or repeated is dropped."""

    def __init__(self, following: int = 0, held: dict[int, str | None] | None = None):
        self.following, self.held = following, held or {}

    def put(self, number: int, message: str | None) -> list[str]:
        if number >= self.following:
            self.held.setdefault(number, message)
        out = []
        while self.following in self.held:
            if (m := self.held.pop(self.following)) is not None:
                out.append(m)
            self.following += 1
        return out

    def reset(self, following: int) -> None:
        self.following, self.held = following, {}


def ordered_stream(finals: DataFrame, patience_ms: int = 60_000, forget_ms: int = 3_600_000) -> DataFrame:
    """Streaming: session_id, utt, text in order of utt per session; a null text is a tombstone.

    After ``patience_ms`` without a final of a session, one that is missing counts as lost; with none held, the
    session is forgotten after ``forget_ms`` more.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        following, held = json.loads(group.get[0]) if group.exists else [0, {}]
        buffer = OrderedFinals(following, {int(k): v for k, v in held.items()})
        out: list[tuple] = []
        if group.hasTimedOut:
            if not buffer.held:
                group.remove()
                yield pd.DataFrame(out, columns=["session_id", "utt", "text"])
                return
            lost = min(buffer.held)
            out += [(key[0], *json.loads(m)) for k in range(buffer.following, lost) for m in buffer.put(k, None)]
        for b in [] if group.hasTimedOut else batches:
            for r in b[["utt", "text"]].sort_values("utt").itertuples(index=False):
                text = None if r.text is None or r.text != r.text else json.dumps([int(r.utt), r.text])
                out += [(key[0], *json.loads(m)) for m in buffer.put(int(r.utt), text)]
        group.update((json.dumps([buffer.following, buffer.held]),))
        group.setTimeoutDuration(patience_ms if buffer.held else forget_ms)
        yield pd.DataFrame(out, columns=["session_id", "utt", "text"])

    return finals.groupBy("session_id").applyInPandasWithState(run, "session_id long, utt long, text string", "saved string", "append", GroupStateTimeout.ProcessingTimeTimeout)

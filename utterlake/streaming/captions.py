"""Decoded messages to captions in order, between micro-batches.

Finals come from decoders in any order.  A session's finals wait for those before them, are settled one after
the other against the prefix that the last one left, and take the last partial where a final has no text.
State is in rows: a final that waits is one, a partial is one, and of partials only the newest few are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.boundary import repeated
from .finals import SETTLED, WORDS, Finals
from .realtime import typed_state

#: Utterances whose partials are kept.
PARTIALS = 8
WAITING = f"kind string, reason string, text string, words {WORDS}, audio_start double, duration double, commit double, drop_before double, fresh boolean"
FIELDS = ["reason", "text", "words", "audio_start", "duration", "commit", "drop_before", "fresh"]
COLUMNS = ["session_id", "utt", "raw", "start", "end", "words", "dropped"]


def caption(prefix: str, text: str) -> str:
    """A partial as it is shown: without what the prefix already says and without the stop at its end."""
    return text[repeated(prefix, text, True) :].rstrip("。！？；!?. ")


class Captions(StatefulProcessor):
    """A session: the prefix and the next number, finals that wait, and the newest partials."""

    def __init__(self, patience_ms: int, forget_ms: int):
        self.patience, self.forget = patience_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "following long, prefix string")
        self.waiting = handle.getMapState("waiting", "utt long", WAITING)
        self.partials = handle.getMapState("partials", "utt long", "text string")

    def _put(self, row: dict, following: int) -> None:
        if row["utt"] < following:  # late or repeated
            return
        key = (int(row["utt"]),)
        if row["kind"] == "partial":
            self.partials.updateValue(key, (row["text"] or "",))
            for old in sorted(k[0] for k in self.partials.keys())[:-PARTIALS]:  # noqa: SIM118  (state, not a dictionary)
                self.partials.removeKey((old,))
        elif not self.waiting.containsKey(key):
            words = [(w["word"], float(w["start"]), float(w["end"])) for w in (row["words"] if row["words"] is not None else ())]
            real = lambda v: None if v is None or pd.isna(v) else float(v)
            self.waiting.updateValue(key, (row["kind"], row["reason"], row["text"], words, real(row["audio_start"]), real(row["duration"]), real(row["commit"]), real(row["drop_before"]), bool(row["fresh"])))

    def _take(self, session: int, following: int, prefix: str) -> tuple[int, str, list[tuple]]:
        """Settles the finals whose turn has come; one that begins after skipped silence has no prefix."""
        fold, out = Finals(session), []
        fold.prefix = prefix
        while self.waiting.containsKey((following,)):
            _, *held = self.waiting.getValue((following,))
            row = dict(zip(FIELDS, held, strict=True)) | {"utt": following}
            row["words"] = [{"word": w[0], "start": w[1], "end": w[2]} for w in row["words"] or ()]
            row["partial"] = self.partials.getValue((following,))[0] if self.partials.containsKey((following,)) else None
            if row["fresh"]:
                fold.prefix = ""
            out += fold.push(row)
            self.waiting.removeKey((following,))
            self.partials.removeKey((following,))
            following += 1
        return following, fold.prefix, out

    def _finish(self, key: tuple, following: int, prefix: str, now: int) -> pd.DataFrame:
        following, prefix, out = self._take(key[0], following, prefix)
        self.at.update((following, prefix))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        waits = next(iter(self.waiting.keys()), None) is not None
        self.handle.registerTimer(now + (self.patience if waits else self.forget))
        return pd.DataFrame(out, columns=COLUMNS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  (the interface's name)
        following, prefix = self.at.get() if self.at.exists() else (0, "")
        for batch in rows:
            for row in batch.to_dict("records"):
                self._put(row, following)
        yield self._finish(key, following, prefix, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        following, prefix = self.at.get() if self.at.exists() else (0, "")
        lost = min((k[0] for k in self.waiting.keys()), default=None)  # noqa: SIM118
        if lost is None:
            self.at.clear(), self.partials.clear()
            yield pd.DataFrame([], columns=COLUMNS)
            return
        yield self._finish(key, lost, prefix, timerValues.getCurrentProcessingTimeInMs())


def caption_stream(decoded: DataFrame, patience_ms: int = 60_000, forget_ms: int = 3_600_000) -> DataFrame:
    """Streaming: settled finals (as :func:`finals.settle`) in the order of their numbers.

    ``decoded`` has session_id, utt, kind (partial or final), reason, text, words, audio_start, duration, commit,
    drop_before, fresh.  After ``patience_ms`` without a message of a session, finals that are missing count as
    lost; with none waiting the session is forgotten after ``forget_ms``.
    """
    typed_state(decoded.sparkSession)
    return decoded.groupBy("session_id").transformWithStateInPandas(Captions(patience_ms, forget_ms), SETTLED, "Append", "ProcessingTime")

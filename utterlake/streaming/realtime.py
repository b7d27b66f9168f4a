"""The realtime fold: packets of a session to partial and final utterances.

``step`` is a pure function of state and packet, in milliseconds of stream time.  The batch query folds
it over sorted packets; the stream keeps the same state between micro-batches.  A buffer of audio always ends
with the stream, so where it starts is all that is kept of it.  A packet counts as voice by its ``speech`` flag
or, where that is null, by its loudness.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.fold import ordered_fold


@dataclass(frozen=True)
class Limits:
    """Milliseconds; the reference parameters of realtime transcription."""

    loud: float = 0.01
    onset: int = 200
    end_silence: int = 600
    early_silence: int = 1000
    committed: int = 800
    grace: int = 1200
    hangover: int = 800
    pre_roll: int = 800
    partial: int = 1500
    longest: int = 20_000
    search: int = 14_000
    cut_silence: int = 300
    overlap: int = 800
    soft_after: int = 12_000
    soft_silence: int = 500
    soft_back: int = 200

    def needed(self, speech: int) -> int:
        """Silence that ends an utterance with so much speech."""
        return self.end_silence if speech >= self.committed else self.early_silence


@dataclass
class State:
    """All that a session carries.

    ``start`` is where the open buffer begins, if there is one; ``commit`` where its own audio does; ``shown`` its
    size at the last partial.  ``waiting`` counts the grace after an end (-1: none), ``hang`` what is left of the
    hangover after a turn, ``kept`` where audio of a hangover without speech begins, as long as nothing was
    ``skipped`` since; ``ring`` where the pre-roll begins.  ``held`` says that loudness alone keeps the
    utterance open.  ``quiet`` holds the silences that a cut can still reach.
    """

    clock: int = 0
    utt: int = 0
    active: bool = False
    speech: int = 0
    silence: int = 0
    energy: int = 0
    held: bool = False
    held_silence: int = 0
    start: int | None = None
    commit: int = 0
    drop: int | None = None
    shown: int = 0
    waiting: int = -1
    hang: int = 0
    kept: int | None = None
    skipped: bool = False
    fresh: bool = False
    ring: int = 0
    quiet_from: int | None = None
    quiet: list[list[int]] = field(default_factory=list)


Message = tuple[str, int, str, int, int, int, int | None, bool]
FIELDS = ["session_id", "kind", "utt", "reason", "start_ms", "end_ms", "commit_ms", "drop_ms", "fresh"]
OUT = "kind string, utt long, reason string, start_ms long, end_ms long, commit_ms long, drop_ms long, fresh boolean"


def _message(s: State, kind: str, reason: str, end: int) -> Message:
    return kind, s.utt, reason, s.start, end, s.commit, s.drop, s.fresh


def _turn(s: State, reason: str, hangover: int | None = None) -> list[Message]:
    """Emits the whole buffer, if there is one, and begins anew: after an end of speech with a hangover, else with a fresh detector."""
    if s.start is None:
        return []
    out = [_message(s, "final", reason, s.clock)]
    if hangover is None:
        s.active, s.speech, s.silence = False, 0, 0
    else:
        s.ring = s.clock
    s.utt, s.start, s.drop, s.shown, s.waiting, s.hang, s.kept, s.fresh = s.utt + 1, None, None, 0, -1, hangover or 0, None, False
    s.energy, s.held, s.held_silence = 0, False, 0
    return out


def _cut(s: State, reason: str, at: int, begin: int, shown: int = 0) -> list[Message]:
    """Emits up to a cut and keeps the rest as the next utterance."""
    out = [_message(s, "final", reason, at)]
    s.utt, s.start, s.commit, s.drop, s.shown, s.waiting, s.kept, s.fresh = s.utt + 1, begin, at, at, shown, -1, None, False
    return out


def _around(s: State, quiet: list[int], limits: Limits) -> tuple[int, int]:
    """A cut in a silence of the buffer: its middle, and where the next utterance begins, a little before it."""
    from_ = max(s.start, quiet[0])
    return (from_ + quiet[1]) // 2, max(s.start, from_ - limits.soft_back)


def latest_silence(quiet: list[list[int]], target: int, search: int, least: int) -> list[int] | None:
    """The silence that ends last by the target, long enough and with its middle within reach; of equals the longer."""
    fits = [q for q in quiet if q[1] <= target and q[1] - q[0] >= least and (q[0] + q[1]) / 2 >= target - search]
    return min(fits, key=lambda q: (target - (q[0] + q[1]) / 2, q[0] - q[1]), default=None)


def _detect(s: State, spoken: bool, length: int, limits: Limits) -> tuple[bool, bool, int]:
    """Whether speech goes on (short silences included), has just ended, and the silence that it resumed after."""
    if spoken:
        gap, s.speech, s.silence, s.active = s.silence, (s.speech if s.active else 0) + length, 0, True
        return True, False, gap
    if not s.active:
        return False, False, 0
    s.silence += length
    if s.silence < limits.needed(s.speech):
        return True, False, 0
    s.active, s.speech, s.silence = False, 0, 0
    return False, True, 0


def _open(s: State, voice: bool, before: int, limits: Limits) -> None:
    """Begins a buffer: with the hangover itself, with the audio kept from one, or with the pre-roll."""
    if s.hang > 0 and not voice:
        s.start, s.commit, s.drop = before, before, None
    elif s.kept is not None:
        s.start, s.commit, s.drop, s.kept = s.kept, before, before, None
    else:
        s.start = min(before, max(s.ring, s.clock - limits.pre_roll))
        s.commit, s.drop = s.start, None


def step(s: State, rms: float | None, length: int, kind: str, limits: Limits = Limits(), speech: bool | None = None) -> list[Message]:
    """One packet or control message; the order of the tests is part of the meaning."""
    if kind != "audio":
        if kind == "reset":
            s.__dict__.update(State(clock=s.clock, utt=s.utt + 1, skipped=s.skipped, ring=s.clock).__dict__)
            return []
        return _turn(s, kind) if kind in ("flush", "end", "stop") else [("error", s.utt, f"unknown kind {kind}", s.clock, s.clock, s.clock, None, False)]
    before, s.clock = s.clock, s.clock + length
    loud = (rms or 0.0) >= limits.loud
    spoken = loud if speech is None else speech
    s.energy = s.energy + length if loud else 0
    voice, ended, gap = _detect(s, spoken, length, limits)
    if spoken and s.quiet_from is not None:
        s.quiet.append([s.quiet_from, before])
    s.quiet_from = None if spoken else before if s.quiet_from is None else s.quiet_from
    reach = s.clock - limits.pre_roll if s.start is None else min(s.clock, s.commit + limits.longest) - limits.search
    s.quiet = [q for q in s.quiet if q[1] >= reach]

    # after an end: speech or confirmed loudness goes on with the utterance, else the grace runs out
    resumed = s.waiting >= 0 and (voice or s.energy >= limits.onset)
    if resumed:
        s.waiting = -1
        if not voice:
            s.held, s.held_silence = True, 0
    elif s.waiting >= 0:
        s.waiting += length
        if s.clock - s.commit >= limits.longest:
            return _turn(s, "hard_cut")
        # loudness that is not confirmed yet gets a little longer
        candidate = s.energy > 0 and s.waiting < limits.grace + limits.onset
        return _turn(s, "vad_end", limits.hangover) if s.waiting >= limits.grace and not candidate else []

    by_energy = not voice and s.start is None and s.hang <= 0 and s.energy >= limits.onset
    if by_energy:
        s.held, s.held_silence = True, 0
    if not (voice or s.start is not None or s.hang > 0 or by_energy):
        s.skipped = True
        return []
    if s.skipped:
        s.skipped, s.kept, s.fresh = False, None, True
    if s.start is None:
        _open(s, voice, before, limits)
    if s.hang > 0:
        s.hang = 0 if voice else s.hang - length
        if not voice and s.hang <= 0:
            s.hang, s.kept, s.start, s.shown = 0, s.start, None, 0
            return []

    # an utterance that loudness alone holds open ends by loudness alone
    forced = False
    if s.held and not ended:
        if voice:
            s.held, s.held_silence = False, 0
        elif loud:
            s.held_silence = 0
        else:
            s.held_silence += length
            sound = s.clock - s.start - s.held_silence
            if sound > 0 and s.held_silence >= limits.needed(sound):
                forced, s.held, s.held_silence, s.energy = True, False, 0, 0

    if s.clock - s.commit >= limits.longest:
        target = min(s.clock, s.commit + limits.longest)
        runs = [*s.quiet, *([] if s.quiet_from is None else [[s.quiet_from, s.clock]])]
        inside = [[max(a, s.start), b] for a, b in runs if b > s.start]
        found = latest_silence(inside, target, limits.search, limits.cut_silence)
        out = _cut(s, "hard_cut", *_around(s, found, limits)) if found else _cut(s, "hard_cut", s.clock, max(s.start, s.clock - limits.overlap), min(limits.overlap, s.clock - s.start))
        s.ring = s.clock
        return out
    if ended or forced:
        s.waiting = 0
        return []
    if not resumed and limits.soft_silence <= gap < limits.end_silence and max(before, s.start) - s.start >= limits.soft_after:
        return _cut(s, "soft_cut", *_around(s, [before - gap, before], limits))
    if s.clock - s.start >= max(s.shown, 0) + limits.partial:
        s.shown = s.clock - s.start
        return [_message(s, "partial", "cadence", s.clock)]
    return []


class _Session:
    def __init__(self, row: dict, limits: Limits):
        self.id, self.state, self.limits = row["session_id"], State(), limits

    def push(self, row: dict) -> list[tuple]:
        return [(self.id, *m) for m in step(self.state, row["rms"], row["length_ms"], row["kind"], self.limits, row.get("speech"))]

    def close(self) -> list[tuple]:
        return [(self.id, *m) for m in _turn(self.state, "disconnect")]


def utterances(packets: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Batch: all messages of all sessions.  ``packets``: session_id, seq, kind, rms, length_ms, and speech where a detector is at hand."""
    return ordered_fold(packets, ["session_id"], ["seq"], lambda row: _Session(row, limits), f"session_id long, {OUT}")


#: Kinds after which a session says nothing more.
LAST = ("end", "stop")
#: The columns of the state between micro-batches; silences are a list of their own.
SCALARS = [f.name for f in fields(State) if f.name != "quiet"]
_KINDS = {"active": "boolean", "held": "boolean", "skipped": "boolean", "fresh": "boolean"}


class Sessions(StatefulProcessor):
    """A session between micro-batches: the fold's state, its silences, and packets that came before their turn.

    Packets wait for those before them, one row of state each; late and repeated ones are dropped, so a replayed
    batch adds nothing.  A timer gives up on lost packets, closes silent sessions and forgets ended ones.
    """

    def __init__(self, limits: Limits, patience_ms: int, forget_ms: int):
        self.limits, self.patience, self.forget = limits, patience_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        columns = ", ".join(f"{n} {_KINDS.get(n, 'long')}" for n in SCALARS)
        self.scalars = handle.getValueState("fold", f"following long, over boolean, {columns}")
        self.quiet = handle.getListState("silences", "begin long, until long")
        self.early = handle.getMapState("early", "seq long", "rms double, length_ms long, kind string, speech boolean")

    def _load(self) -> tuple[int, bool, State]:
        if not self.scalars.exists():
            return 0, False, State()
        following, over, *held = self.scalars.get()
        return following, over, State(**dict(zip(SCALARS, held, strict=True)), quiet=[[a, b] for a, b in self.quiet.get()] if self.quiet.exists() else [])

    def _save(self, following: int, over: bool, state: State, now: int) -> None:
        self.scalars.update((following, over, *(getattr(state, n) for n in SCALARS)))
        self.quiet.put([(a, b) for a, b in state.quiet]) if state.quiet else self.quiet.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(now + (self.forget if over else self.patience))

    def _take(self, following: int, state: State) -> tuple[int, bool, list[tuple]]:
        """Folds the packets whose turn has come."""
        out: list[tuple] = []
        over = False
        while self.early.containsKey((following,)):
            rms, length, kind, speech = self.early.getValue((following,))
            self.early.removeKey((following,))
            out += step(state, rms, length, kind, self.limits, speech)
            following, over = following + 1, kind in LAST
        return following, over, out

    def _shown(self, key: tuple, messages: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *m) for m in messages], columns=FIELDS).astype({"drop_ms": "Int64"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  (the interface's name)
        following, over, state = self._load()
        for batch in rows:
            speech = batch["speech"] if "speech" in batch else [None] * len(batch)
            for seq, kind, rms, length, said in zip(batch["seq"], batch["kind"], batch["rms"], batch["length_ms"], speech, strict=True):
                if seq >= following:
                    self.early.updateValue((int(seq),), (None if pd.isna(rms) else float(rms), int(length), kind, None if said is None or pd.isna(said) else bool(said)))
        at, ended, out = self._take(following, state)
        self._save(at, ended if at > following else over, state, timerValues.getCurrentProcessingTimeInMs())
        yield self._shown(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        following, over, state = self._load()
        waiting = min((k[0] for k in self.early.keys()), default=None)  # noqa: SIM118  (state, not a dictionary)
        if waiting is not None:
            following, over, out = self._take(waiting, state)
        elif over:
            self.scalars.clear(), self.quiet.clear()
            yield self._shown(key, [])
            return
        else:
            over, out = True, _turn(state, "disconnect")
        self._save(following, over, state, timerValues.getCurrentProcessingTimeInMs())
        yield self._shown(key, out)


def typed_state(spark: SparkSession) -> None:
    """State in columns, with timers, needs the store that keeps single rows of it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def utterance_stream(packets: DataFrame, limits: Limits = Limits(), patience_ms: int = 10_000, forget_ms: int = 3_600_000) -> DataFrame:
    """Streaming: the same messages as :func:`utterances`.

    After ``patience_ms`` without a packet of a session, one that is missing counts as lost and those held
    go on; with none held the open utterance is closed.  A session that has ended, or said nothing more,
    is forgotten after ``forget_ms``, so that neither packets nor sessions stay for ever.
    """
    typed_state(packets.sparkSession)
    return packets.groupBy("session_id").transformWithStateInPandas(Sessions(limits, patience_ms, forget_ms), f"session_id long, {OUT}", "Append", "ProcessingTime")

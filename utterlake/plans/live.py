"""The realtime fold over events as packets, beside the same fold as recursive SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..streaming import realtime
from .native import FRAMES, frames, query


def nested(source: str, *layers: dict[str, str]) -> str:
    """A query whose layers each add columns to what is below; a name may stand once."""
    for layer in layers:
        source = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in layer.items())} FROM {source})"
    return source


def _needed(speech: str) -> str:
    return f"CASE WHEN {speech} >= 800 THEN 600 ELSE 1000 END"


def _by(act: dict[str, str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN act IN ({', '.join(repr(a) for a in names.split())}) THEN {e}" for names, e in act.items()) + f" ELSE {other} END"


#: Milliseconds of a packet, loudness that counts in a session, and what a detector calls speech.
_LENGTH, _LEVEL = "130 * (event_id % 5 + 1)", "CASE user_id % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 20.0 ELSE 40.0 END"
_STEP = nested(
    """(SELECT r.* EXCLUDE (k, m), p.k, p.kind, p.loud, p.spoken, p.len, p.kind <> 'audio' AS ctl, r.clock AS before_, r.clock + CASE WHEN p.kind = 'audio' THEN p.len ELSE 0 END AS now
        FROM r JOIN p ON p.session_id = r.session_id AND p.k = r.k + 1)""",
    {
        "energy1": "CASE WHEN loud THEN energy + len ELSE 0 END", "voice": f"spoken OR (active AND silence + len < {_needed('speech')})", "ended": f"NOT spoken AND active AND silence + len >= {_needed('speech')}",
        "gap": "CASE WHEN spoken THEN silence ELSE 0 END", "quiet1": "CASE WHEN spoken AND quiet_from IS NOT NULL THEN list_append(quiet, {'a': quiet_from, 'b': before_}) ELSE quiet END", "quiet_from1": "CASE WHEN NOT spoken THEN coalesce(quiet_from, before_) END",
    },
    {
        "active1": "spoken OR (active AND NOT ended)", "speech1": "CASE WHEN spoken THEN CASE WHEN active THEN speech ELSE 0 END + len WHEN ended THEN 0 ELSE speech END", "silence1": "CASE WHEN NOT spoken AND active AND NOT ended THEN silence + len ELSE 0 END",
        "resumed": "waiting >= 0 AND (voice OR energy1 >= 200)",
    },
    {"held2": "held OR (resumed AND NOT voice)", "hsil2": "CASE WHEN resumed AND NOT voice THEN 0 ELSE hsil END", "wait": "NOT ctl AND waiting >= 0 AND NOT resumed", "waiting2": "CASE WHEN resumed OR waiting < 0 THEN -1 ELSE waiting + len END", "by_energy": "NOT voice AND start IS NULL AND hang <= 0 AND energy1 >= 200"},
    {
        "held3": "held2 OR by_energy", "hsil3": "CASE WHEN by_energy THEN 0 ELSE hsil2 END", "keep": "voice OR start IS NOT NULL OR hang > 0 OR by_energy",
        "kept4": "CASE WHEN NOT skipped THEN kept END", "fresh4": "fresh OR skipped", "in_hang": "hang > 0 AND NOT voice",
    },
    {"uses_kept": "start IS NULL AND NOT in_hang AND kept4 IS NOT NULL", "start4": "coalesce(start, CASE WHEN in_hang THEN before_ WHEN kept4 IS NOT NULL THEN kept4 ELSE least(before_, greatest(ring, now - 800)) END)", "discard": "in_hang AND hang - len <= 0"},
    {
        "commit4": "CASE WHEN start IS NOT NULL THEN commit_ WHEN uses_kept THEN before_ ELSE start4 END", "drp4": "CASE WHEN start IS NOT NULL THEN drp WHEN uses_kept THEN before_ END",
        "watched": "held3 AND NOT ended", "hsil6": "CASE WHEN NOT (held3 AND NOT ended) THEN hsil3 WHEN voice OR loud THEN 0 ELSE hsil3 + len END",
    },
    {"forced": f"watched AND NOT voice AND NOT loud AND now - start4 - hsil6 > 0 AND hsil6 >= {_needed('now - start4 - hsil6')}", "target": "least(now, commit4 + 20000)"},
    {
        "act": """CASE WHEN ctl THEN kind WHEN wait THEN CASE WHEN now - commit_ >= 20000 THEN 'late_cut' WHEN waiting2 >= 1200 AND NOT (energy1 > 0 AND waiting2 < 1400) THEN 'vad_end' ELSE 'grace' END
            WHEN NOT keep THEN 'skip' WHEN discard THEN 'discard' WHEN now - commit4 >= 20000 THEN 'hard_cut' WHEN ended OR forced THEN 'ended'
            WHEN NOT resumed AND gap >= 500 AND gap < 600 AND greatest(before_, start4) - start4 >= 12000 THEN 'soft_cut' WHEN now - start4 >= shown + 1500 THEN 'cadence' ELSE 'none' END""",
        "best": """list_sort(list_transform(list_filter(list_transform(CASE WHEN quiet_from1 IS NULL THEN quiet1 ELSE list_append(quiet1, {'a': quiet_from1, 'b': now}) END, lambda q: {'a': greatest(q.a, start4), 'b': q.b}),
            lambda q: q.b <= target AND q.b - q.a >= 300 AND (q.a + q.b) / 2 >= target - 14000), lambda q: {'far': target - (q.a + q.b) / 2, 'len': q.a - q.b, 'a': q.a, 'b': q.b}))[1]""",
    },
    {"from_": "CASE WHEN act = 'soft_cut' THEN greatest(start4, before_ - gap) ELSE best.a END", "to_": "CASE WHEN act = 'soft_cut' THEN before_ ELSE best.b END"},
    {"cut_at": "CASE WHEN from_ IS NULL THEN now ELSE (from_ + to_) // 2 END", "begin_": "CASE WHEN from_ IS NULL THEN greatest(start4, now - 800) ELSE greatest(start4, from_ - 200) END", "opened": "NOT ctl AND NOT wait AND keep", "turns": "(act IN ('flush', 'late_cut', 'vad_end')) AND start IS NOT NULL"},
)
#: Each state column after a packet; a flush without a buffer changes nothing.
_NEXT = {
    "k": "k", "clock": "now", "utt": "utt + CAST(turns OR act IN ('reset', 'hard_cut', 'soft_cut') AS BIGINT)",
    "active": _by({"reset": "false", "flush": "active AND NOT turns", "late_cut": "false"}, "active1"), "speech": _by({"reset late_cut": "0", "flush": "CASE WHEN turns THEN 0 ELSE speech END"}, "speech1"),
    "silence": _by({"reset late_cut": "0", "flush": "CASE WHEN turns THEN 0 ELSE silence END"}, "silence1"), "energy": _by({"reset late_cut vad_end": "0", "flush": "CASE WHEN turns THEN 0 ELSE energy END"}, "CASE WHEN opened AND act <> 'discard' AND forced THEN 0 ELSE energy1 END"),
    "held": _by({"reset late_cut vad_end": "false", "flush": "held AND NOT turns", "grace skip": "held2", "discard": "held3"}, "held3 AND NOT (watched AND (voice OR forced))"),
    "hsil": _by({"reset late_cut vad_end": "0", "flush": "CASE WHEN turns THEN 0 ELSE hsil END", "grace skip": "hsil2", "discard": "hsil3"}, "CASE WHEN forced THEN 0 ELSE hsil6 END"),
    "start": _by({"reset late_cut vad_end discard": "NULL", "flush": "NULL", "hard_cut soft_cut": "begin_", "grace skip": "start"}, "start4"),
    "commit_": _by({"reset": "0", "flush late_cut vad_end grace skip": "commit_", "hard_cut soft_cut": "cut_at"}, "commit4"),
    "drp": _by({"reset flush late_cut vad_end": "NULL", "grace skip": "drp", "hard_cut soft_cut": "cut_at"}, "drp4"),
    "shown": _by({"reset flush late_cut vad_end discard soft_cut": "0", "hard_cut": "CASE WHEN from_ IS NULL THEN least(800, now - start4) ELSE 0 END", "cadence": "now - start4"}, "shown"),
    "waiting": _by({"reset flush late_cut vad_end hard_cut soft_cut": "-1", "ended": "0"}, "waiting2"),
    "hang": _by({"reset late_cut discard": "0", "flush": "CASE WHEN turns THEN 0 ELSE hang END", "vad_end": "800", "grace skip": "hang"}, "CASE WHEN hang > 0 AND NOT voice THEN hang - len ELSE 0 END"),
    "kept": _by({"reset late_cut vad_end hard_cut soft_cut": "NULL", "flush": "CASE WHEN NOT turns THEN kept END", "discard": "start4", "grace skip": "kept"}, "CASE WHEN NOT uses_kept THEN kept4 END"),
    "skipped": _by({"skip": "true"}, "skipped AND NOT opened"), "fresh": _by({"reset late_cut vad_end hard_cut soft_cut": "false", "flush": "fresh AND NOT turns", "grace skip": "fresh"}, "fresh4"),
    "ring": _by({"reset vad_end hard_cut": "now"}, "ring"), "quiet_from": _by({"reset": "NULL", "flush": "quiet_from"}, "quiet_from1"), "quiet": _by({"reset": "[]", "flush": "quiet"}, "quiet1"),
    "m": """CASE WHEN turns THEN {'kind': 'final', 'utt': utt, 'reason': CASE act WHEN 'late_cut' THEN 'hard_cut' ELSE act END, 's': start, 'e': now, 'c': commit_, 'd': drp, 'f': fresh}
        WHEN act IN ('hard_cut', 'soft_cut') THEN {'kind': 'final', 'utt': utt, 'reason': act, 's': start4, 'e': cut_at, 'c': commit4, 'd': drp4, 'f': fresh4} WHEN act = 'cadence' THEN {'kind': 'partial', 'utt': utt, 'reason': act, 's': start4, 'e': now, 'c': commit4, 'd': drp4, 'f': fresh4} END""",
}
_TYPES = {"active": "BOOLEAN", "held": "BOOLEAN", "skipped": "BOOLEAN", "fresh": "BOOLEAN", "quiet": "STRUCT(a BIGINT, b BIGINT)[]", "m": "STRUCT(kind VARCHAR, utt BIGINT, reason VARCHAR, s BIGINT, e BIGINT, c BIGINT, d BIGINT, f BOOLEAN)"}
_FIRST = {"active": "false", "held": "false", "skipped": "false", "fresh": "false", "quiet": "[]", "m": "NULL", "start": "NULL", "drp": "NULL", "kept": "NULL", "quiet_from": "NULL", "waiting": "-1"}
UTTERANCES = f"""WITH RECURSIVE {FRAMES},
    p AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS k, CASE WHEN event_type = 'signup' AND event_id % 8 = 0 THEN 'flush' WHEN event_type = 'error' AND event_id % 40 = 0 THEN 'reset' ELSE 'audio' END AS kind,
        CAST({_LENGTH} AS BIGINT) AS len, value / ({_LEVEL})::DOUBLE / 100 >= 0.01::DOUBLE AS loud, value / ({_LEVEL})::DOUBLE / 100 >= 0.01::DOUBLE AND user_id % 4 <> 0 AND event_id % 7 <> 0 AS spoken FROM frames),
    r AS (SELECT DISTINCT session_id, {', '.join(f"CAST({_FIRST.get(n, '0')} AS {_TYPES.get(n, 'BIGINT')}) AS {n}" for n in _NEXT)} FROM p
        UNION ALL SELECT session_id, {', '.join(f"CAST({e} AS {_TYPES.get(n, 'BIGINT')})" for n, e in _NEXT.items())} FROM {_STEP})
    SELECT session_id, m.kind AS kind, m.utt AS utt, m.reason AS reason, m.s AS start_ms, m.e AS end_ms, m.c AS commit_ms, m.d AS drop_ms, m.f AS fresh FROM r WHERE m IS NOT NULL
    UNION ALL SELECT session_id, 'final', utt, 'disconnect', start, clock, commit_, drp, fresh FROM r WHERE start IS NOT NULL AND (session_id, k) IN (SELECT (session_id, max(k)) FROM p GROUP BY session_id)"""


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as the packets of a session; some sessions have no detector, so loudness alone opens and ends them."""
    seq = W.partitionBy("user_id").orderBy("us", "event_id")
    kind = F.when((F.col("event_type") == "signup") & (F.col("event_id") % 8 == 0), "flush").when((F.col("event_type") == "error") & (F.col("event_id") % 40 == 0), "reset").otherwise("audio")
    level = F.when(F.col("user_id") % 3 == 0, 5.0).when(F.col("user_id") % 3 == 1, 20.0).otherwise(40.0)
    rms = F.col("value") / level / 100
    speech = (rms >= 0.01) & (F.col("user_id") % 4 != 0) & (F.col("event_id") % 7 != 0)
    return frames(spark, sf_dir).select(F.col("user_id").alias("session_id"), (F.row_number().over(seq) - 1).cast("long").alias("seq"), kind.alias("kind"), rms.alias("rms"), (130 * (F.col("event_id") % 5 + 1)).cast("int").alias("length_ms"), speech.alias("speech"))


@query(UTTERANCES)
def realtime_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR1-3, STR5-11, STR16-17, FLT10, WIN4-6: events as packets, folded to utterances, hangovers and ends by energy included."""
    return realtime.utterances(packets(spark, sf_dir))

"""The coverage guard over recordings made of events, with a scripted decoder that fails in every way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import guard, planner
from .kernels import _RECORDINGS, plan_sql, recordings
from .native import query

#: The decoder's word of second i of a recording.
FIRST, SPAN = 0x6000, 500


def scripted(rows: DataFrame) -> DataFrame:
    """A word for each whole second of a slice, unless the script has the call fail.

    First calls fail by a hash of the slice: no text (0 and 1), words for a part of it only (2 to 4).  A second
    call fails where the hash is 0.  Rescues fail by the recording: 5 has no text in any call, 10 has
    no words in slices, 6 has no end, 7 has it in slices only, 8 and 9 repeat a second of it.
    """
    millis = lambda c: F.round(F.col(c) * 1000).cast("long")
    f, u = (F.col("user_id") * 7 + millis("start") * 13 + millis("end") * 17) % 10, F.col("user_id") % 13
    attempt = F.col("attempt")
    fails = (u == 5) | (attempt == 0) & f.isin(0, 1) | (attempt == 1) & (f == 0) | (attempt == 3) & u.isin(6, 7, 9) | (attempt == 4) & (u == 6)
    part = (attempt == 0) & f.isin(2, 3, 4)
    repeats = (attempt == 3) & (u == 8) | (attempt == 4) & (u == 9)
    reach = F.when(part, F.col("start") + 0.55 * (F.col("end") - F.col("start"))).when(repeats, F.col("start") + 1.0).otherwise(F.col("end"))
    low, high = F.ceil("start").cast("int"), F.floor(reach).cast("int") - 1
    seconds = F.when(~fails & (high >= low), F.sequence(low, high)).otherwise(F.expr("cast(array() as array<int>)"))
    word = lambda i: F.decode(F.unhex(F.lpad(F.hex(FIRST + (F.col("user_id") * 31 + i) % SPAN), 4, "0")), "UTF-16BE")
    words = F.transform(seconds, lambda i: F.struct(word(i).alias("word"), (i - F.col("start")).alias("start"), (i + 1 - F.col("start")).alias("end")))
    text = F.array_join(F.transform(words, lambda w: w["word"]), "")
    return rows.withColumn("text", text).withColumn("words", F.when((attempt == 2) & (u == 10), F.expr(guard.NO_WORDS)).otherwise(words))


def _speech_sql(name: str, spans: str) -> str:
    """Speech of spans (user_id, chunk, a, b)."""
    return f"""{name}_m AS (SELECT user_id, chunk, a, b, greatest(s, a) AS lo, least(e, b) AS hi FROM {spans} JOIN sil USING (user_id) WHERE least(e, b) > greatest(s, a)),
    {name}_g AS (SELECT *, lo - coalesce(lag(hi) OVER (PARTITION BY user_id, chunk ORDER BY lo), a) AS gap FROM {name}_m),
    {name}_c AS (SELECT user_id, chunk, sum(hi - lo ORDER BY lo) AS covered, max(gap) AS gap, max(hi) AS upto FROM {name}_g GROUP BY ALL),
    {name} AS (SELECT user_id, chunk, round(greatest(0.0, greatest(0.0, b - a) - coalesce(covered, 0.0)), 3) AS speech, CASE WHEN b > a THEN round(greatest(coalesce(gap, 0.0), b - coalesce(upto, a)), 3) ELSE 0.0 END AS longest,
        CASE WHEN b > a THEN round(greatest(0.0, b - a - coalesce(covered, 0.0)) / (b - a), 3) ELSE 0.0 END AS share FROM {spans} LEFT JOIN {name}_c USING (user_id, chunk))"""


def _decode_sql(name: str, slices: str, attempt: int) -> str:
    """Seconds that a call gives words for: of slices (user_id, chunk, a, b)."""
    f, u = "((user_id * 7 + CAST(round(a * 1000) AS BIGINT) * 13 + CAST(round(b * 1000) AS BIGINT) * 17) % 10)", "(user_id % 13)"
    fails = {0: f"{f} IN (0, 1)", 1: f"{f} = 0", 3: f"{u} IN (6, 7, 9)", 4: f"{u} = 6"}.get(attempt, "false")
    reach = {0: f"CASE WHEN {f} IN (2, 3, 4) THEN a + 0.55::DOUBLE * (b - a) ELSE b END", 3: f"CASE WHEN {u} = 8 THEN a + 1.0 ELSE b END", 4: f"CASE WHEN {u} = 9 THEN a + 1.0 ELSE b END"}.get(attempt, "b")
    return f"{name} AS (SELECT DISTINCT user_id, chunk, a, unnest(CASE WHEN {u} = 5 OR {fails} THEN [] ELSE range(CAST(ceil(a) AS BIGINT), CAST(floor({reach}) AS BIGINT)) END) AS i FROM {slices})"


_WORD = f"chr(CAST({FIRST} + (user_id * 31 + i) % {SPAN} AS INT))"
GUARDED = f"""WITH RECURSIVE {_RECORDINGS}, {plan_sql('p', 'f', 'sil', 'user_id', 35, 5, 40)},
    chunks AS (SELECT user_id, chunk, audio_start AS a, audio_end AS b, kind FROM p), {_speech_sql('st', 'chunks')},
    heard AS (SELECT * FROM chunks JOIN st USING (user_id, chunk)),
    asked AS (SELECT * FROM heard WHERE NOT (kind = 'tail' AND speech < 0.3 AND longest < 0.2)), {_decode_sql('d0', 'asked', 0)},
    loud AS (SELECT * FROM asked a WHERE speech >= 2 AND NOT EXISTS (FROM d0 WHERE d0.user_id = a.user_id AND d0.chunk = a.chunk)), {_decode_sql('d1', 'loud', 1)},
    failed AS (SELECT * FROM loud a WHERE NOT EXISTS (FROM d1 WHERE d1.user_id = a.user_id AND d1.chunk = a.chunk)),
    wide AS (SELECT user_id * 100000 + chunk AS slice, user_id, chunk, a, b, b - a AS duration FROM failed WHERE b - a > 30),
    inner_ AS (SELECT slice, greatest(0.0, s - a) AS s, least(duration, e - a) AS e FROM wide JOIN sil USING (user_id) WHERE e > a AND s < b), {plan_sql('z', 'wide', 'inner_', 'slice', 15, 5, 20)},
    parts AS (SELECT user_id, chunk, a, b FROM failed WHERE b - a <= 30 UNION ALL SELECT w.user_id, w.chunk, w.a + audio_start, w.a + audio_end FROM z JOIN wide w USING (slice)), {_decode_sql('d2', 'parts', 2)},
    covered AS (SELECT user_id, chunk, i, user_id % 13 = 10 AS bare, 2 AS w FROM d2 UNION SELECT user_id, chunk, i, false, 1 FROM d1 UNION SELECT user_id, chunk, i, false, 0 FROM d0),
    ends AS (SELECT user_id, chunk, a AS first_, a + (max(i) + 1 - a) AS a, b FROM covered JOIN asked USING (user_id, chunk) WHERE NOT bare GROUP BY user_id, chunk, a, b), {_speech_sql('tl', 'ends')},
    odd AS (SELECT user_id, chunk, greatest(first_, e.a - 1) AS a, b, e.a AS last FROM ends e JOIN tl USING (user_id, chunk) WHERE speech >= 1.5 OR speech >= 1 AND share >= 0.5), {_decode_sql('d3', 'odd', 3)},
    still AS (SELECT * FROM odd o WHERE NOT EXISTS (FROM d3 WHERE d3.user_id = o.user_id AND d3.chunk = o.chunk)), {_decode_sql('d4', 'still', 4)},
    more AS (SELECT user_id, chunk, i, 3 AS w FROM d3 UNION ALL SELECT user_id, chunk, i, 4 FROM d4),
    fresh AS (SELECT m.* FROM more m JOIN odd o USING (user_id, chunk) JOIN asked c USING (user_id, chunk) WHERE round(i - o.a + (o.a - c.a), 3) >= o.last - c.a - 0.1),
    words AS (SELECT user_id, chunk, i, bare FROM covered UNION ALL SELECT user_id, chunk, i, false FROM fresh),
    told AS (SELECT user_id, chunk, string_agg({_WORD}, '' ORDER BY i) AS text, count(*) FILTER (WHERE NOT bare) AS n_words FROM words GROUP BY ALL),
    state AS (SELECT h.user_id, h.chunk, h.kind, h.speech, coalesce(text, '') AS text, coalesce(n_words, 0) AS n_words,
        CASE WHEN q.chunk IS NULL THEN 'SKIP_TAIL_LOW_VAD' WHEN f.chunk IS NOT NULL THEN 'SUSPICIOUS_EMPTY_EOS>EMPTY_RETRY_FAILED>' || CASE WHEN v.w = 2 THEN 'RESCUED_EMPTY_SPLIT' ELSE 'EMPTY_VAD_FALSE_POSITIVE' END
            WHEN l.chunk IS NOT NULL THEN 'SUSPICIOUS_EMPTY_EOS>RESCUED_EMPTY_RETRY' WHEN v.w IS NULL THEN 'EMPTY_OK' ELSE 'ok' END
        || CASE WHEN o.chunk IS NULL THEN '' ELSE '>PREMATURE_EOS>' || CASE WHEN m.w IS NULL THEN 'TAIL_VAD_FALSE_POSITIVE' WHEN m.w = 3 THEN CASE WHEN n.w IS NULL THEN 'TAIL_RESCUE_NO_NEW_TEXT' ELSE 'RESCUED_TAIL' END ELSE CASE WHEN n.w IS NULL THEN 'TAIL_SPLIT_RESCUE_NO_NEW_TEXT' ELSE 'RESCUED_TAIL_SPLIT' END END END AS passed
        FROM heard h LEFT JOIN asked q USING (user_id, chunk) LEFT JOIN loud l USING (user_id, chunk) LEFT JOIN failed f USING (user_id, chunk) LEFT JOIN odd o USING (user_id, chunk) LEFT JOIN told t USING (user_id, chunk)
            LEFT JOIN (SELECT user_id, chunk, max(w) AS w FROM covered GROUP BY ALL) v USING (user_id, chunk) LEFT JOIN (SELECT user_id, chunk, max(w) AS w FROM more GROUP BY ALL) m USING (user_id, chunk) LEFT JOIN (SELECT user_id, chunk, max(w) AS w FROM fresh GROUP BY ALL) n USING (user_id, chunk)),
    dropped AS (SELECT *, kind = 'tail' AND regexp_matches(passed, '(TAIL_VAD_FALSE_POSITIVE|TAIL_RESCUE_NO_NEW_TEXT|TAIL_SPLIT_RESCUE_NO_NEW_TEXT)$') AND speech < 0.4 AND length(text) <= 20 AS gone FROM state)
    SELECT user_id, chunk, speech, CASE WHEN gone THEN '' ELSE text END AS text, CASE WHEN gone THEN 0 ELSE n_words END AS n_words, CASE WHEN gone THEN passed || '>TAIL_HALLUCINATION_DROP' ELSE passed END AS passed FROM dropped"""


@query(GUARDED)
def guarded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORC3, ORC4, FLT8, SCL24: chunks decoded under the coverage guard, with what it took."""
    durations, quiet = recordings(spark, sf_dir)
    found = guard.guard(planner.chunk_plans(durations, quiet, "user_id"), quiet, "user_id", scripted)
    return found.select("user_id", "chunk", "speech", "text", F.size("words").cast("long").alias("n_words"), F.array_join("passed", ">").alias("passed"))

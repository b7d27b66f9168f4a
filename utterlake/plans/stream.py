"""Queries of packets, partials and token rewrites over the given tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tokensync
from ..operators import packets as P
from ..operators.fold import sliced
from .live import UTTERANCES, realtime_utterances
from .native import FRAMES, TOKENS, frames, query, table, turns


@query("""WITH p AS (SELECT event_id, event_id * 37 % 16000 AS size, value / 1000 AS start, value / 1000 + (user_id % 7) * 0.1 AS stop, (user_id % 5) * 0.2 AS ahead, [8000, 16000, 44100, 16000][event_id % 4 + 1] AS rate FROM events),
    b AS (SELECT *, greatest(0, least(CAST(round_even(start * 16000, 0) AS BIGINT), size)) AS first FROM p)
    SELECT event_id, first, greatest(first, least(CAST(round_even(stop * 16000, 0) AS BIGINT), size)) AS last, size - least(size, greatest(0, CAST(round_even((start + ahead - start) * 16000, 0) AS BIGINT))) AS fresh,
        greatest(0.0, (event_id * 320 - 3200 - size) / 16000) AS origin, greatest(0.0, (event_id * 320 - 3200 - size) / 16000) + 3200 / 16000 AS drop_before,
        CASE WHEN rate NOT IN (8000, 16000) THEN 'UNSUPPORTED_SAMPLE_RATE' WHEN size <= 0 THEN 'EMPTY_AUDIO' END AS error FROM b""")
def packet_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ2, PRJ4, PRJ6, FLT14, STR9 (placing the overlap): sample bounds, owned samples, re-tied overlaps, and inputs that are refused."""
    size, start = (F.col("event_id") * 37 % 16000).cast("long"), F.col("value") / 1000
    first, last = P.slice_bounds(start, start + F.col("user_id") % 7 * F.lit(0.1), size, 16000)
    origin, drop = P.retied(F.lit(3200), size, F.col("event_id") * 320, 16000)
    rate = F.element_at(F.array(*map(F.lit, (8000, 16000, 44100, 16000))), (F.col("event_id") % 4 + 1).cast("int"))
    ahead = start + F.col("user_id") % 5 * F.lit(0.2)
    return table(spark, sf_dir, "events").select("event_id", first.alias("first"), last.alias("last"), P.fresh_samples(size, start, ahead, 16000).alias("fresh"), origin.alias("origin"), drop.alias("drop_before"), P.rejected(rate, size).alias("error"))


@query(f"""WITH {FRAMES}, e AS (SELECT *, sum(400) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS upto FROM frames)
    SELECT event_id, CAST(least(800, upto) AS BIGINT) AS ring, CAST(greatest(0, least(800, upto) - 400) AS BIGINT) AS unused, max(value) OVER (PARTITION BY user_id ORDER BY upto RANGE BETWEEN 800 PRECEDING AND 1 PRECEDING) AS loudest_before FROM e""")
def pre_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN6: what a ring of the last 800 ms holds besides the packet itself."""
    rows = P.pre_roll(frames(spark, sf_dir).withColumn("ms", F.lit(400)), "user_id", ["us", "event_id"], "ms", "value", 800)
    return rows.select("event_id", F.col("ring").cast("long").alias("ring"), F.col("unused").cast("long").alias("unused"), "loudest_before")


@query("""WITH e AS (SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS size FROM events), b AS (SELECT event_id, size, unnest(range(0, (size - 1) // 4000 + 1)) AS k FROM e WHERE size > 0)
    SELECT event_id, k * 4000 AS start, least((k + 1) * 4000, size) AS stop, (k + 1) * 4000 <= size AS complete FROM b""")
def partial_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN15, STR12: the blocks in which a growing utterance is decoded."""
    size = F.floor(F.col("value") * 100).cast("long")
    return table(spark, sf_dir, "events").select("event_id", F.explode(P.partial_blocks(size, 4000)).alias("b")).select("event_id", F.col("b.start").cast("long").alias("start"), F.col("b.end").alias("stop"), "b.complete")


@query(f"""WITH u AS ({UTTERANCES}), b AS (SELECT *, end_ms // 4000 AS batch FROM u),
    d AS (SELECT *, max(utt) FILTER (WHERE kind = 'final') OVER (PARTITION BY session_id ORDER BY batch RANGE UNBOUNDED PRECEDING) AS done FROM b)
    SELECT session_id, batch, utt, max(end_ms) AS end_ms FROM d WHERE kind = 'partial' AND (done IS NULL OR done < utt) GROUP BY ALL""")
def current_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT9, STR13, STR15: the last partial of an utterance in each batch, unless it is superseded."""
    return P.current_partials(realtime_utterances(spark, sf_dir), "session_id", "utt", "kind", "end_ms", 4000)


@query(f"""WITH l AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
    SELECT conv_id, turn, md5(coalesce(before, '') || coalesce(text, '')) AS joined_md5, regexp_replace(coalesce(before, ''), '\\s+$', '') AS lookup,
        regexp_replace(replace(CASE WHEN turn % 3 = 0 THEN ' ' || coalesce(text, '') || ' {P.ABORTED}' ELSE coalesce(text, '') END, '{P.ABORTED}', ''), '^\\s+|\\s+$', '', 'g') AS clean,
        len(string_split(coalesce(before, ''), ' ')) + len(string_split(coalesce(text, ''), ' ')) AS n_words FROM l""")
def partial_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCL8, SCL9, SCL25, SET1: a partial and its tail, its lookup key, its decoder's mark, and both token lists as one."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")).alias("before"))
    none = F.lit("")
    text, before = F.coalesce("text", none), F.coalesce("before", none)
    marked = F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" "), text, F.lit(" " + P.ABORTED))).otherwise(text)
    return rows.select("conv_id", "turn", F.md5(F.concat(before, text)).alias("joined_md5"), F.regexp_replace(before, r"\s+\z", "").alias("lookup"), P.without_abort(marked).alias("clean"), F.size(F.concat(F.split(before, " ", -1), F.split(text, " ", -1))).cast("long").alias("n_words"))


@query(f"""WITH {TOKENS}, e AS (SELECT conv_id, turn, max(e + 5000) AS last_ms FROM timed GROUP BY ALL)
    SELECT c.conv_id, c.turn, e.last_ms, c.turn % 2 = 0 AND c.turn % 4 <> 2 AND length(c.text) / 1000.0 < 0.4 AND length(regexp_replace(coalesce(c.text, ''), '^\\s+|\\s+$', '', 'g')) <= 20 AS dropped FROM conversations c LEFT JOIN e USING (conv_id, turn)""")
def tail_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG6, FLT8: the last word's end on the recording's axis, and short texts on next to no speech."""
    rows = table(spark, sf_dir, "conversations").join(turns(spark, sf_dir), ["conv_id", "turn"])
    status = F.when(F.col("turn") % 4 == 2, "TAIL_RESCUED").otherwise(P.NOTHING_NEW[1])
    kind = F.when(F.col("turn") % 2 == 0, "tail").otherwise("silence")
    last = F.array_max(F.transform("words", lambda w: w["end"] + 5000))
    return rows.select("conv_id", "turn", last.alias("last_ms"), P.hallucinated(kind, status, F.char_length("text") / 1000, F.col("text")).alias("dropped"))


@query(f"""WITH {TOKENS}, o AS (SELECT *, sum(length(word)) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS UNBOUNDED PRECEDING) - length(word) AS lo FROM timed),
    g AS (SELECT conv_id, turn, string_agg(word, '' ORDER BY pos) AS raw, min(s) FILTER (WHERE lo < 20 AND lo + length(word) > 10) AS start_ms, max(e) FILTER (WHERE lo < 20 AND lo + length(word) > 10) AS end_ms FROM o GROUP BY ALL)
    SELECT conv_id, turn, CASE WHEN length(raw) >= 20 THEN left(raw, 10) || '<X>' || substr(raw, 21) ELSE raw END AS text, CASE WHEN length(raw) >= 20 THEN start_ms END AS start_ms, CASE WHEN length(raw) >= 20 THEN end_ms END AS end_ms FROM g""")
def replaced_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOK5, SRT7: a span of a turn's characters is replaced; the new word takes the time of all it touches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = []
            for conv, turn, words in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "words")), strict=True):
                held = [(w["word"], w["start"], w["end"]) for w in words]
                new = tokensync.sync_replacements(held, [(10, 20, "<X>")])
                marked = [w for w in new or () if w[0] == "<X>"]
                rows.append((conv, turn, "".join(w for w, _, _ in new or held), *((marked[0][1], marked[0][2]) if marked else (None, None))))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "turn", "text", "start_ms", "end_ms"])

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return turns(spark, sf_dir).filter("words is not null").mapInArrow(run, "conv_id long, turn long, text string, start_ms long, end_ms long")

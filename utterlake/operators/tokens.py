"""Timed tokens and segments as nested columns: a turn's tokens stay in its row, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import SENTENCE_END, has_content


def timed(text: Column, origin_ms: Column, step: int = 250, length: int = 200) -> Column:
    """Space-separated words with a start and an end, ``step`` apart from an origin."""
    return F.transform(F.split(text, " ", -1), lambda w, i: F.struct(w.alias("word"), (origin_ms + i * step).alias("start"), (origin_ms + i * step + length).alias("end")))


def shift(words: Column, by: Column | int) -> Column:
    return F.transform(words, lambda w: F.struct(w["word"].alias("word"), (w["start"] + by).alias("start"), (w["end"] + by).alias("end")))


def drop_overlap(words: Column, cut: Column, eps: int) -> Column:
    """Tokens whose middle is not before the cut (less ``eps``); all of them if there is no cut."""
    return F.when(cut.isNull(), words).otherwise(F.filter(words, lambda w: w["start"] + w["end"] >= 2 * (cut - eps)))


def sentences(df: DataFrame, words: str, ends: str = SENTENCE_END) -> DataFrame:
    """One row per sentence of a column of timed tokens: index (from 1), start_ms, end_ms, n_tokens, text.

    A token that ends in a sentence mark, quotes or brackets after it aside, closes a sentence.  Sentences
    of punctuation alone are left out before they are numbered.
    """
    w = F.col(words)
    n = F.size(w)
    last = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, i)["word"].rlike(rf"[{ends}][\"”’)]*$"))
    first = F.filter(F.concat(F.array(F.lit(0)), F.transform(last, lambda i: i + 1)), lambda i: i < n)
    spans = F.transform(first, lambda s, k: F.slice(w, s + 1, F.coalesce(F.get(last, k), n - 1) - s + 1))
    made = F.transform(spans, lambda x: F.struct(F.array_join(F.transform(x, lambda t: t["word"]), " ").alias("text"), F.get(x, F.lit(0))["start"].alias("start_ms"), F.element_at(x, -1)["end"].alias("end_ms"), F.size(x).cast("long").alias("n_tokens")))
    kept = F.filter(made, lambda x: has_content(x["text"]))
    others = [c for c in df.columns if c != words]
    return df.filter(n > 0).select(*others, F.posexplode(kept).alias("at_", "s_")).select(*others, (F.col("at_") + 1).cast("long").alias("index"), "s_.start_ms", "s_.end_ms", "s_.n_tokens", "s_.text")


def with_offsets(df: DataFrame, keys: list[str], words: str) -> DataFrame:
    """One row per token of a column of timed tokens: pos, start, end, and its characters lo to hi, words apart by one."""
    rows = df.select(*keys, F.posexplode(words).alias("pos", "w"))
    before = W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    size = F.char_length("w.word")
    rows = rows.withColumn("hi", F.sum(size + 1).over(before) - 1)
    return rows.select(*keys, "pos", "w.start", "w.end", (F.col("hi") - size).alias("lo"), "hi")


def on_spans(placed: DataFrame, spans: DataFrame, keys: list[str], width: int = 64) -> DataFrame:
    """Of each span (keys, lo, hi) of character offsets: n_tokens and the time from the first to the last token it touches.

    Both sides meet in buckets of ``width`` characters; a pair that shares several counts in the first only.
    """
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / width), F.floor(F.greatest(hi - 1, lo) / width)))
    x = spans.select(*keys, "lo", "hi", cells(F.col("lo"), F.col("hi")).alias("cell"))
    y = placed.select(*(F.col(k).alias(f"{k}_") for k in keys), "pos", "start", "end", F.col("lo").alias("t_lo"), F.col("hi").alias("t_hi"), cells(F.col("lo"), F.col("hi")).alias("cell_"))
    same = F.col("cell") == F.col("cell_")
    for k in keys:
        same &= F.col(k) == F.col(f"{k}_")
    first = F.col("cell") == F.greatest(F.floor(F.col("lo") / width), F.floor(F.col("t_lo") / width))
    joined = x.join(y, same & first & (F.col("t_lo") < F.col("hi")) & (F.col("t_hi") > F.col("lo")), "left")
    return joined.groupBy(*keys, "lo").agg(F.count("pos").alias("n_tokens"), F.min("start").alias("start_ms"), F.max("end").alias("end_ms"))

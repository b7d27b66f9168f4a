"""Line dedup within an edit bound, by a deletion-neighbourhood join.

The bound grows with the length: two lines repeat each other if they are equal, or if the longer one has
at least ``exact_below`` code points and they are one character edit apart.  (One edit makes unlike words
of short lines.)  Every line that is not blank takes part.

Two lines within one character edit share a variant: either the same string with the character at
the same place left out (a replaced character), or one line is the other with a character left out.
All variants of a line, the line itself and each of its one-character deletions, are emitted as
hashed keys.  For equal variants it is enough to hold each line against the earliest one of its
group: by place for replaced characters, and against the whole line for missing ones.  Every hit is
verified by its edit distance.  A line goes if any line before it is within the bound.

A long line has many variants, so lines that cannot have a partner are left out first, without
loss: with one edit, one half of the line stays as it is at a known place, so a partner shares the
length and a hash of a half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import cut, per_worker, sized

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
LAST = 2**63 - 1
#: The place of a line: its document, a hash of the text where an id has several rows, and its number.
AT = ["doc_id", "text_key", "line_no"]
#: Variants that a task holds before it hands them on; a longer line is handed on by itself.
MOST_AT_ONCE = 200_000


def _lines(docs: DataFrame) -> DataFrame:
    """Numbered lines that take part: all that are not blank."""
    exploded = docs.select("doc_id", "text_key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return exploded.filter(F.trim(F.translate("line", "\t\r\x0b\x0c", "    ")) != "")


def _halves(line: Column, n: Column) -> list[Column]:
    """Four hashes, two of which any line within one edit shares with one of its own."""
    h, g = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    one = n.cast("int")
    return [
        F.xxhash64(one, F.lit("head"), F.left(line, h)), F.xxhash64(one, F.lit("tail"), F.substring(line, h + 1, one)),
        F.xxhash64(one - 1, F.lit("head"), F.left(line, g)), F.xxhash64(one - 1, F.lit("tail"), F.substring(line, g + 2, one)),
    ]


def variants(line: str) -> np.ndarray:
    """Hashes of a line and, after it, of the line without each of its characters, in linear time.

    A line's hash is a polynomial over mixed code points; prefix and suffix hashes give the rest.
    """
    c = np.frombuffer(line.encode("utf-32-le"), "<u4").astype(U64)
    c = (c + U64(1)) * U64(0xFF51AFD7ED558CCD)
    c ^= c >> U64(29)
    c *= U64(0xC4CEB9FE1A85EC53)
    n = len(c)
    power = np.ones(n + 1, U64)
    power[1:] = BASE
    power = np.multiply.accumulate(power)
    # value of character i in a string where k characters follow it: c[i] * BASE**k
    left = np.concatenate([np.zeros(1, U64), np.add.accumulate(c * power[n - 1 :: -1][:n])])  # prefix sums, n - 1 - i follow
    right = left[-1] - left
    # without character i, all before it move one step to the right: divide by BASE, that is, use one power less
    short = np.concatenate([np.zeros(1, U64), np.add.accumulate(c[:-1] * power[n - 2 :: -1][: n - 1])]) if n > 1 else np.zeros(1, U64)
    out = np.concatenate([left[-1:] + U64(n), short[:n] + right[1:] + U64(n - 1)])
    return out ^ (out >> U64(31))


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Variants of each line with the place left out (-1: none)."""
    per_worker(("lines",), bool)
    for batch in batches:
        at = [batch.column(c).to_numpy() for c in AT]
        rows: list[int] = []
        keys: list[np.ndarray] = []
        held = 0
        for k, line in enumerate(batch.column("line")):
            rows.append(k)
            keys.append(variants(line.as_py()))
            held += len(keys[-1])
            if held < MOST_AT_ONCE and k + 1 < batch.num_rows:
                continue
            size = [len(x) for x in keys]
            place = np.concatenate([np.arange(-1, n - 1) for n in size])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(place, pa.int32()), *(pa.array(np.repeat(x[rows], size)) for x in at)], names=["variant", "place", *AT])
            rows, keys, held = [], [], 0


def kept_lines(docs: DataFrame, exact_below: int, most_broadcast: int = 1_000_000) -> DataFrame:
    """Of each distinct line that repeats no earlier one: doc_id, text_key and line_no of its first place."""
    line, n = F.col("line"), F.char_length("line")
    # two hashes make a line's identity; a line that a third of all documents hold moves as one row per task
    halves = [F.when(n >= exact_below - 1, k).alias(f"k{i}") for i, k in enumerate(_halves(line, n))]
    ks = [f"k{i}" for i in range(4)]
    distinct = cut(_lines(docs).select(*AT, F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), *halves).groupBy("h1", "h2", *ks).agg(F.min(F.struct(*AT)).alias("at")).select("at.*", *ks), "lines")
    keys = distinct.filter("k0 is not null").select(*AT, F.explode(F.array(*ks)).alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("lines")).filter("lines > 1").select("key")
    maybe = cut(keys.join(sized(shared), "key").select(*AT).distinct(), "maybe")
    few = maybe.count() <= most_broadcast  # of 20 bytes; else both sides are shuffled
    # rows of one id and one text are the same here
    texts = cut(_lines(docs).join(sized(maybe, few), AT).dropDuplicates(AT), "texts")

    made = cut(texts.mapInArrow(_variants, "variant long, place int, doc_id long, text_key long, line_no int"), "variants")
    at = F.struct(*AT)
    gone = made.filter("place >= 0")
    first = gone.groupBy("variant", "place").agg(F.min(at).alias("early"), F.count("*").alias("n")).filter("n > 1").select("variant", "place", "early")
    replaced = gone.join(sized(first), ["variant", "place"]).select(at.alias("late"), "early")
    whole = made.filter("place = -1").select("variant", at.alias("whole"))
    missing = gone.join(sized(whole), "variant").select(F.greatest(at, "whole").alias("late"), F.least(at, "whole").alias("early"))
    pairs = replaced.unionByName(missing).filter("early < late").distinct().select("late", "early", "late.*")
    pairs = pairs.join(sized(texts.withColumnRenamed("line", "a")), AT).select("late", "a", "early.*").join(sized(texts.withColumnRenamed("line", "b")), AT)
    near = F.levenshtein("a", "b", 1).between(0, 1) & (F.greatest(F.char_length("a"), F.char_length("b")) >= exact_below)
    drop = pairs.filter(near).select("late.*").distinct()
    return distinct.select(*AT).join(sized(drop), AT, "left_anti")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", exact_below: int = 32) -> DataFrame:
    """``docs`` with, of all lines that repeat an earlier line, none but the earliest.

    Returns doc_id, text (the lines that stay), n_lines, n_kept.  Lines repeat if they are equal, or one
    edit apart and the longer one has at least ``exact_below`` code points; a very large value leaves
    equality alone.  Earlier means a smaller doc_id, then a smaller line number.  Lines end at "\\n".
    Blank lines (of ASCII white space) always stay.  Null and empty texts are one blank line.  Rows with a
    null id come last.  Rows of one id, null ones too, are each a document of their own, in the order of a
    hash of their texts; of rows with one id and one text any one is the first.  Other columns are not
    read; an empty table gives no rows.
    """
    source = docs.select(F.col(id_col).cast("long").alias("own_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc_id"))
    return _joined(source, exact_below).mapInArrow(_shorten, "own_id long, text string, n_lines long, n_kept long").withColumnRenamed("own_id", "doc_id")


def dedup_documents(docs: DataFrame, *, exact_below: int = 32) -> DataFrame:
    """Rows of ``docs`` with their text cut to the lines that stay and n_chars to its length.

    A row whose text is all repeated lines goes; one that was blank before stays.  Other columns stay.
    """
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own")
    source = docs.select(own, F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"))
    joined = _joined(source, exact_below)
    schema = T.StructType([joined.schema["own"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_kept", T.LongType())])
    out = joined.mapInArrow(_shorten, schema)
    out = out.filter((F.trim(F.translate("text", "\n\t\r\x0b\x0c", "     ")) != "") | (F.col("n_lines") == F.col("n_kept")))
    new = {"text": F.when(F.col("n_lines") == F.col("n_kept"), F.col("own.text")).otherwise(F.col("text")), "n_chars": F.when(F.col("n_lines") == F.col("n_kept"), F.col("own.n_chars")).otherwise(F.char_length("text").cast("long"))}
    return out.select(*(new.get(c, F.col(f"own.`{c}`")).alias(c) for c in docs.columns))


def _joined(source: DataFrame, exact_below: int, most_broadcast: int = 1_000_000) -> DataFrame:
    """The first column of ``source`` with the text and the line numbers that stay."""
    # a hash of the text tells rows of one id apart; where an id has one row it is 0, which costs next to nothing
    several = cut(source.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("several")), "several")
    several = sized(several, several.count() <= most_broadcast)  # of 8 bytes; else both sides are shuffled
    keyed = source.join(several, F.col("doc_id") == F.col("several"), "left").withColumn("text_key", F.when(F.col("several").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))).drop("several")
    stay = kept_lines(keyed.select("doc_id", "text_key", "text"), exact_below).groupBy("doc_id", "text_key").agg(F.collect_set("line_no").alias("stay"))
    joined = keyed.join(sized(stay), ["doc_id", "text_key"], "left")
    # the join has put rows of one id and one text side by side
    first = F.row_number().over(W.partitionBy("doc_id", "text_key").orderBy("doc_id")) == 1
    return joined.withColumn("first", first).select(source.columns[0], "text", F.when(F.col("first"), F.col("stay")).alias("stay"))


def _shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    per_worker(("lines",), bool)
    for batch in batches:
        text, n, kept = [], [], []
        for t, s in zip(batch.column("text"), batch.column("stay"), strict=True):
            lines, held = t.as_py().split("\n"), set(s.as_py() or ())
            left = [x for i, x in enumerate(lines) if i in held or not x.strip(" \t\r\x0b\x0c")]
            text.append("\n".join(left)), n.append(len(lines)), kept.append(len(left))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(kept, pa.int64())], names=[batch.schema.names[0], "text", "n_lines", "n_kept"])

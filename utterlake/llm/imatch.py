"""I-Match document fingerprints, with DataFrame functions only.

The lexicon holds the terms whose document frequency lies in a band of shares of all distinct texts.
With a lower share ``low`` it has at most (mean distinct terms of a document) / ``low`` entries,
however many documents there are, so it is broadcast; a count checks that.  A text's distinct
lexicon terms are sorted, and each of several randomised subsets of the lexicon hashes those of
them that it holds.  Subsets come in levels of falling density, so that short and very long texts
both have subsets with a few of their terms.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import cut

SUBSETS = 20
#: A subset of level k holds one lexicon term in LEVELS[k].
LEVELS = (20, 100, 500, 2500)
#: Spark's hash of an empty array is its seed; the fingerprint shows 24 bits of a subset's hash, which also make the likeness.
SEED, EMPTY, BITS = 42, -1, 0xFFFFFF
#: Bytes of text that a task orders, and the most tasks that literal cuts serve.
TASK_BYTES, MOST_TASKS = 32_000_000, 50_000


def terms(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits; at least one entry, which may be empty."""
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))


def lexicon(docs: DataFrame, text: Column, low: float, high: float, most_broadcast: int = 2_000_000) -> DataFrame:
    """Hashes of the terms that at least ``low`` (and two) and at most ``high`` of the distinct texts hold.

    Each of c copies of a text counts as 1 / c, so that the texts themselves are not shuffled.
    """
    keyed = docs.select(text.alias("text"), F.xxhash64(text).alias("text_key"))
    copies = cut(keyed.groupBy("text_key").agg(F.count("*").alias("copies")).filter("copies > 1"), "copies")
    groups, more = copies.agg(F.count("*"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))).first()
    n = docs.count() - more
    shared = keyed.join(F.broadcast(copies) if groups <= most_broadcast else copies, "text_key", "left")
    weight = F.coalesce(1 / F.col("copies"), F.lit(1.0)).alias("weight")
    found = shared.select(weight, F.explode(terms(F.col("text"))).alias("term")).filter("term <> ''").groupBy(F.xxhash64("term").alias("h")).agg(F.round(F.sum("weight")).cast("long").alias("count"))
    return found.filter(F.col("count").between(max(2, math.ceil(low * n)), math.floor(high * n))).select("h")


def _place(term: Column, level: int) -> Column:
    """Which of a level's sets a term hash falls in; the first SUBSETS of them are its subsets."""
    return F.pmod(F.shiftright(term, 9 * level), F.lit(LEVELS[level]))


def _hashes(held: Column, level: int) -> Column:
    """The hashes of one level's subsets of a sorted array of the term hashes that fall in them."""
    full = F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda s: F.xxhash64(F.filter(held, lambda t: _place(t, level) == s)))
    return F.transform(full, lambda h: F.when(h == SEED, EMPTY).otherwise(h.bitwiseAND(BITS)).cast("int"))


def _hits(a: Column, b: Column, test: Callable[[Column, Column], Column]) -> Column:
    return F.size(F.filter(F.zip_with(a, b, test), lambda hit: hit))


def likeness(a: list[Column], b: list[Column], a_text: Column, b_text: Column) -> Column:
    """Share of subsets with equal hashes, of those with a term on either side: the best level's.

    Past the first level at least half of the subsets are counted, so that a few chance hits do not
    make a likeness.  Texts without lexicon terms are alike if they are equal.
    """
    levels = []
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        equal = _hits(x, y, lambda p, q: (p == q) & (p != EMPTY))
        either = _hits(x, y, lambda p, q: (p != EMPTY) | (q != EMPTY))
        levels.append(equal / F.greatest(either, F.lit(SUBSETS // 2 if k else 1)))
    none = lambda side: F.forall(side[0], lambda p: p == EMPTY)
    return F.when(none(a) & none(b), (a_text == b_text).cast("double")).otherwise(F.greatest(*levels))


def _array(values: list, kind: str = "bigint") -> Column:
    return F.expr("array(" + ",".join("null" if v is None else f"{v}L" for v in values) + ")").cast(f"array<{kind}>")


def _bucket(cuts: list[int], value: Column) -> Column:
    """How many of the sorted cuts lie below a value, found in two steps of about sqrt(n) comparisons."""
    width = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)] or [[]]
    below = lambda xs: F.size(F.filter(xs, lambda c: c < value))
    group = below(_array([g[-1] for g in groups[:-1]]))
    inside = F.element_at(F.array(*map(_array, groups)), group + 1)
    return group * width + below(inside)


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of (doc_id, text, k, h), dealt in descending order of (k, h) over buckets of about TASK_BYTES.

    Adds bucket and extra: each bucket has, as extra row, a copy of the row that follows its last one
    (after the very last: the very first).  An id that fills several buckets is split by the hash of its
    texts, so only rows of one id and one text stay together.
    """
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    usual = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(MOST_TASKS, max(usual, math.ceil(size / TASK_BYTES)))
    found = Counter(rows.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] or [])
    cuts = sorted(found)
    slot = _bucket(cuts, F.col("k"))
    # a cut that is found m times is an id with m shares of the rows: it has m buckets of its own above its range's
    shares = [m if m > 1 else 0 for m in (found[c] for c in cuts)]
    first = list(accumulate((1 + m for m in shares), initial=0))
    mine = F.when(F.element_at(_array([*cuts, None]), slot + 1) == F.col("k"), F.element_at(_array([*shares, 0]), slot + 1)) if cuts else F.lit(None).cast("bigint")
    split = F.when(mine > 0, 1 + F.least(F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * mine), mine - 1)).otherwise(0)
    placed = rows.withColumn("slot", slot.cast("int")).withColumn("bucket", (F.element_at(_array(first), F.col("slot") + 1) + split).cast("int")).drop("slot")
    tops = {r["bucket"]: (r["top"]["k"], r["top"]["h"]) for r in placed.groupBy("bucket").agg(F.max(F.struct("k", "h")).alias("top")).collect()}
    used = sorted(tops)
    # the row on top of a bucket follows the last row of the next higher one; the very first follows the very last
    target = {b: (used[i + 1] if i + 1 < len(used) else used[0]) for i, b in enumerate(used)}
    every = range(max(used, default=0) + 1)
    at = lambda of: F.element_at(_array([of.get(b) for b in every]), F.col("bucket") + 1)
    top = (F.col("k") == at({b: k for b, (k, _) in tops.items()})) & (F.col("h") == at({b: h for b, (_, h) in tops.items()}))
    place = lambda b, extra: F.struct(b.cast("int").alias("bucket"), F.lit(extra).alias("extra"))
    both = F.when(top, F.array(place(F.col("bucket"), 0), place(at(target), 1))).otherwise(F.array(place(F.col("bucket"), 0)))
    dealt = placed.withColumn("at", F.explode(both)).select("doc_id", "text", "k", "h", "at.bucket", "at.extra")
    # the window that follows deals by bucket over the usual partitions; more buckets need more tasks
    return dealt if parts <= usual else dealt.repartition(parts, "bucket")


def fingerprint_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", low: float = 1e-3, high: float = 0.2, most_broadcast: int = 2_000_000) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The edited text's last third comes from the next document by descending id (after the last: the
    first).  Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.  Null texts are empty; a text without lexicon terms has its own hash as fingerprint.
    Null ids come last; rows that repeat an id follow each other by descending hash of their texts.
    Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    lowest = -(2**63) + 1
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = lexicon(rows, F.col("text"), low, high, most_broadcast)
    words = cut(words, "lexicon")
    few = words.count() <= most_broadcast

    dealt = _dealt(rows.withColumn("k", F.coalesce("doc_id", F.lit(lowest))).withColumn("h", F.xxhash64("text")))
    ordered = W.partitionBy("bucket").orderBy("extra", F.desc("k"), F.desc("h"), "text")
    edit = dealt.withColumn("row", F.row_number().over(ordered)).withColumn("after", F.lead("text").over(ordered)).withColumn("n_chars", F.char_length("text").cast("long"))
    edit = edit.withColumn("edited", F.expr("concat(left(text, cast(n_chars - n_chars div 3 as int)), left(coalesce(after, ''), cast(n_chars div 3 as int)))"))
    about = F.struct("extra", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.xxhash64(F.lower("text")).alias("own"), F.xxhash64(F.lower("edited")).alias("edited_own"))
    sides = edit.select("bucket", "row", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t"), about.alias("about")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t"), F.lit(None).alias("about")))).alias("x"))
    # the empty term keeps each text's row and carries what else is known of it; terms outside the band go early
    seen = sides.select("bucket", "row", "x.side", "x.about", F.explode(F.array_union(terms(F.col("x.t")), F.array(F.lit("")))).alias("term"))
    seen = seen.select("bucket", "row", "side", F.xxhash64("term").alias("h"), F.when(F.col("term") == "", F.col("about")).alias("about"))
    empty = spark.range(1).select(F.xxhash64(F.lit("")).alias("h"), F.lit(False).alias("in_band"))
    known = words.withColumn("in_band", F.lit(True)).unionByName(empty)
    seen = seen.join(F.broadcast(known) if few else known, "h")
    # all rows of a bucket are in one place already: neither this grouping nor the next window shuffles
    n = len(LEVELS)
    held = [F.array_sort(F.collect_list(F.when(F.col("in_band") & (F.col("side") == side) & (_place(F.col("h"), k) < SUBSETS), F.col("h")))).alias(f"{name}{k}") for side, name in ((0, "b"), (1, "c")) for k in range(n)]
    docs_ = seen.groupBy("bucket", "row").agg(F.first("about", ignorenulls=True).alias("about"), *held)
    # one row each through a generator: the sorted arrays are made once, and not anew for every subset
    docs_ = docs_.select("bucket", "row", "about.*", F.inline(F.array(F.struct(*(f"{x}{k}" for x in "bc" for k in range(n))))))
    docs_ = docs_.select("bucket", "row", "extra", "doc_id", "n_chars", "edited_sha256", "own", "edited_own", *(_hashes(F.col(f"{x}{k}"), k).alias(f"{y}{k}") for x, y in ("bf", "ce") for k in range(n)))
    line = W.partitionBy("bucket").orderBy("row")
    for c in [*(f"f{i}" for i in range(n)), "own"]:
        docs_ = docs_.withColumn(f"next_{c}", F.lead(c).over(line))
    f, e, x = ([F.col(f"{p}{i}") for i in range(n)] for p in ("f", "e", "next_f"))

    def text(side: list[Column], own: Column) -> Column:
        shown = F.array_join(F.transform(F.concat(*side), lambda p: F.when(p == EMPTY, "-").otherwise(F.lower(F.lpad(F.hex(p), 6, "0")))), ".")
        return F.when(F.forall(side[0], lambda p: p == EMPTY), F.concat(F.lit("text."), F.lower(F.hex(own)))).otherwise(shown)

    return docs_.filter("extra = 0").select(
        "doc_id", "n_chars", "edited_sha256", text(f, F.col("own")).alias("fingerprint"), text(e, F.col("edited_own")).alias("edited_fingerprint"),
        likeness(f, e, F.col("own"), F.col("edited_own")).alias("near_edited"), likeness(f, x, F.col("own"), F.col("next_own")).alias("near_next"),
    )

"""Intervals of quiet: islands, coverage, nearest and latest qualifying interval.

Time is in integer microseconds.  Every window is keyed by the source; range joins carry the source
and a day, so no plan has a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY = 86_400_000_000


def micros(ts: Column) -> Column:
    """A timestamp without a zone as microseconds since 1970."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def islands(frames: DataFrame, key: str, at: str, tie: str, quiet: Column) -> DataFrame:
    """Runs of quiet frames of a source: island (from 0), start_us, end_us, n.  One sort serves both windows."""
    order = W.partitionBy(key).orderBy(at, tie)
    marked = frames.select(key, at, tie, quiet.alias("quiet")).withColumn("begins", (F.col("quiet") & ~F.coalesce(F.lag("quiet").over(order), F.lit(False))).cast("int"))
    numbered = marked.withColumn("island", F.sum("begins").over(order) - 1).filter("quiet")
    return numbered.groupBy(key, "island").agg(F.min(at).alias("start_us"), F.max(at).alias("end_us"), F.count("*").alias("n"))


def running_with_reset(frames: DataFrame, key: str, at: str, tie: str, keeps: Column, amount: Column, name: str) -> DataFrame:
    """Running sum of ``amount`` over frames that keep it going; any other frame sets it to 0."""
    order = W.partitionBy(key).orderBy(at, tie)
    marked = frames.withColumn("keeps_", keeps).withColumn("reset_", F.sum((~F.col("keeps_")).cast("int")).over(order))
    run = W.partitionBy(key, "reset_").orderBy(at, tie).rowsBetween(W.unboundedPreceding, W.currentRow)
    return marked.withColumn(name, F.sum(F.when(F.col("keeps_"), amount).otherwise(0)).over(run)).drop("keeps_", "reset_")


def coverage(quiet: DataFrame, key: str) -> DataFrame:
    """Per source and day: quiet, speech, its share in thousandths, longest speech gap."""
    days = quiet.withColumn("day", F.explode(F.sequence(F.floor(F.col("start_us") / DAY), F.floor(F.col("end_us") / DAY))))
    low, high = F.col("day") * DAY, (F.col("day") + 1) * DAY
    cut = days.select(key, "day", F.greatest("start_us", low).alias("lo"), F.least("end_us", high).alias("hi"))
    before = W.partitionBy(key, "day").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1)
    gaps = cut.withColumn("gap", F.col("lo") - F.coalesce(F.max("hi").over(before), low))
    sums = gaps.groupBy(key, "day").agg(F.sum(F.col("hi") - F.col("lo")).alias("quiet_us"), F.max("gap").alias("gap"), F.max("hi").alias("last"))
    return sums.select(key, "day", "quiet_us", (DAY - F.col("quiet_us")).alias("speech_us"), F.floor((DAY - F.col("quiet_us")) * 1000 / DAY).cast("long").alias("speech_permille"), F.greatest("gap", high - F.col("last")).alias("longest_us"))


def nearest(quiet: DataFrame, key: str, target_of_day: int, reach: int) -> DataFrame:
    """Per source and day the interval whose middle is best placed for a cut near a target.

    It must overlap the window of ``reach`` around the target, and its middle lie in it up to its end.
    Twice the middle is kept, so that all is whole numbers; ties go to the earlier interval.
    """
    days = quiet.withColumn("day", F.explode(F.sequence(F.floor(F.col("start_us") / DAY), F.floor(F.col("end_us") / DAY))))
    target = F.col("day") * DAY + target_of_day
    lo, hi, mid2 = target - reach, target + reach, F.col("start_us") + F.col("end_us")
    fits = (F.least("end_us", hi) > F.greatest("start_us", lo)) & (mid2 > 2 * lo) & (mid2 <= 2 * hi)
    score = 10 * F.abs(mid2 - 2 * target) - 6 * (F.col("end_us") - F.col("start_us"))
    best = days.filter(fits).groupBy(key, "day").agg(F.min(F.struct(score.alias("score"), F.col("start_us"), mid2.alias("mid2"))).alias("b"))
    return best.select(key, "day", F.col("b.mid2").alias("mid2_us"), F.col("b.score").alias("score"))


def latest_before(targets: DataFrame, quiet: DataFrame, key: str, at: str, row: str, search: int, least: int) -> DataFrame:
    """As-of: of each target the latest interval that ended by then, is long enough and not too far back.

    Both sides are stacked and sorted once per source; the last qualifying interval is carried on.
    """
    long_ = quiet.filter(F.col("end_us") - F.col("start_us") >= least)
    stacked = long_.select(key, F.col("end_us").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias(row), F.struct("start_us", "end_us").alias("cut")).unionByName(targets.select(key, F.col(at).alias("at"), F.lit(1).alias("side"), F.col(row).cast("long").alias(row), F.lit(None).cast("struct<start_us:bigint,end_us:bigint>").alias("cut")))
    order = W.partitionBy(key).orderBy("at", "side", row).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = stacked.withColumn("cut", F.last("cut", ignorenulls=True).over(order)).filter("side = 1")
    near = F.col("cut.start_us") + F.col("cut.end_us") >= 2 * (F.col("at") - search)
    return found.select(row, F.when(near, F.col("cut.start_us")).alias("cut_start_us"), F.when(near, F.col("cut.end_us")).alias("cut_end_us"))


def session_numbers(frames: DataFrame, key: str, at: str, tie: str, gap: int) -> DataFrame:
    """Frames with the number of their session (from 0), and whether they begin one (new_)."""
    order = W.partitionBy(key).orderBy(at, tie)
    new = F.coalesce((F.col(at) - F.lag(at).over(order) > gap).cast("int"), F.lit(0))
    return frames.withColumn("new_", new).withColumn("session", F.sum("new_").over(order))


def gap_sessions(frames: DataFrame, key: str, at: str, tie: str, gap: int) -> DataFrame:
    """Sessions that end where the next frame is more than ``gap`` away."""
    return session_numbers(frames, key, at, tie, gap).groupBy(key, "session").agg(F.min(at).alias("start_us"), F.max(at).alias("end_us"), F.count("*").alias("n"))

"""Aggregates that need an order, without an order over all rows of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def percentiles(rows: DataFrame, group: str, value: str, wanted: dict[str, float], bins: int = 10_000) -> DataFrame:
    """Exact percentiles of each group (few groups), with linear interpolation: group, and a column for each wanted share.

    A histogram of ``bins`` equal ranges a group is summed before it moves and tells in which bins the
    wanted ranks lie; only values of those bins are sorted, after equal ones are counted together.  Null
    and not-a-number values do not count.
    """
    rows = rows.select(group, F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    sizes = rows.groupBy(group).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    place = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))).otherwise(0).alias("bin")
    binned = rows.join(F.broadcast(sizes), group).select(group, "v", place)
    order = W.partitionBy(group).orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    histogram = binned.groupBy(group, "bin").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(order)).withColumn("total", F.max("upto").over(W.partitionBy(group)))
    rank = lambda p: (F.col("total") - 1) * F.lit(float(p))
    ends = [r for p in wanted.values() for r in (F.floor(rank(p)), F.ceil(rank(p)))]
    holds = histogram.withColumn("r", F.explode(F.array_distinct(F.array(*ends)))).filter((F.col("r") < F.col("upto")) & (F.col("r") >= F.col("upto") - F.col("n")))
    bins_of = holds.select(group, "bin", (F.col("upto") - F.col("n")).alias("before"), "total").distinct()
    inside = binned.join(F.broadcast(bins_of), [group, "bin"]).groupBy(group, "bin", "before", "total", "v").agg(F.count("*").alias("n"))
    run = W.partitionBy(group, "bin").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = inside.withColumn("upto", F.col("before") + F.sum("n").over(run))
    at = lambda r: F.max(F.when((r < F.col("upto")) & (r >= F.col("upto") - F.col("n")), F.col("v")))
    found = placed.groupBy(group).agg(F.max("total").alias("total"), *(f(rank(p)).alias(f"{name}_{k}") for name, p in wanted.items() for k, f in (("lo", lambda r: at(F.floor(r))), ("hi", lambda r: at(F.ceil(r))))))
    share = lambda p: rank(p) - F.floor(rank(p))
    return found.select(group, *(F.when(share(p) == 0, F.col(f"{name}_lo")).otherwise((F.ceil(rank(p)) - rank(p)) * F.col(f"{name}_lo") + share(p) * F.col(f"{name}_hi")).alias(name) for name, p in wanted.items()))

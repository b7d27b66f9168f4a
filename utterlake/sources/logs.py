"""Timing lines of a service log as rows, by one native pattern per field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("audio_dur", "total_ms", "queue_ms", "infer_ms", "encode_ms", "prefill_ms", "decode_ms", "n_chunks", "cache_hits")


def timings(spark: SparkSession, path: str) -> DataFrame:
    """One row per line with ``kind=`` and ``key=value`` fields; a missing field is null."""
    lines = spark.read.text(path).filter(F.col("value").rlike(r"\bkind=\w+"))
    text = lambda name: F.regexp_extract("value", rf"\b{name}=(\S+)", 1)
    return lines.select(text("kind").alias("kind"), text("result").alias("result"), *(F.expr(f"try_cast(nullif(regexp_extract(value, '\\\\b{f}=([-0-9.]+)', 1), '') as double)").alias(f) for f in FIELDS))


def summary(rows: DataFrame) -> DataFrame:
    """p50 and p95 of each kind's fields over ready rows with values from 0 on."""
    long_ = rows.filter("result = 'ready'").unpivot(["kind"], [f for f in FIELDS if f.endswith("_ms")], "field", "ms").filter("ms >= 0")
    return long_.groupBy("kind", "field").agg(F.count("*").alias("n"), F.round(F.percentile("ms", 0.5), 3).alias("p50"), F.round(F.percentile("ms", 0.95), 3).alias("p95"))

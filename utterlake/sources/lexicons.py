"""Lexicon files as rows: one target per line with aliases and blacklisted words; the last line of a target wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parts(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\|"), lambda p: F.trim(p)), lambda p: p != "")


def parse(lines: DataFrame, line: str, number: str) -> DataFrame:
    """target, aliases (the target first), black, from lines and their numbers; blank and # lines are skipped."""
    kept = lines.select(F.col(number).alias("line_no"), F.trim(line).alias("line")).filter("line <> '' and line not like '#%'")
    halves = kept.select("line_no", F.split("line", "~~~", 2).alias("h"))
    rows = halves.select("line_no", parts(F.get("h", F.lit(0))).alias("aliases"), F.coalesce(parts(F.get("h", F.lit(1))), F.array().cast("array<string>")).alias("black")).filter(F.size("aliases") > 0)
    last = rows.groupBy(F.get("aliases", F.lit(0)).alias("target")).agg(F.max_by(F.struct("aliases", "black"), "line_no").alias("e"))
    return last.select("target", "e.aliases", "e.black")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A lexicon of text files; lines are numbered within their file's order."""
    return parse(spark.read.text(path).withColumn("n", F.monotonically_increasing_id()), "value", "n")

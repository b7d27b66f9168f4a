"""Uploads as tasks: a sink that adds nothing when a batch is replayed, and the status of each task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

STATUS = "task_id string, name string, status string, message string, at timestamp, batch long"
RESULT = "task_id string, payload string, batch long"


def _write(rows: DataFrame, path: str, batch: int) -> None:
    """A batch owns one partition, which a replay writes over."""
    rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def take(batch: DataFrame, number: int, transcribe: Callable[[DataFrame], DataFrame], folder: str) -> None:
    """Writes one batch of uploads: which tasks run, their results, then which are done and which failed."""
    rows = batch.persist()
    try:
        now, nothing = F.current_timestamp(), F.lit(None).cast("string")
        bad, good = rows.filter("error is not null"), rows.filter("error is null")
        began = good.select("task_id", "name", F.lit("running").alias("status"), nothing.alias("message"), now.alias("at"))
        _write(began.unionByName(bad.select("task_id", "name", F.lit("failed").alias("status"), F.col("error").alias("message"), now.alias("at"))), f"{folder}/status/phase=0", number)
        _write(transcribe(good), f"{folder}/results", number)
        done = rows.sparkSession.read.schema(RESULT).parquet(f"{folder}/results").filter(F.col("batch") == number).select("task_id", F.col("payload").isNotNull().alias("ok"))
        ok = F.coalesce("ok", F.lit(False))
        ended = good.select("task_id", "name").join(done, "task_id", "left")
        _write(ended.select("task_id", "name", F.when(ok, "completed").otherwise("failed").alias("status"), F.when(~ok, "NO_RESULT").alias("message"), now.alias("at")), f"{folder}/status/phase=1", number)
    finally:
        rows.unpersist()


def task_sink(uploads: DataFrame, transcribe: Callable[[DataFrame], DataFrame], folder: str) -> DataStreamWriter:
    """Takes uploads (:func:`landing.upload_stream`) batch by batch into ``folder``.

    ``transcribe`` gives (task_id, payload) for the rows that can be decoded; a task without a payload failed.
    """
    return uploads.writeStream.foreachBatch(lambda batch, number: take(batch, number, transcribe, folder)).option("checkpointLocation", f"{folder}/checkpoint")


def status(spark: SparkSession, folder: str) -> DataFrame:
    """The latest status of each task: task_id, name, status, message."""
    rows = spark.read.schema(STATUS + ", phase int").option("basePath", f"{folder}/status").parquet(f"{folder}/status/phase=*")
    last = rows.groupBy("task_id").agg(F.max(F.struct("phase", "batch", "at", "name", "status", "message")).alias("x"))
    return last.select("task_id", "x.name", "x.status", "x.message")


def answer(spark: SparkSession, folder: str, asked: DataFrame) -> DataFrame:
    """For each asked task_id: found or NOT_FOUND, NOT_READY while it runs, FAILED, or its payload."""
    results = spark.read.schema(RESULT).parquet(f"{folder}/results").groupBy("task_id").agg(F.max_by("payload", "batch").alias("payload"))
    held = asked.select("task_id").distinct().join(status(spark, folder), "task_id", "left").join(results, "task_id", "left")
    code = F.when(F.col("status").isNull(), "NOT_FOUND").when(F.col("status") == "running", "NOT_READY").when(F.col("status") == "failed", "FAILED").otherwise("OK")
    return held.select("task_id", code.alias("code"), F.when(code == "OK", F.col("payload")).alias("payload"), "message")

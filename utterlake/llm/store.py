"""Where intermediate tables go.

Lineage is cut with written tables in the folder that ``spark.checkpoint.dir`` names, which all
executors share.  Only in local mode, where driver and executors are one process, is a
temporary folder made if the setting is absent.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _OWN[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return it as read back: recomputation after a lost executor starts here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, few: bool = False) -> DataFrame:
    """The side of a join that a count found small, to broadcast; else both sides are shuffled.

    Spark's own choice goes by a table's bytes on disk, or by a column's usual size: what an explode, a
    mapInArrow or compression hides may be a hundred times as much in the driver.
    """
    return F.broadcast(df) if few else df.hint("merge")


_HELD: dict[tuple, Any] = {}


def per_worker(key: tuple, make: Callable[[], Any]) -> Any:
    """A Python worker's encoder or cache.  A worker outlives its tasks, so what another operator left is let go first."""
    if key not in _HELD:
        if _HELD:
            _HELD.clear()
            _give_back()
        _HELD[key] = make()
    return _HELD[key]


def _give_back() -> None:
    """Hands freed memory of this process back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)

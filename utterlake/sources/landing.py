"""Landing folders as streams: packets of sessions, and uploads with their status.

Spark's file source keeps track of which files were taken, so a restart goes on where it stopped, and any store
that Spark reads will do.  What is wrong with a file becomes a row of its own.
"""

from __future__ import annotations

import json
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packets import RATES
from . import audio

PACKETS = "session_id long, seq long, kind string, rms double, length_ms int, pcm binary, error string"
#: Commands that a session knows; all others are answered with an error.
COMMANDS = ("start", "flush", "end", "reset", "config", "stop")
FILES = "path string, modificationTime timestamp, length long, content binary"
UPLOADS = "task_id string, name string, duration double, pcm binary, error string"


def quantised(x: np.ndarray) -> bytes:
    """Samples from -1 to 1 as signed 16-bit little-endian."""
    return np.clip(np.rint(x * 32768), -32768, 32767).astype("<i2").tobytes()


def read_packet(raw: bytes, rate: int) -> tuple[bytes, float, int]:
    """A packet at the target rate: samples, loudness, milliseconds.  Telephone packets are resampled and held to their band."""
    x = audio.pcm_to_float(raw)
    if rate != audio.RATE:
        x = audio.pcm_to_float(quantised(audio.resample(x, rate)))
    return quantised(x), float(np.sqrt(np.mean(np.square(x, dtype=np.float64)))) if len(x) else 0.0, round(1000 * len(x) / audio.RATE)


def read_command(raw: bytes) -> tuple[str, str | None]:
    """Kind and error of a control message; what only configures a session is a packet of no length."""
    try:
        message = json.loads(raw)
        kind = message["type"] if isinstance(message, dict) else None
    except (ValueError, KeyError):
        return "audio", "INVALID_JSON"
    if kind not in COMMANDS:
        return "audio", "UNKNOWN_TYPE"
    if kind == "start" and message.get("sample_rate") not in (None, *RATES):
        return "audio", "UNSUPPORTED_SAMPLE_RATE"
    return ("audio" if kind in ("start", "config") else kind), None


def packet_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Packets as they land: ``<session>/<seq>.<rate>.pcm`` (s16le, mono) and ``<session>/<seq>.json`` (commands).

    A packet that cannot be used keeps its place in the session with no length, and says why.  Spark passes over
    files of no bytes at all; such a packet counts as lost.
    """
    stream = spark.readStream.schema(FILES).format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
    files = stream.option("pathGlobFilter", "*.{pcm,json}").load(folder).select("path", "content")
    name = r"([0-9]+)/([0-9]+)(?:\.([0-9]+))?\.(pcm|json)$"
    part = lambda k, kind: F.regexp_extract("path", name, k).cast(kind)
    rows = files.filter(F.col("path").rlike(name)).select(part(1, "long").alias("session_id"), part(2, "long").alias("seq"), F.expr("try_cast(regexp_extract(path, '\\\\.([0-9]+)\\\\.pcm$', 1) AS int)").alias("rate"), part(4, "string").alias("form"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for session, seq, rate, form, raw in zip(b["session_id"], b["seq"], b["rate"], b["form"], b["content"], strict=True):
                if form == "json":
                    kind, error = read_command(bytes(raw))
                    out.append((session, seq, kind, None, 0, b"", error))
                elif rate not in RATES:
                    out.append((session, seq, "audio", None, 0, b"", "UNSUPPORTED_SAMPLE_RATE"))
                elif len(raw) < 2:
                    out.append((session, seq, "audio", None, 0, b"", "EMPTY_AUDIO"))
                else:
                    pcm, rms, length = read_packet(bytes(raw), int(rate))
                    out.append((session, seq, "audio", rms, length, pcm, None))
            yield pd.DataFrame(out, columns=["session_id", "seq", "kind", "rms", "length_ms", "pcm", "error"])

    return rows.mapInPandas(run, PACKETS)


def upload_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Uploads as they land: task_id (of path and time), name, duration, samples at the target rate, error.

    Only WAV can be decoded here; any other file gives a row with ``UNSUPPORTED_FORMAT``.
    """
    files = spark.readStream.schema(FILES).format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    rows = files.select(F.sha2(F.concat_ws("|", "path", F.col("modificationTime").cast("string")), 256).alias("task_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for task, name, raw in zip(b["task_id"], b["name"], b["content"], strict=True):
                try:
                    x = audio.decode_wav(bytes(raw))
                except (wave.Error, EOFError):
                    out.append((task, name, None, b"", "UNSUPPORTED_FORMAT"))
                else:
                    out.append((task, name, len(x) / audio.RATE, quantised(x), None if len(x) else "EMPTY_AUDIO"))
            yield pd.DataFrame(out, columns=["task_id", "name", "duration", "pcm", "error"])

    return rows.mapInPandas(run, UPLOADS)

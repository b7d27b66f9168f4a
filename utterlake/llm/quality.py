"""Quality classifier by compression.

Two zstandard dictionaries are trained on text labelled good and bad.  A text is compressed with
each; how much smaller it gets with the good one, divided by the size, is its normalised difference,
taken over pieces of ``PIECE`` bytes (nearness to the dictionaries) and over the whole text (nearness
of its repetitions too).  A logistic fit on labelled texts that the dictionaries have not seen turns
the differences, with the plain compression rate, into a calibrated score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import cut, per_worker

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
PIECE, DICTIONARY, LEVEL = 512, 112_640, 3


@dataclass(frozen=True)
class Model:
    """Dictionaries and calibration: a few hundred kilobytes, whatever the corpus."""

    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]


class Meter:
    """Features of a text: two normalised compressed-size differences and the log compression rate."""

    def __init__(self, good: bytes, bad: bytes):
        plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        pack = lambda d: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **plain).compress if d else zstandard.ZstdCompressor(**plain).compress
        self.good, self.bad, self.none = pack(good), pack(bad), pack(b"")

    def __call__(self, text: bytes) -> tuple[float, float, float]:
        if not text:
            return 0.0, 0.0, 0.0
        g = b = 0
        for i in range(0, len(text), PIECE):
            piece = text[i : i + PIECE]
            g += len(self.good(piece))
            b += len(self.bad(piece))
        whole_g, whole_b = len(self.good(text)), len(self.bad(text))
        return (b - g) / max(b, g), (whole_b - whole_g) / max(whole_b, whole_g), float(np.log((len(self.none(text)) + 16) / (len(text) + 16)))


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or, where there is too little text to train on, the text itself."""
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    size = min(DICTIONARY, sum(map(len, pieces)) // 8)
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(pieces)[-DICTIONARY:]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights and intercept, by Newton's method with a small ridge."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, *, per_label: int = 3000, most_bytes: int = 24_000_000, longest: int = 1_500_000) -> Model:
    """Fit on at most ``per_label`` labelled rows of each label and ``most_bytes`` of their text.

    Rows are those first by a hash of their id, among labels whose crc32(doc_id as text) mod 3 is
    not 1.  Half of them make the dictionaries, the other half the calibration.  Rows without a label
    or a text of their own, and texts of more than ``longest`` bytes, are not used to fit (all are scored).
    Of texts under one id the greatest is taken; an id with both labels counts as bad.  With no usable
    label every score is one half.  The bound on bytes holds before anything reaches the driver.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    one = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ordered = lambda q: one.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
    ids = cut(ordered(0).unionByName(ordered(1)), "labelled_ids")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text").between(1, longest)).join(F.broadcast(ids), "doc_id")
    rows = cut(found.groupBy("doc_id", "quality").agg(F.max("text").alias("text")), "labelled")
    order = W.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, 0)
    lengths = rows.select("doc_id", "quality", F.octet_length("text").alias("n")).withColumn("so_far", F.sum("n").over(order)).filter(F.col("so_far") <= most_bytes // 2)
    sample = rows.join(F.broadcast(lengths.select("doc_id")), "doc_id", "left_semi").select("doc_id", "quality", F.col("text").cast("binary").alias("text"))
    texts: dict[tuple[int, int], list[bytes]] = {(q, h): [] for q in (0, 1) for h in (0, 1)}
    for k, r in enumerate(sample.orderBy(F.xxhash64("doc_id"), "doc_id").collect()):
        texts[r.quality, k % 2].append(bytes(r.text))
    good, bad = _dictionary(texts[1, 0]), _dictionary(texts[0, 0])
    meter = Meter(good, bad)
    x = np.array([meter(t) for q in (0, 1) for t in texts[q, 1]] or [(0.0, 0.0, 0.0)])
    y = np.repeat([0.0, 1.0], [len(texts[0, 1]), len(texts[1, 1])]) if len(texts[0, 1]) + len(texts[1, 1]) else np.array([0.5])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    return Model(good, bad, tuple(mean), tuple(scale), tuple(_logistic((x - mean) / scale, y)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Score every whole text: doc_id, held_out, score, predicted.

    Null counts as empty; an empty text has differences of 0.  Rows are independent: repeated rows
    score alike, a null id is not held out, other columns are not read, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = per_worker(("meter", model), lambda: Meter(model.good, model.bad))
        mean, scale, w = np.array(model.mean), np.array(model.scale), np.array(model.weights)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = (np.array([meter(t.as_py()) for t in batch.column(2)]) - mean) / scale
            p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return source.mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """Rows of ``docs`` whose score is at least ``least``, all columns as they were, in one pass.

    The text column is scored as in :func:`score`; a row with a null or empty text scores like an
    empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = per_worker(("meter", model), lambda: Meter(model.good, model.bad))
        mean, scale, w = np.array(model.mean), np.array(model.scale), np.array(model.weights)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = (np.array([meter((t.as_py() or "").encode()) for t in batch.column("text")]) - mean) / scale
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))) >= least))

    return docs.mapInArrow(run, docs.schema)

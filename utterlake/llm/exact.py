"""Exact dedup of a batch against an immutable snapshot.

The snapshot is a table of digests with one static binary-fuse filter per bucket of digests.  A new
batch is first grouped within itself.  Its digests are screened by their bucket's filter: a miss is
certainly new, a hit joins its exact bucket.  Texts of one digest are then compared byte by byte, by
grouping on the bytes themselves; where they are not equal, the bytes make the groups.  A filter takes about 1.13 bytes a digest and a bucket holds about
``per_bucket`` digests, so no task and no filter grows with the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut

U64 = np.uint64
FILTER_SCHEMA = "bucket int, seed long, segment long, segments long, fingerprints binary"


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser, keyed by ``seed``."""
    with np.errstate(over="ignore"):
        h = keys + U64(seed * 0x9E3779B97F4A7C15 % 2**64)
        h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> U64(33))


def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """The three slots of each key: one in each of three neighbouring segments (3 x n)."""
    base = (h >> U64(40)) % U64(segments) * U64(segment)
    low = U64(segment - 1)
    return np.stack([base + (h & low), base + U64(segment) + (h >> U64(13) & low), base + U64(2 * segment) + (h >> U64(26) & low)]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> U64(32))) & U64(0xFF)).astype(np.uint8)


class FuseFilter:
    """A static 3-wise binary-fuse filter with 8-bit fingerprints: no false negatives, 1 in 256 false positives."""

    def __init__(self, seed: int, segment: int, segments: int, fingerprints: np.ndarray):
        self.seed, self.segment, self.segments, self.fingerprints = seed, segment, segments, fingerprints

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """From distinct 64-bit keys, by peeling; a seed that fails to peel is followed by the next, with more room."""
        keys = np.unique(keys.astype(U64))
        n = len(keys)
        segment = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
        room = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
        for seed in range(1, 1000):
            segments = max(1, math.ceil(n * (room + 0.01 * seed) / segment) - 2)
            h = _mix(keys, seed)
            slots = _slots(h, segment, segments)
            size = (segments + 2) * segment
            count = np.bincount(slots.ravel(), minlength=size)
            xor = np.zeros(size, np.int64)
            for row in slots:
                np.bitwise_xor.at(xor, row, np.arange(n))
            count, xor, at = count.tolist(), xor.tolist(), slots.T.tolist()
            ready = [i for i, c in enumerate(count) if c == 1]
            order: list[tuple[int, int]] = []
            while ready:
                i = ready.pop()
                if count[i] != 1:
                    continue
                k = xor[i]
                order.append((k, i))
                for j in at[k]:
                    count[j] -= 1
                    xor[j] ^= k
                    if count[j] == 1:
                        ready.append(j)
            if len(order) == n:
                prints, table = _prints(h).tolist(), [0] * size
                for k, i in reversed(order):
                    a, b, c = at[k]
                    table[i] = prints[k] ^ table[a] ^ table[b] ^ table[c] ^ table[i]
                return cls(seed, segment, segments, np.asarray(table, np.uint8))
        raise RuntimeError("no seed peels")

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        h = _mix(keys.astype(U64), self.seed)
        a, b, c = _slots(h, self.segment, self.segments)
        t = self.fingerprints
        return (t[a] ^ t[b] ^ t[c]) == _prints(h)


def _build(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One filter per bucket of a partition that holds whole buckets."""
    if not (got := [b for b in tables if b.num_rows]):
        return
    table = pa.Table.from_batches(got)
    buckets, keys = table["bucket"].to_numpy(), table["key"].to_numpy().view(U64)
    for b in np.unique(buckets).tolist():
        f = FuseFilter.build(keys[buckets == b])
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "seed": [f.seed], "segment": [f.segment], "segments": [f.segments], "fingerprints": pa.array([f.fingerprints.tobytes()], pa.binary())})


def _screen(left: pa.Table, right: pa.Table) -> pa.Table:
    """Digests of one bucket against its filter; no filter, no hit."""
    hit = np.zeros(left.num_rows, bool)
    if right.num_rows:
        f = FuseFilter(*(right[c][0].as_py() for c in ("seed", "segment", "segments")), np.frombuffer(right["fingerprints"][0].as_py(), np.uint8))
        hit = f.may_hold(left["key"].to_numpy().view(U64))
    return left.append_column("hit", pa.array(hit)).select(["bucket", "digest", "last_id", "n", "hit"])


def sha256(text: Column) -> Column:
    """The 32 bytes of a text's SHA-256."""
    return F.unhex(F.sha2(text, 256))


def _grouped(rows: DataFrame, buckets: int) -> DataFrame:
    """Distinct digests with the largest id and the count: partly summed before the shuffle, so a text that a third of all rows hold moves as one row per task."""
    key = F.xxhash64("digest")
    return rows.groupBy("digest").agg(F.max("doc_id").alias("last_id"), F.count("*").alias("n")).withColumn("key", key).withColumn("bucket", F.pmod(F.hash("key"), F.lit(buckets)).cast("int"))


def build_snapshot(rows: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """The immutable snapshot of digest rows and its filters, both written."""
    snapshot = cut(_grouped(rows, buckets), "snapshot")
    filters = snapshot.select("bucket", "key").repartition(buckets, "bucket").mapInArrow(_build, FILTER_SCHEMA)
    return snapshot, cut(filters, "filters")


def dedup_batch(batch: DataFrame, snapshot: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """Groups of snapshot and batch together: digest, keep_id, group_size."""
    fresh = _grouped(batch, buckets)
    screened = cut(fresh.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_screen, "bucket int, digest binary, last_id long, n long, hit boolean"), "screened")
    hits = screened.filter("hit").select("bucket", "digest", F.col("last_id").alias("new_id"), F.col("n").alias("more"))
    old = snapshot.select("bucket", "digest", F.col("last_id").alias("old_id"), F.col("n").alias("had")).join(hits, ["bucket", "digest"], "full_outer")
    keep, size = F.greatest("old_id", "new_id"), F.coalesce("had", F.lit(0)) + F.coalesce("more", F.lit(0))
    return old.select("digest", keep.alias("keep_id"), size.cast("long").alias("group_size")).unionByName(screened.filter("not hit").select("digest", F.col("last_id").alias("keep_id"), F.col("n").alias("group_size")))


def unlike_texts(rows: DataFrame, several: DataFrame) -> DataFrame:
    """The digests of several rows that stand for more than one byte string.

    Only texts of such groups move, and equal ones are merged before the shuffle.
    """
    distinct = rows.select("digest", "text").join(several, "digest", "left_semi").groupBy("digest", "text").agg(F.lit(1).alias("one"))
    return distinct.groupBy("digest").count().filter("count > 1").select("digest")


def dedup_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", per_bucket: int = 100_000, most_broadcast: int = 500_000, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Exact duplicates of a whole table, half of which (by a hash of the id) is the snapshot and half the batch.

    Returns one row per row of ``docs``: doc_id, keep_id (largest doc_id of equal texts),
    group_size, kept, text_sha256.  Null texts equal empty ones.  A null doc_id is never the one to
    keep unless its whole group has none, and then all of that group stay.  Rows that repeat an id
    and its text are each returned and each kept.  Texts that share a ``digest`` and are not equal are
    grouped by their bytes.  Other columns are not read; an empty table gives no rows.  Digests of
    several rows are broadcast if there are at most ``most_broadcast`` (of 56 bytes); else both sides are
    shuffled, where adaptive execution splits hot digests.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("digest", digest(F.col("text")))
    slim = rows.select("doc_id", "digest")
    buckets = max(1, math.ceil(docs.count() / per_bucket))
    old = F.coalesce(F.xxhash64("doc_id") % 2 == 0, F.lit(True))
    snapshot, filters = build_snapshot(slim.filter(old), buckets)
    groups = cut(dedup_batch(slim.filter(~old), snapshot, filters, buckets).filter("group_size > 1"), "groups")
    few = groups.count() <= most_broadcast
    small = lambda df: F.broadcast(df) if few else df
    unlike = cut(unlike_texts(rows, small(groups.select("digest"))), "unlike")
    keep = F.coalesce("keep_id", "doc_id")
    shown = [
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == keep, F.col("doc_id").isNull() & keep.isNull()).alias("kept"),
    ]
    plain = digest is sha256
    hashed = F.lower(F.hex("digest")) if plain else F.sha2("text", 256)
    base = slim if plain else rows
    if not unlike.head(1):
        return base.join(small(groups), "digest", "left").select(*shown, hashed.alias("text_sha256"))
    out = base.join(small(groups), "digest", "left").join(unlike, "digest", "left_anti").select(*shown, hashed.alias("text_sha256"))
    # texts behind one digest: grouped by their bytes, partly before the shuffle
    mixed = rows.join(unlike, "digest", "left_semi")
    by_text = mixed.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return out.unionByName(mixed.join(by_text, ["digest", "text"], "left").select(*shown, F.sha2("text", 256).alias("text_sha256")))

"""Centroid clustering over subvector dictionaries.

Vectors are integers.  Their dimensions are cut into blocks; within a chunk of vectors each block is dictionary
encoded without loss: its distinct subvectors, and for each vector the code of its own.  Chunks are written once.
In a round a task takes each distinct subvector's exact distance to every centroid's block once, and a vector's
distances are sums of these by its codes.  Only one row of sums a centroid and chunk is shuffled, so a round moves
no vectors, and a frequent vector costs what any other does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, per_worker

#: Scaled components are held within this, so that squared distances of vectors up to 128 dimensions fit a long.
LIMIT = 2**27
CHUNK = "ids array<long>, dictionaries binary, sizes array<int>, codes binary"


def kept(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, v) of vectors with ``dims`` components, all finite; v = floor(scale * component)."""
    x = F.col(vector_col).cast("array<double>")
    whole = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.transform(x, lambda c: F.floor(F.least(F.greatest(c * scale, F.lit(float(-LIMIT))), F.lit(float(LIMIT)))).cast("int"))
    return vectors.filter(F.coalesce(whole, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("v"))


def encode(vectors: np.ndarray, block: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct subvectors of each block, and each vector's codes."""
    found, codes = [], np.empty((vectors.shape[1] // block, len(vectors)), np.uint32)
    for k in range(len(codes)):
        part = np.ascontiguousarray(vectors[:, k * block : (k + 1) * block])
        distinct, codes[k] = np.unique(part.view(f"V{4 * block}").ravel(), return_inverse=True) if block > 1 else np.unique(part.ravel(), return_inverse=True)
        found.append(np.frombuffer(distinct.tobytes(), np.int32).reshape(-1, block))
    return found, codes


def chunks(vectors: DataFrame, dims: int, block: int, most: int) -> DataFrame:
    """One row for up to ``most`` vectors of a partition, dictionary encoded."""

    def pack(ids: list[pa.Array], rows: list[np.ndarray]) -> pa.RecordBatch:
        found, codes = encode(np.concatenate(rows), block)
        named = pa.concat_arrays(ids)
        columns = [pa.ListArray.from_arrays(pa.array([0, len(named)], pa.int32()), named), pa.array([b"".join(x.tobytes() for x in found)], pa.binary()), pa.array([[len(x) for x in found]], pa.list_(pa.int32())), pa.array([codes.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["ids", "dictionaries", "sizes", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_worker(("clusters",), bool)
        ids, rows, n = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                if n + part.num_rows > most:
                    yield pack(ids, rows)
                    ids, rows, n = [], [], 0
                ids.append(part.column(0))
                rows.append(part.column(1).flatten().to_numpy().reshape(-1, dims))
                n += part.num_rows
        if n:
            yield pack(ids, rows)

    return vectors.mapInArrow(run, CHUNK)


def nearest(sizes: np.ndarray, dictionaries: bytes, codes: bytes, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Cluster and squared distance of each vector of a chunk, by its codes; the dictionaries and codes as arrays."""
    block = centroids.shape[1] // len(sizes)
    words, at = np.frombuffer(dictionaries, np.int32).reshape(-1, block), 0
    code, found = np.frombuffer(codes, np.uint32).reshape(len(sizes), -1), []
    total = np.zeros((code.shape[1], len(centroids)), np.int64)
    for k, size in enumerate(sizes):
        distinct = words[at : at + size].astype(np.int64)
        gap = distinct[:, None, :] - centroids[None, :, k * block : (k + 1) * block]
        total += (gap * gap).sum(axis=2)[code[k]]
        found.append(distinct)
        at += size
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(total)), cluster], found, code


def _sums(packed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Of each chunk and cluster: cluster, n, sums of components (each fits a long: a chunk is bounded)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cluster, _, found, code = nearest(row["sizes"], row["dictionaries"], row["codes"], centroids)
                held = np.unique(cluster)
                sums = np.zeros((len(centroids), centroids.shape[1]), np.int64)
                block = centroids.shape[1] // len(code)
                for k, distinct in enumerate(found):
                    # how often each cluster holds each subvector, times the subvector
                    times = np.bincount(cluster * len(distinct) + code[k], minlength=len(centroids) * len(distinct)).reshape(len(centroids), -1)
                    sums[:, k * block : (k + 1) * block] = times @ distinct
                n = np.bincount(cluster, minlength=len(centroids))
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(n[held], pa.int64()), pa.array(sums[held].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return packed.select("sizes", "dictionaries", "codes").mapInArrow(run, "cluster int, n long, sums array<long>")


def _assigned(packed: DataFrame, centroids: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                one = {c: row.column(i)[0].as_py() for i, c in enumerate(row.schema.names) if c != "ids"}
                cluster, distance, _, _ = nearest(one["sizes"], one["dictionaries"], one["codes"], centroids)
                yield pa.RecordBatch.from_arrays([row.column(0).flatten(), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return packed.mapInArrow(run, "vec_id long, cluster int, distance long")


def smallest(vectors: DataFrame, k: int, spare: int = 64) -> list:
    """The ``k`` rows with the smallest hashes.

    A bound on the hash that about ``spare * k`` rows pass comes first, so that what tasks send to the driver does
    not grow with their number; if fewer than ``k`` pass, all rows are looked at.
    """
    named = vectors.withColumn("h", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256))
    least = lambda rows: rows.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    bound = f"{int(min(1.0, spare * k / max(1, vectors.count())) * (16**15 - 1)):015x}"
    found = least(named.filter(F.left("h", F.lit(15)) <= bound))
    return found if len(found) == k else least(named)


def cluster_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 64, k: int = 16, rounds: int = 3, block: int = 2, chunk: int = 32_768) -> DataFrame:
    """k-means of integer vectors, exact at every step.

    Returns per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.  Vectors
    that are null, have another length or hold a component that is null or not finite are left out.  Centroids
    start as the vectors with the smallest hashes of ``1:<vec_id>`` (rows that repeat an id: in the order of
    their components; a null id comes last); with fewer than ``k`` vectors there are as many centroids.  Scaled
    components are held within 2**27 so that distances fit a long.  Ties go to the smaller cluster; a cluster without
    vectors keeps its centroid.  ``dims`` is a multiple of ``block``.  Other columns are not read; an empty table
    gives no rows.
    """
    ready = kept(vectors, id_col, vector_col, dims, scale)
    packed = cut(chunks(ready, dims, block, chunk), "chunks")
    first = smallest(ready, k)
    centroids = np.array([r["v"] for r in first], np.int64).reshape(-1, dims)
    for _ in range(rounds if len(first) else 0):
        sums = _sums(packed, centroids).groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)))
        for r in sums.collect():  # at most k rows
            centroids[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dims)]
    found = cut(_assigned(packed, centroids), "assigned")
    inertia = {r["cluster"]: r["total"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # at most k rows
    rows = [(c, t, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, t in inertia.items()]
    whole = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(whole), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

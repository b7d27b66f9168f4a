"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A document's set is its distinct five-word shingles.  Its signature has ``SYMBOLS`` symbols of 16
bits, split into ``CHUNKS`` chunks.  By the pigeonhole principle, two signatures that differ in at
most ``CHUNKS * (ERRORS + 1) - 1`` symbols have a chunk that differs in at most ``ERRORS``; so each
chunk is written once for every choice of symbols to leave out, and documents that share such a key
are candidates.  A pair at a similarity of 0.85 is missed with a chance of 2e-8, one at 0.8 with 2e-6.

Equal sets are one class, so exact copies never meet in a join.  Within the group of a key, members
are first held against the smallest one only.  Pairs are tested further only where their group still
has several components, and only those of unlike components that share a rare shingle early enough to
reach the threshold: links inside a component change nothing.  Every link is confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .packing import Cache
from .store import cut, per_worker, sized

U64 = np.uint64
WORDS, SYMBOLS, CHUNKS, ERRORS = 5, 50, 10, 1
P = U64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(5)
A = _RNG.integers(0, 2**63, SYMBOLS, dtype=np.int64).astype(U64) * U64(2) + U64(1)
B = _RNG.integers(0, 2**63, SYMBOLS, dtype=np.int64).astype(U64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles; A-Z is lower-cased, words end at ASCII white space."""

    def __init__(self, words: int = WORDS, most: int = 150_000):
        self.words, self.most, self.hashes = words, most, Cache(xxhash.xxh64_intdigest)

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if len(self.hashes) > self.most:
            self.hashes.clear()
        w = np.fromiter(map(self.hashes.__getitem__, words), U64, len(words))
        if not len(w):
            return w
        span = min(self.words, len(w))
        h = np.full(len(w) - span + 1, span, U64)
        for k in range(span):
            h = h * P + w[k : len(w) - span + 1 + k]
        return np.unique(_mix(h))


def signature(shingles: np.ndarray, block: int = 2048) -> np.ndarray:
    """16-bit symbols: the lowest bits of each permutation's minimum."""
    least = np.full(SYMBOLS, ~U64(0), U64)
    for k in range(0, len(shingles), block):
        np.minimum(least, (shingles[k : k + block, None] * A + B).min(axis=0), out=least)
    return (_mix(least) & U64(0xFFFF)).astype(np.uint16)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cut_up = per_worker(("shingles", WORDS), Shingler)
    for batch in batches:
        n, key, sig = [], [], []
        for t in batch.column(1):
            s = cut_up(t.as_py())
            n.append(len(s))
            key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            sig.append(signature(s).astype(np.int16).tolist() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.list_(pa.int16()))], names=["doc_id", "n_shingles", "set_key", "signature"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One key for each chunk and each symbol of it that is left out."""
    width = SYMBOLS // CHUNKS
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = batch.column(2).flatten().to_numpy().reshape(-1, SYMBOLS).astype(np.int64).astype(U64)
        keys = []
        for c in range(CHUNKS):
            for gone in range(width):
                h = np.full(len(sig), c * width + gone + 1, U64)
                for j in range(width):
                    if j != gone:
                        h = _mix(h * P + sig[:, c * width + j])
                keys.append(h)
        out = np.stack(keys, 1)
        rep, n = (np.repeat(batch.column(i).to_numpy(), out.shape[1]) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(out.ravel().view(np.int64)), pa.array(rep), pa.array(n)], names=["key", "rep", "n"])


def _sets(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut_up = per_worker(("shingles", words), lambda: Shingler(words))
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                sets = [cut_up(t.as_py()).view(np.int64) for t in part.column(1)]
                ends = np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))], names=["rep", "shingles"])

    return run


def _counted(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """Edges (a, b), written, with their number and a sum of their hashes, which the write itself gives."""
    state = Observation()
    written = cut(edges.observe(state, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), name)
    return written, (state.get["n"], state.get["sum"])


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, most_broadcast: int = 200_000) -> DataFrame:
    """Connected components of an edge table: node, label (the smallest node it reaches).

    Alternates large-star and small-star rounds, each written, until the edges no longer change.  The
    smallest neighbours are broadcast while there are at most ``most_broadcast`` edges.
    """
    now, seen = _counted(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct(), "edges")
    for _ in range(rounds if seen[0] else 0):
        few = seen[0] * 2 <= most_broadcast
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(sized(least, few), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(sized(floor, few), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(floor.select("a", F.col("m").alias("b"))).distinct()
        now, state = _counted(small, "star")
        if state == seen:
            break
        seen = state
    else:
        if seen[0]:
            raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label"))


def extended(labels: DataFrame, links: DataFrame, most_broadcast: int = 200_000) -> DataFrame:
    """``labels`` of :func:`components` after more links (a, b): only the components that these join go through rounds again."""
    ends = links.select("a", "b")
    for k in "ab":
        ends = ends.join(sized(labels.select(F.col("node").alias(k), F.col("label").alias(f"label_{k}"))), k, "left")
    ends = ends.select(*(F.coalesce(f"label_{k}", k).alias(k) for k in "ab"))
    joined = components(ends, most_broadcast=most_broadcast)
    if not (n := joined.count()):
        return labels
    new = joined.select(F.col("node").alias("label"), F.col("label").alias("root"))
    moved = labels.join(sized(new, n <= most_broadcast), "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    return cut(moved.unionByName(joined), "labels")


def shingle_sets(docs: DataFrame, ids: DataFrame, most_broadcast: int = 1_000_000, words: int = WORDS) -> DataFrame:
    """Full sets of some documents, written: rep, shingles.

    The ids are broadcast if a count shows at most ``most_broadcast`` (of 8 bytes); else both sides
    are shuffled.
    """
    ids = cut(ids, "ids")
    return cut(docs.join(sized(ids, ids.count() <= most_broadcast), "doc_id", "left_semi").mapInArrow(_sets(words), "rep long, shingles array<long>"), "sets")


def rare_pairs(sets: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of unlike labels among ``members`` (rep, label), whose ``sets`` are given, that may meet the threshold; exact.

    Shingles are ordered from the rarest to the most frequent.  Of two sets that meet the threshold, the
    first shared one lies so early in both that what follows still holds the least overlap.  Shingles of a
    passage that many documents share come last, and own edits of near copies first, so neither makes pairs.
    """
    tokens = sets.join(sized(members), "rep").select("rep", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    counts = tokens.groupBy("s").agg(F.count("*").alias("df"))
    order = W.partitionBy("rep", "n").orderBy("df", "s")
    early = tokens.join(sized(counts), "s").withColumn("i", F.row_number().over(order) - 1)
    early = cut(early.filter((100 * (F.col("n") - F.col("i")) >= percent * F.col("n")) & (F.col("df") > 1)).drop("df"), "early")
    x, y = (early.select("s", *(F.col(c).alias(f"{c}_{k}") for c in ("rep", "label", "n", "i"))) for k in "ab")
    room = F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b"))
    fits = (F.col("label_a") < F.col("label_b")) & ((100 + percent) * room >= percent * (F.col("n_a") + F.col("n_b")))
    return x.join(sized(y), (x["s"] == y["s"]) & fits).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()


def confirm(docs: DataFrame, pairs: DataFrame, percent: int, most_broadcast: int = 1_000_000) -> DataFrame:
    """The pairs (a, b) whose full sets meet ``100 * intersection >= percent * union``.

    Only texts that stand in a pair are read again.
    """
    sets = shingle_sets(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), most_broadcast)
    one, two = (sets.select(F.col("rep").alias(k), F.col("shingles").alias(f"set_{k}")) for k in "ab")
    inter, total = F.size(F.array_intersect("set_a", "set_b")), F.size("set_a") + F.size("set_b")
    return pairs.join(sized(one), "a").join(sized(two), "b").filter(100 * inter >= percent * (total - inter)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """Near-duplicate components of all documents.

    Returns per row: doc_id, n_shingles, component_id (smallest doc_id that links reach), kept
    (doc_id = component_id).  Null and empty texts, and texts of white space, have no shingles and
    link with nothing; a text of fewer than five words is one shingle.  Rows that repeat an id each
    go with their own text's class; as a class's smallest id, they link what any of their texts
    links.  A row with a null id takes its class's component, null if that
    has no id, and stays only then.  Other columns are not read; an empty table gives no rows.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    sketches = cut(source.mapInArrow(_sketch, "doc_id long, n_shingles long, set_key binary, signature array<smallint>"), "sketches")
    full = sketches.filter("n_shingles > 0")
    classes = cut(full.groupBy("set_key", "n_shingles", "signature").agg(F.min("doc_id").alias("rep")), "classes")
    members = classes.filter("rep is not null").select("rep", F.col("n_shingles").alias("n"), "signature")
    keys = members.mapInArrow(_keys, "key long, rep long, n long")
    heads = keys.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count("*").alias("size")).filter("size > 1").select("key", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n"))
    grouped = cut(keys.join(sized(heads), "key"), "grouped")
    alike = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)

    # first against the smallest member of each group
    stars = cut(grouped.filter((F.col("rep") != F.col("hub")) & alike("n", "hub_n")).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    links = cut(confirm(source, stars, percent), "links")
    labels = components(links)

    # then unlike components that still share a group
    label = F.coalesce("label", "rep").alias("label")
    now = grouped.join(sized(labels), grouped["rep"] == labels["node"], "left").select("key", "rep", "n", label)
    mixed = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    rest = cut(now.join(sized(mixed), "key").select("rep", "label").distinct(), "rest")
    sets = shingle_sets(source, rest.select(F.col("rep").alias("doc_id")))
    more = confirm(source, rare_pairs(sets, rest, percent).join(sized(stars), ["a", "b"], "left_anti"), percent)
    ends = extended(labels, more)

    label = F.coalesce("label", "rep").alias("component_id")
    found = cut(classes.join(sized(ends), classes["rep"] == ends["node"], "left").select("set_key", label), "found")
    out = sketches.select("doc_id", "n_shingles", "set_key").join(sized(found), "set_key", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_one_each(docs: DataFrame, *, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` that are the kept document of their component; rows that repeat an id stay or go together.

    A row with a null id comes after all ids (below 2**62), in the order of a hash of its text; of such
    rows with one text one stays.
    """
    own = F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2) + F.lit(2**62))
    named = docs.select(own.alias("doc_id"), "text")
    kept = cut(near_duplicates(named, percent=percent).filter("kept").select(F.col("doc_id").alias("own")).distinct(), "kept")
    # a row travels as one column, so that no name of its own meets one made here
    rows = docs.select(own.alias("own"), "text", F.struct(*docs.columns).alias("row")).join(sized(kept), "own", "left_semi")
    return rows.filter("row.doc_id is not null").unionByName(rows.filter("row.doc_id is null").dropDuplicates(["own", "text"])).select("row.*")

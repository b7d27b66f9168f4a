"""N-gram Jaccard join in the metric space of shingle sets.

The Jaccard distance ``1 - intersection / union`` is a metric, so pivots divide the space.

1. *Voronoi regions.*  Some documents that lie far from one another are pivots.  Every document's exact
   distance to each is taken; it lives in the region of the nearest one.  With a join distance ``t``, a
   partner of ``x`` can live in the region of ``q`` only if ``d(x, q) <= d(x, p) + 2t``: boundary
   documents are replicated by this window.  What is farther than ``1 - 2t`` from all pivots is the far
   region, whose window starts ``t`` before.
2. *Balls.*  What lies within ``t`` of its pivot is linked by that distance alone.  A member of the ball
   has partners outside only if it lies within ``t`` of the nearest document beyond the ball; else it
   leaves the join.  So a group of near copies with a third of all rows costs one pass.
3. *Leaves.*  A region is divided by size (the distance of sizes, ``1 - smaller / larger``, bounds the Jaccard
   distance from below; the window is a factor), and a size band by classes of the shingle universe:
   two sets within ``t`` differ in at most ``k`` shingles, so of more than ``k`` classes one has no
   difference.  Documents meet where they hold the same shingles of a class.
4. *Recursion.*  A leaf's smallest member is its pivot.  Exact distances to it link what they can; leaves
   that still hold several components take another pivot and are cut into rings around it, each with the
   window of the next, and so on.
5. What a few such rounds leave joins on rare shingles, exactly.

Every link is confirmed on full sets; equal sets are one class throughout.  Documents on unlike subjects are
all at distance 1, where no pivot divides them: the far region is as large as the corpus is varied, and it is
the leaves that keep it from being compared pair by pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neardup import U64, Shingler, _mix, components, extended, rare_pairs, shingle_sets
from .store import cut, per_worker, sized

WORDS = 3
FAR = -1
#: Distances are doubles of exact fractions; windows are wider by this, which loses nothing.
EPS = 1e-9


@dataclass(frozen=True)
class Space:
    """Pivots, and the sizes and classes that follow from the threshold."""

    percent: int
    shingles: np.ndarray  # of all pivots, sorted
    owner: np.ndarray  # the pivot of each
    sizes: np.ndarray
    edges: np.ndarray  # first size of each band

    @property
    def t(self) -> float:
        return 1 - self.percent / 100

    @classmethod
    def of(cls, pivots: list[np.ndarray], percent: int, ratio: float = 1.3) -> Space:
        whole = np.concatenate([*pivots, np.empty(0, U64)])
        owner = np.repeat(np.arange(len(pivots)), [len(p) for p in pivots])
        order = np.argsort(whole, kind="stable")
        edges, at = [], 1
        while at < 2**40:
            edges.append(at)
            at = max(at + 1, int(at * ratio))
        return cls(percent, whole[order], owner[order], np.array([len(p) for p in pivots], np.int64), np.array(edges, np.int64))

    def overlaps(self, s: np.ndarray) -> np.ndarray:
        """Shingles that a set shares with each pivot."""
        lo, hi = np.searchsorted(self.shingles, s, "left"), np.searchsorted(self.shingles, s, "right")
        held = np.flatnonzero(hi > lo)
        both = np.zeros(len(self.sizes), np.int64)
        if len(held):
            both += np.bincount(np.concatenate([self.owner[lo[i] : hi[i]] for i in held]), minlength=len(both))
        return both

    def regions(self, d: np.ndarray) -> tuple[int, float, list[int]]:
        """Home region, distance to its pivot (the nearest one in any case), and all regions of a document."""
        if not len(d):
            return FAR, 1.0, [FAR]
        p = int(d.argmin())
        far = 1 - 2 * self.t
        home = FAR if d[p] > far + EPS else p
        if home == FAR:
            return home, float(d[p]), [FAR]
        found = [FAR] if d[p] > far - self.t - EPS else []
        return home, float(d[p]), found + np.flatnonzero((d <= d[p] + 2 * self.t + EPS) & (d <= far + self.t + EPS)).tolist()

    def differences(self, smaller: int) -> int:
        """Shingles in which two sets within the threshold differ at most, by the size of the smaller one."""
        return smaller * (100 - self.percent) // self.percent

    def bands(self, n: int) -> Iterator[tuple[int, int]]:
        """(band, largest smaller size) for each band that a set of n shingles is in: its own, and those a partner may be in."""
        k = int(np.searchsorted(self.edges, n, "right")) - 1
        while k >= 0 and n * self.percent <= (top := int(self.edges[k + 1]) - 1) * 100:
            yield k, top
            k -= 1

    def keys(self, s: np.ndarray, regions: list[int]) -> np.ndarray:
        """Leaf keys of a set.  Sets that can only link with equal ones have none."""
        out = []
        parts = _mix(s * U64(0x9E3779B97F4A7C15) + U64(0x7F4A7C15))
        for band, top in self.bands(len(s)):
            most = self.differences(top)
            if not most:
                continue
            m = most + 3 + most // 8
            which = (_mix(s ^ U64(band + 1)) % U64(m)).astype(np.int64)
            order = np.argsort(which, kind="stable")
            which = which[order]
            starts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
            held, sums = which[starts], np.add.reduceat(parts[order], starts)
            if m - len(held) >= m - most:
                # so many classes without a shingle that the class without a difference may be one of them
                none = np.setdiff1d(np.arange(m), held)
                held, sums = np.r_[held, none], np.r_[sums, np.zeros(len(none), U64)]
            salted = _mix(sums ^ _mix(held.astype(U64) * U64(2654435761) + U64(band + 1)))
            out += [_mix(salted + U64(r + 2)) for r in regions]
        return np.concatenate([*out, np.empty(0, U64)])


def choose_pivots(docs: DataFrame, percent: int, *, most: int = 64, sample: int = 512, longest: int = 20_000) -> Space:
    """Pivots from a bounded random sample of (doc_id, text).

    Any choice gives the same links.  Each row is drawn by itself, so that whatever the number of tasks about
    ``2 * sample`` texts of at most ``longest`` bytes go to the driver; up to ``most`` of their sets stay, each farther
    than ``4t`` from those before, so that windows stay narrow.
    """
    drawn = docs.filter(F.rand(5) * F.lit(max(1, docs.count())) < 2 * sample)
    rows = drawn.filter("doc_id is not null").filter(F.length("text").between(1, longest)).orderBy("doc_id").limit(sample).collect()
    cut_up, chosen = Shingler(WORDS), []
    for s in (cut_up(bytes(r["text"])) for r in rows):
        if len(chosen) < most and len(s) and all((both := len(np.intersect1d(s, c, assume_unique=True))) / (len(s) + len(c) - both) < percent / 25 - 3 for c in chosen):
            chosen.append(s)
    return Space.of(chosen, percent)


PLACED = "doc_id long, n_shingles long, set_key binary, home int, d double, inside boolean, near array<struct<region:int,d:double>>, keys array<long>"


def place(docs: DataFrame, space: Space) -> DataFrame:
    """One pass over (doc_id, text): size, set key, home region and distance, the distances within its windows, leaf keys."""
    near = pa.list_(pa.struct([("region", pa.int32()), ("d", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut_up = per_worker(("shingles", WORDS), lambda: Shingler(WORDS))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, rows = batch.slice(at, 500), []
                for t in part.column(1):
                    s = cut_up(t.as_py())
                    key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    if not len(s):
                        rows.append((0, key, FAR, 1.0, False, [], np.empty(0, np.int64)))
                        continue
                    both = space.overlaps(s)
                    total = len(s) + space.sizes - both
                    d = 1 - both / total
                    home, least, found = space.regions(d)
                    inside = home != FAR and bool(100 * both[home] >= space.percent * total[home])
                    rows.append((len(s), key, home, least, inside, [{"region": r, "d": float(d[r])} for r in found if r != FAR], space.keys(s, found).view(np.int64)))
                n, key, home, least, inside, close, keys = zip(*rows, strict=True) if rows else [()] * 7
                ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
                keys = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*keys, np.empty(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(home, pa.int32()), pa.array(least, pa.float64()), pa.array(inside, pa.bool_()), pa.array(close, near), keys], names=["doc_id", "n_shingles", "set_key", "home", "d", "inside", "near", "keys"])

    return docs.mapInArrow(run, PLACED)


def measure(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with the exact size of their intersection and union: both, total."""
    one, two = (sets.select(F.col("rep").alias(k), F.col("shingles").alias(f"set_{k}")) for k in "ab")
    met = pairs.join(sized(one), "a").join(sized(two), "b").select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("both"), (F.size("set_a") + F.size("set_b")).alias("sizes"))
    return met.select("a", "b", "both", (F.col("sizes") - F.col("both")).alias("total"))


def alike(percent: int) -> Callable[[str, str], F.Column]:
    return lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _mixed(now: DataFrame) -> DataFrame:
    """Of leaves (key, rep, n, label) those with several labels; of leaves with the same members one."""
    groups = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("who"))
    one = groups.filter("low < high").groupBy("size", "who").agg(F.min("key").alias("key")).select("key")
    return now.join(sized(one), "key")


def _relabel(rows: DataFrame, labels: DataFrame) -> DataFrame:
    found = rows.drop("label").join(sized(labels), F.col("rep") == F.col("node"), "left")
    return found.select("key", "rep", "n", F.coalesce("label", "rep").alias("label"))


def join_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 90, rounds: int = 3, most_pivots: int = 64, sample: int = 512) -> DataFrame:
    """Components of the Jaccard join of all documents at ``percent`` (51 to 100), by 3-word shingles.

    Returns per row: doc_id, n_shingles, component_id (smallest doc_id that links reach), n_links (other
    distinct sets that its own was seen to link with; those between members of one component need not be seen).
    Null and empty texts, and texts of white space, have no shingles and link with nothing; a text of fewer than
    three words is one shingle.  Rows that repeat an id each go with their own text's class.  A row with a
    null id takes its class's component, null if that has no id.  Other columns are not read; an empty table gives
    no rows.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    space = choose_pivots(source, percent, most=most_pivots, sample=sample)
    placed = cut(place(source, space), "placed")
    # rows of one set hold the same in all other columns
    same = placed.filter("n_shingles > 0").groupBy("set_key", F.col("n_shingles").alias("n"))
    classes = cut(same.agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("home", "d", "inside", "near", "keys"))), "classes")
    members = classes.filter("rep is not null")

    # balls: linked to the pivot, and only those that reach to the nearest document beyond stay in the join
    t = space.t
    beyond = members.select("home", "inside", F.explode("near").alias("x")).filter(~(F.col("inside") & (F.col("home") == F.col("x.region")))).groupBy(F.col("x.region").alias("ball")).agg(F.min("x.d").alias("edge"))
    hubs = members.filter("inside").groupBy(F.col("home").alias("ball")).agg(F.min(F.struct("d", "rep"))["rep"].alias("hub"))
    # at most one row a pivot
    stays = members.join(F.broadcast(beyond), F.col("home") == F.col("ball"), "left").filter(~F.col("inside") | (F.col("d") >= F.col("edge") - t - EPS))
    ball_links = members.filter("inside").join(F.broadcast(hubs), F.col("home") == F.col("ball")).filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"))

    leaves = stays.select(F.explode("keys").alias("key"), "rep", "n")
    heads = leaves.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count("*").alias("size")).filter("size > 1").select("key", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n"))
    grouped = cut(leaves.join(sized(heads), "key"), "leaves")
    near = alike(percent)
    stars = cut(grouped.filter("rep <> hub").filter(near("n", "hub_n")).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    holds = (100 * F.col("both") >= percent * F.col("total"))
    linked = lambda sets, pairs: measure(sets, pairs).filter(holds).select("a", "b")
    every = lambda pairs: shingle_sets(source, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), words=WORDS)
    links = cut(linked(every(stars), stars).unionByName(ball_links), "links")
    labels = components(links)

    rest = cut(_mixed(_relabel(grouped.select("key", "rep", "n"), labels)), "rest")
    if not rest.isEmpty():
        sets = shingle_sets(source, rest.select(F.col("rep").alias("doc_id")).distinct(), words=WORDS)
        for k in range(rounds):
            pivots = rest.groupBy("key").agg(F.min_by("rep", F.xxhash64("rep", F.lit(k))).alias("pivot"))
            around = rest.join(sized(pivots), "key").filter("rep <> pivot")
            far = cut(measure(sets, around.select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()), "measured")
            more = far.filter(holds).select("a", "b")
            links, labels = links.unionByName(more), extended(labels, more)
            ring = F.floor((1 - F.col("both") / F.col("total")) / (t + EPS)).cast("int")
            rings = around.join(sized(far), (F.col("pivot") == F.col("a")) & (F.col("rep") == F.col("b"))).select("key", "rep", "n", ring.alias("ring"))
            rings = rings.select(F.explode(F.array("ring", F.col("ring") - 1)).alias("ring"), "key", "rep", "n").filter("ring >= 0")
            rest = cut(_mixed(_relabel(rings.select(F.xxhash64("key", "ring").alias("key"), "rep", "n"), labels)), "rest")
            if rest.isEmpty():
                break
        else:
            left = cut(rest.select("rep", "label").distinct(), "left")
            more = cut(linked(sets, rare_pairs(sets, left, percent)), "links")
            links, labels = links.unionByName(more), extended(labels, more)

    n_links = links.distinct().select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    ends = members.select("rep", "set_key").join(sized(labels), F.col("rep") == F.col("node"), "left").join(sized(n_links), "rep", "left")
    found = cut(classes.select("set_key").join(sized(ends.select("set_key", F.coalesce("label", "rep").alias("component_id"), "n_links")), "set_key", "left"), "found")
    out = placed.select("doc_id", "n_shingles", "set_key").join(sized(found), "set_key", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))

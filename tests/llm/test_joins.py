"""Ranked search, Jaccard join and clustering against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from utterlake.llm import clusters, jaccard, neardup, ranked

from .fixtures import documents, odd_documents


def shingles(t, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def near_copies(n, seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[r.choice(vocabulary) for _ in range(r.choice([5, 12, 40, 150, 400]))] for _ in range(n // 20)]
    for i in range(n):
        # half of the rows are copies of three texts
        words = list(r.choice(bases[:3] if r.random() < 0.5 else bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5, 8])):
            k = r.randrange(len(words))
            words[k : k + r.randint(0, 1)] = [r.choice(vocabulary)]
        yield i * 3, " ".join(words), "en", "s", 0


def brute_components(rows, percent):
    """Smallest id that each distinct set reaches; rows with a null id link nothing of their own."""
    sets = defaultdict(list)
    for d, t, *_ in rows:
        sets[shingles(t)].append(d)
    nodes = {s: min(ds) for s, ds in ((s, [d for d in ds if d is not None]) for s, ds in sets.items()) if s and ds}
    label = {d: d for d in nodes.values()}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    whole = list(nodes)
    for i, a in enumerate(whole):
        for b in whole[:i]:
            if 100 * (both := len(a & b)) >= percent * (len(a) + len(b) - both):
                x, y = find(nodes[a]), find(nodes[b])
                label[max(x, y)] = min(x, y)
    return Counter((d, len(shingles(t)), (find(nodes[s]) if (s := shingles(t)) in nodes else None) if shingles(t) else d) for d, t, *_ in rows)


@pytest.mark.parametrize("options", [{}, {"rounds": 0}, {"most_pivots": 0, "rounds": 1}])
def test_jaccard_join_against_all_pairs(spark, options):
    rows = list(near_copies(400, 2))
    got = jaccard.join_components(documents(spark, rows), **options).drop("n_links")
    assert Counter(map(tuple, got.collect())) == brute_components(rows, 90)


def test_jaccard_join_of_odd_rows(spark):
    rows = [r for r in odd_documents() if r[1] != "another text under the same id"]
    rows += [(7000, "a b c d e f g h i j k l m n o p", None, None, None), (7000, "a b c d e f g h i j k l m n o p q", None, None, None)]
    got = jaccard.join_components(documents(spark, rows), percent=80).drop("n_links")
    assert Counter(map(tuple, got.collect())) == brute_components(rows, 80)
    assert jaccard.join_components(documents(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("percent", [80, 90, 95])
def test_regions_and_leaves_lose_no_pair(percent):
    """Any two sets within the threshold share a leaf key, whatever the pivots are, or one ball."""
    r = random.Random(percent)
    word = lambda: np.uint64(r.getrandbits(64))
    for _ in range(60):
        base = [word() for _ in range(r.choice([9, 10, 20, 60, 300]))]
        edit = lambda k: np.unique(np.array([*base[k:], *(word() for _ in range(r.randint(0, k)))], np.uint64))
        made = [edit(r.randint(0, max(1, len(base) // 3))) for _ in range(12)]
        space = jaccard.Space.of(made[: r.randint(0, 3)], percent)
        keys, balls = [], []
        for s in made:
            both = space.overlaps(s)
            d = 1 - both / (len(s) + space.sizes - both)
            home, least, found = space.regions(d)
            keys.append(set(space.keys(s, found).tolist()))
            balls.append(home if least <= space.t + jaccard.EPS else None)
        for i, a in enumerate(made):
            for j, b in enumerate(made[:i]):
                both = len(np.intersect1d(a, b))
                if both < len(np.union1d(a, b)) and 100 * both >= percent * len(np.union1d(a, b)):
                    assert keys[i] & keys[j], (len(a), len(b), both)


def test_components_do_not_depend_on_pivots(spark):
    rows = list(near_copies(200, 5))
    got = [Counter(map(tuple, jaccard.join_components(documents(spark, rows), sample=k).drop("n_links").collect())) for k in (1, 512)]
    assert got[0] == got[1]


def brute_ranked(docs, items, top=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, Counter(split(t))) for d, t, *_ in docs]
    held = [(d, c, c.total()) for d, c in held if c]
    length, df = sum(n for *_, n in held), Counter(t for _, c, _ in held for t in c)
    out = {}
    for item, query in items:
        scores = []
        for d, c, n in held:
            m = 10 + 90 * n * len(held) // length
            s = sum(math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(split(query)) if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        out[item] = [(k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scores)[:top])]
    return out


def test_ranked_search_against_all_scores(spark):
    docs = odd_documents(200)
    vocabulary = sorted({w for _, t, *_ in docs for w in re.findall(r"\w+", t or "")})
    r = random.Random(1)
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 40)))) for i in range(30)] + [(90, None), (91, ""), (92, "notthere"), (93, "One, one; TWO")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("x")).withColumn("score", F.lit("x"))
    want = {i: found for i, found in brute_ranked(docs, items).items() if found}
    for options in ({}, {"run_postings": 500}, {"block_bytes": 300}):
        got = defaultdict(list)
        for row in ranked.best_documents(documents(spark, docs), table, **options).collect():
            got[row.item_id].append((row["rank"], row.doc_id, row.score))
        assert {i: sorted(v) for i, v in got.items()} == want
    assert ranked.best_documents(documents(spark, docs).limit(0), table).collect() == []
    assert ranked.best_documents(documents(spark, docs), table.limit(0)).collect() == []


@pytest.mark.parametrize("share", [1, 8, 10**9])
def test_skipping_keeps_the_best(share):
    """Short lists summed, all lists summed, and none: the same heap."""
    r = np.random.default_rng(share % 97)
    n = 3000
    ids = r.permutation(n)
    postings = [(np.sort(r.choice(n, size=int(n * f), replace=False))) for f in (0.001, 0.01, 0.05, 0.3, 0.6, 0.9)]
    row = np.concatenate([[(p, t) for p in ps] for t, ps in enumerate(postings)])
    order = np.lexsort((row[:, 1], row[:, 0]))
    row = row[order]
    ends = np.r_[0, np.cumsum(np.bincount(row[:, 0], minlength=n))]
    tfs = r.integers(1, 5, len(row)).astype(np.int32)
    index = ranked.Lists(ids.astype(np.int64), r.integers(5, 500, n), ends, row[:, 1].astype(np.int32), tfs, n, 100 * n)
    query = [(t, int(w)) for t, w in enumerate((9000, 6000, 3000, 900, 200, 0))]
    scores = Counter()
    for t, w in query:
        for p, i in zip(*index.get(t), strict=True):
            scores[int(p)] += int(i) * w
    want = sorted(((s, -int(index.ids[p])) for p, s in scores.items() if s > 0), reverse=True)[:10]
    best = []
    ranked.search(index, query, best, share=share, window=256)
    assert sorted(best, reverse=True) == want


def brute_clusters(rows, k=16, rounds=3):
    held = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(held, key=lambda x: (x[0] is None, hashlib.sha256(f"1:{x[0]}".encode()).hexdigest(), x[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        parts = defaultdict(list)
        for _, v in held:
            parts[near(v)[1]].append(v)
        for j, vs in parts.items():
            centroids[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, *near(v)) for i, v in held]
    inertia = Counter()
    for _, d, j in found:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, j, d, inertia[j], inertia.total(), digest[j]) for i, d, j in found)


@pytest.mark.parametrize("block", [1, 2, 4])
def test_clusters_against_plain_rounds(spark, block):
    r = random.Random(block)
    # floats as the tables hold them
    vector = lambda: [float(np.float32(r.gauss(0, 0.3))) for _ in range(64)]
    rows = [(i, vector()) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(150)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 63), (2003, [None] + [0.0] * 63), (2004, [float("nan")] + [0.0] * 63), (2005, [float("inf")] * 64), (2006, [0.0] * 64), (None, rows[7][1]), (3, rows[8][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("x")).withColumn("sums", F.lit("x")).repartition(4)
    got = clusters.cluster_vectors(table, block=block, chunk=64)
    assert Counter(map(tuple, got.collect())) == brute_clusters(rows)
    assert clusters.cluster_vectors(table.limit(0)).collect() == []
    few = table.filter("vec_id < 5")
    assert Counter(map(tuple, clusters.cluster_vectors(few, block=block).collect())) == brute_clusters([x for x in rows if x[0] is not None and x[0] < 5])


def test_codes_give_the_vectors_back():
    v = np.random.default_rng(1).integers(-9, 9, (500, 64)).astype(np.int32)
    for block in (1, 2, 8):
        found, codes = clusters.encode(v, block)
        assert (np.concatenate([f[c] for f, c in zip(found, codes, strict=True)], axis=1) == v).all()


def test_stage_takes_any_column_name(spark):
    rows = documents(spark, odd_documents(40))
    for c in ("own", "row", "kept_id", "node", "component_id", "set_key"):
        rows = rows.withColumn(c, F.lit("y"))
    assert neardup.keep_one_each(rows).columns == rows.columns

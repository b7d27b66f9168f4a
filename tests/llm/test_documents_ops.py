"""Packing, exact dedup, BPE, fingerprints, near-dedup and quality against brute force."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from utterlake.llm import bpe, exact, imatch, neardup, packing, quality
from utterlake.llm.vocab import tokenizer_path

from .fixtures import COLUMNS, documents, odd_documents


def tokenizer(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_packing_holds_every_piece_once(spark):
    out = packing.pack_documents(documents(spark), tokenizer_path("word_bpe_49k.json"), bins_per_task=4).collect()
    tok = tokenizer("word_bpe_49k.json")
    want = Counter()
    for d, t, *_ in odd_documents():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want[d, k, s, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(k[3] * c for k, c in want.items())
    assert len(bins) <= 1.03 * total / 2048 + 2


def test_word_ids_equal_the_tokenizer():
    words, tok = packing.WordIds(tokenizer_path("word_bpe_49k.json"), most=50), tokenizer("word_bpe_49k.json")
    for t in ["", "Don't STOP it's 42!", "x\x1cy \x85 z　q", "é É ǅ İ ﬁ", "a <|endoftext|>b <|ENDOFTEXT|>", *(r[1] or "" for r in odd_documents())]:
        assert np.frombuffer(words(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(3))
def test_pair_index_equals_the_tokenizer(seed):
    import random

    r = random.Random(seed)
    coder, tok = bpe.PairIndexBpe(tokenizer_path("byte_bpe_50k.json"), most=200), tokenizer("byte_bpe_50k.json")
    texts = ["".join(r.choice(" \n\taab'sé1.,<|日\x1f\x85") for _ in range(r.randint(0, 80))) for _ in range(300)]
    texts += ["", "<|endoftext|>", "a<|endoftext|>  b", "\0<|endoftext|>", "aaaaaaaaaaaa", *(x[1] or "" for x in odd_documents())]
    for t, ids in zip(texts, coder.encode_many(texts), strict=True):
        want = tok.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert coder.decode(ids) == tok.decode(want, skip_special_tokens=False)


def test_encode_decode_table(spark):
    tok = tokenizer("byte_bpe_50k.json")
    want = Counter()
    for d, t, *_ in odd_documents():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.encode_decode(documents(spark), tokenizer_path("byte_bpe_50k.json"), group_chars=900).collect())) == want


def test_fuse_filter_has_no_false_negatives():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 10, 1000, 30_000):
        keys = r.integers(0, 2**63, n).astype(np.uint64)
        f = exact.FuseFilter.build(keys)
        assert f.may_hold(keys).all()
    others = r.integers(0, 2**63, 50_000).astype(np.uint64)
    assert f.may_hold(others).mean() < 0.01
    assert len(f.fingerprints) < 1.3 * 30_000


def test_exact_dedup(spark):
    groups = defaultdict(list)
    for d, t, *_ in odd_documents():
        groups[t or ""].append(d)
    want = Counter()
    for t, ds in groups.items():
        keep = max((d for d in ds if d is not None), default=None)
        for d in ds:
            want[d, keep, len(ds), d == keep, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter(map(tuple, exact.dedup_table(documents(spark), per_bucket=20).collect())) == want


def shingles(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_texts_that_share_a_digest_are_told_apart(spark):
    weak = lambda t: F.substring(F.unhex(F.sha2(t, 256)), 1, 1)
    plain = Counter(map(tuple, exact.dedup_table(documents(spark), per_bucket=20).collect()))
    for most in (10**6, 0):
        assert Counter(map(tuple, exact.dedup_table(documents(spark), per_bucket=20, most_broadcast=most, digest=weak).collect())) == plain


def test_signatures_miss_next_to_nothing(spark):
    """Chance that no chunk is within its errors, for pairs at the thresholds of the query and of the stage."""
    width = neardup.SYMBOLS // neardup.CHUNKS
    miss = lambda s: (1 - s**width - width * s ** (width - 1) * (1 - s)) ** neardup.CHUNKS
    assert miss(0.85) < 1e-7 and miss(0.8) < 5e-6


def test_quality_sample_is_bounded_before_it_is_collected(spark):
    rows = [(i, "good words here " * (i + 1) if i % 2 else "BAD!!! " * (i + 1), None, None, None) for i in range(60)]
    rows += [(1, "again the same id", None, None, None), (3, None, None, None, None)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(2, 1, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    one, two = quality.fit(docs, labels), quality.fit(docs, labels.repartition(7))
    assert one == two
    for few in (quality.fit(docs, labels, most_bytes=1000), quality.fit(docs, labels, longest=40), quality.fit(docs, labels, longest=1)):
        assert all(0 <= r.score <= 1 for r in quality.score(docs, few).collect())
    empty = documents(spark, rows).limit(0)
    assert quality.score(empty, quality.fit(empty, labels)).collect() == [] and quality.keep_good(empty, one, 0.5).collect() == []


def brute_components(rows, percent=85):
    """Rows and their components; rows of one id that is a class's smallest are one node, as documented."""
    sets = [shingles(t) for _, t, *_ in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    low = defaultdict(list)
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            low[root(i)].append(d)
    return [(d, len(sets[i]), min(low[root(i)], default=None) if sets[i] else d) for i, (d, *_) in enumerate(rows)]


def test_near_duplicates(spark):
    rows = odd_documents(200, seed=5)
    want = Counter((d, n, c, d == c or c is None) for d, n, c in brute_components(rows))
    assert Counter(map(tuple, neardup.near_duplicates(documents(spark, rows)).collect())) == want


def test_components(spark):
    import random

    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        return x if up[x] == x else root(up[x])

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    want = {x: root(x) for x in up if root(x) != x}
    assert {r.node: r.label for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_fingerprints(spark):
    rows = odd_documents()
    out = imatch.fingerprint_table(documents(spark), low=0.001, high=0.5).collect()
    assert Counter((r.doc_id, r.n_chars) for r in out) == Counter((d, len(t or "")) for d, t, *_ in rows)
    unique = [(d, t or "") for d, t, *_ in rows if d is not None and [x[0] for x in rows].count(d) == 1]
    by_id = {r.doc_id: r for r in out}
    order = sorted((d for d, *_ in rows if d is not None), reverse=True)
    texts = dict(unique)
    for d, t in unique:
        after = order[order.index(d) + 1] if d != order[-1] else None
        if after in texts:
            k = len(t) // 3
            assert by_id[d].edited_sha256 == hashlib.sha256((t[: len(t) - k] + texts[after][:k]).encode()).hexdigest()
    prints = defaultdict(set)
    for d, t in unique:
        prints[t].add(by_id[d].fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    long = [by_id[d] for d, t in unique if len(t) > 300]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.2


def brute_imatch(rows, low, high):
    """Plain I-Match: (doc_id, edited_sha256) to fingerprint, edited fingerprint and the two likenesses."""
    h64 = lambda data, seed=42: (x := xxhash.xxh64_intdigest(data, seed=seed)) - 2**64 * (x >= 2**63)
    terms = lambda t: {w for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w}
    rows = sorted(((d, t or "") for d, t, *_ in rows), key=lambda x: (-(2**63) + 1 if x[0] is None else x[0], h64(x[1]), x[1]), reverse=True)
    distinct = {t for _, t in rows}
    df = Counter(w for t in distinct for w in terms(t))
    band = {h64(w) for w, c in df.items() if max(2, math.ceil(low * len(distinct))) <= c <= math.floor(high * len(distinct))}

    def prints(t):
        held = sorted(h for h in map(h64, terms(t)) if h in band)
        levels = []
        for k, size in enumerate(imatch.LEVELS):
            level = []
            for s in range(imatch.SUBSETS):
                got, h = [x for x in held if (x >> 9 * k) % size == s], 42
                for x in got:
                    h = h64(struct.pack("<q", x), h % 2**64)
                level.append(h & 0xFFFFFF if got else -1)
            levels.append(level)
        return levels

    def show(levels, t):
        if all(x == -1 for x in levels[0]):
            return f"text.{h64(t.lower()) % 2**64:x}"
        return ".".join("-" if x == -1 else f"{x:06x}" for level in levels for x in level)

    def alike(a, b, x, y):
        if all(v == -1 for v in a[0] + b[0]):
            return float(x.lower() == y.lower())
        return max(sum(p == q != -1 for p, q in zip(u, v)) / max(sum(p != -1 or q != -1 for p, q in zip(u, v)), 10 if k else 1) for k, (u, v) in enumerate(zip(a, b)))

    out = Counter()
    for k, (d, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(t)
        e = t[: n - n // 3] + after[: n // 3]
        p, q, r = prints(t), prints(e), prints(after)
        out[d, n, hashlib.sha256(e.encode()).hexdigest(), show(p, t), show(q, e), round(alike(p, q, t, e), 9), round(alike(p, r, t, after), 9)] += 1
    return out


def test_fingerprints_against_plain_imatch(spark):
    rows = [*odd_documents(), *((None, f"null id text {i} with some words of its own", None, None, None) for i in range(30)), *((33, f"one id {i} many texts", None, None, None) for i in range(40))]
    out = imatch.fingerprint_table(documents(spark, rows), low=0.001, high=0.5).collect()
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in out)
    assert got == brute_imatch(rows, 0.001, 0.5)


def test_hot_ids_are_split(spark):
    rows = documents(spark, [(None, f"text {i}", None, None, None) for i in range(300)] + [(i, f"own {i}", None, None, None) for i in range(300)]).selectExpr("doc_id", "text", "coalesce(doc_id, -5) AS k", "xxhash64(text) AS h")
    sizes = [r["count"] for r in imatch._dealt(rows).filter("extra = 0").groupBy("bucket").count().collect()]
    assert sum(sizes) == 600 and max(sizes) < 100


def test_copies_do_not_move_the_band(spark):
    """A third of the rows is one text: its terms stay in the lexicon, and the other rows' too."""
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda: " ".join(r.choice(vocabulary) for _ in range(60))
    texts = [prose() for _ in range(80)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    hot = [(1000 + i, texts[0], "en", "s", 0) for i in range(40)]
    few, all_ = ({x.h for x in imatch.lexicon(documents(spark, x), F.col("text"), 0.02, 0.2).collect()} for x in (rows, rows + hot))
    want = Counter(w for t in texts for w in set(t.split()))
    assert few == all_ and len(few) == sum(2 <= c <= 16 for c in want.values())
    prints = {x.doc_id: x.fingerprint for x in imatch.fingerprint_table(documents(spark, rows + hot), low=0.02).collect()}
    assert not prints[1000].startswith("text.") and prints[1000] == prints[0]


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = quality.score(docs.join(labels, "doc_id"), quality.fit(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    y, p = np.array([r.quality for r in out]), np.array([r.score for r in out])
    order = np.argsort(p)
    rank = np.empty(len(p))
    rank[order] = np.arange(len(p))
    good = y.sum()
    assert (rank[y == 1].sum() - good * (good - 1) / 2) / (good * (len(y) - good)) > 0.98
    assert (p[y == 1] >= 0.5).mean() > 0.98
    assert all(r.predicted == int(r.score >= 0.5) for r in out)


def test_quality_on_odd_rows(spark):
    labels = spark.createDataFrame([(i * 3, i % 2, None) for i in range(60)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(documents(spark), labels)
    out = quality.score(documents(spark), model).collect()
    assert len(out) == len(odd_documents()) and all(0 <= r.score <= 1 for r in out)
    none = quality.fit(documents(spark), labels.limit(0))
    assert {r.score for r in quality.score(documents(spark), none).collect()} == {0.5}


@pytest.mark.parametrize("apply", [
    lambda d: packing.pack_documents(d, tokenizer_path("word_bpe_49k.json")),
    exact.dedup_table,
    imatch.fingerprint_table,
    neardup.near_duplicates,
    lambda d: bpe.encode_decode(d, tokenizer_path("byte_bpe_50k.json")),
])
def test_empty_table(spark, apply):
    assert apply(spark.createDataFrame([], COLUMNS)).collect() == []

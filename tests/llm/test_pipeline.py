"""The pipeline's stages, one after the other, against plain Python on small tables."""

from collections import Counter

import xxhash

import corpus_pipeline
from utterlake.llm import pii, quality

from .fixtures import COLUMNS, documents, odd_documents
from .test_documents_ops import brute_components
from .test_lines import brute


def rows_of(df):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()]


def test_stages(spark):
    rows = [*odd_documents(140, seed=8), (9000, "write to a.b@c.de or +1 (555) 123-4567 " * 3, "en", "s", 0)]
    docs = documents(spark, rows)
    lines = corpus_pipeline.line_dedup(spark, docs, "").cache()
    assert set(lines.columns) == set(docs.columns)
    want = Counter()
    for (d, t, n, k), c in brute([(d, t) for d, t, *_ in rows], 32).items():
        if t.strip(" \n\t\r\x0b\x0c") or n == k:
            want[d, t] += c
    got = rows_of(lines)
    assert Counter((d, t or "") for d, t, *_ in got) == want
    assert any(t is None for _, t, *_ in got)

    near = corpus_pipeline.minhash_near_dedup(spark, lines, "").cache()
    assert near.columns == docs.columns
    named = [(2**62 + (xxhash.xxh64_intdigest(t or "", seed=42) >> 2) if d is None else d, t) for d, t, *_ in got]
    keep = {d for d, _, c in brute_components(named, 80) if d == c}
    want = Counter((d, t) for (own, t), (d, *_) in zip(named, got) if own in keep)
    assert Counter((d, t) for d, t, *_ in rows_of(near)) == Counter({k: 1 if k[0] is None else n for k, n in want.items()})

    clean = corpus_pipeline.pii(spark, near, "").cache()
    assert clean.columns == docs.columns
    assert Counter(rows_of(clean)) == Counter((d, t and pii.redact(t, pii.shown(pii.base_spans(t))), a, b, n if not t or not pii.base_spans(t) else len(pii.redact(t, pii.shown(pii.base_spans(t))))) for d, t, a, b, n in rows_of(near))
    assert "[EMAIL]" in {r[0]: r[1] for r in rows_of(clean)}[9000]

    packed = corpus_pipeline.best_fit_packing(spark, clean, "").collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r[0] for r in rows_of(clean))


def test_quality_stage(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = corpus_pipeline.quality_classifier(spark, docs, sf)
    assert kept.columns == docs.columns
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {d for d, s in scores.items() if s >= corpus_pipeline.LEAST_QUALITY}
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    assert sum(scores[d] >= 0.5 for d in good) > 0.97 * len(good)


def test_empty_input(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.minhash_near_dedup, corpus_pipeline.pii):
        assert stage(spark, docs, "").collect() == []

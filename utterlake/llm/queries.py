"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, clusters, exact, htmltext, imatch, jaccard, licenses, lines, neardup, packing, pii, quality, ranked
from .vocab import tokenizer_path


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_docs(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup_table(_docs(spark, sf_dir))


def op3_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_table(_docs(spark, sf_dir))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_docs(spark, sf_dir))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_docs(spark, sf_dir))


def op7_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_docs(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_docs(spark, sf_dir))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_docs(spark, sf_dir))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.best_documents(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(_docs(spark, sf_dir)).drop("n_links")


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_exact_dedup, op3_imatch_fingerprints, op4_quality_classifier, op5_line_dedup, op6_minhash_near_dedup, op7_bpe_encode_decode, op8_html_extraction, op9_license_scan, op10_pii, op11_ranked_search, op12_jaccard_join, op13_centroid_clusters)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
        # within one edit, one half of a line stays at a known place: the four keys of a line meet those of its partners
        "op5_line_dedup": """
            WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
            lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS line_no FROM split),
            firsts AS (SELECT line, min(doc_id * 1000000 + line_no) AS place FROM lines WHERE trim(line, ' \t\r\x0b\x0c') <> '' GROUP BY line),
            keys AS (SELECT *, unnest([length(line) || 'h' || left(line, length(line) // 2), length(line) || 't' || substr(line, length(line) // 2 + 1),
                (length(line) - 1) || 'h' || left(line, (length(line) - 1) // 2), (length(line) - 1) || 't' || substr(line, (length(line) - 1) // 2 + 2)]) AS k FROM firsts WHERE length(line) >= 31),
            late AS (SELECT DISTINCT b.place FROM keys a JOIN keys b ON a.k = b.k AND a.place < b.place WHERE greatest(length(a.line), length(b.line)) >= 32 AND levenshtein(a.line, b.line) <= 1),
            stay AS (SELECT place FROM firsts WHERE place NOT IN (SELECT place FROM late)),
            marked AS (SELECT l.*, trim(l.line, ' \t\r\x0b\x0c') = '' OR s.place IS NOT NULL AS kept FROM lines l LEFT JOIN stay s ON s.place = l.doc_id * 1000000 + l.line_no)
            SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE kept), '') AS text, count(*) AS n_lines, count(*) FILTER (WHERE kept) AS n_kept
            FROM marked GROUP BY doc_id""",
        "op6_minhash_near_dedup": """
            WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
            s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
            e AS (SELECT doc_id, unnest(sh) AS x FROM s),
            p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
            l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 85 * (len(x.sh) + len(y.sh) - c)),
            sym AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
            r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, sym.b FROM r JOIN sym ON r.c = sym.a)
            SELECT doc_id, CAST(len(any_value(sh)) AS BIGINT) AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM r JOIN s USING (doc_id) GROUP BY doc_id""",
        "op11_ranked_search": r"""
            WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
            tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
            n AS (SELECT doc_id, count(*) AS n FROM words GROUP BY ALL),
            total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM n),
            df AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term),
            asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
            m AS (SELECT doc_id, 10 + (90 * n * docs) // length AS m FROM n, total),
            scores AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN m USING (doc_id) GROUP BY ALL),
            ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
            SELECT * FROM ranked WHERE rank <= 10""",
        "op12_jaccard_join": """
            WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
            s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END AS sh FROM w),
            e AS (SELECT doc_id, unnest(sh) AS x FROM s),
            p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
            l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 90 * (len(x.sh) + len(y.sh) - c)),
            sym AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
            r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, sym.b FROM r JOIN sym ON r.c = sym.a)
            SELECT doc_id, CAST(len(any_value(sh)) AS BIGINT) AS n_shingles, min(c) AS component_id FROM r JOIN s USING (doc_id) GROUP BY doc_id""",
        "op13_centroid_clusters": """
            WITH RECURSIVE k AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
            x AS MATERIALIZED (SELECT vec_id, r, unnest(v) AS x, unnest(range(64)) AS i FROM k),
            f AS (SELECT v, row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c FROM k ORDER BY c LIMIT 16),
            c0 AS MATERIALIZED (SELECT c, unnest(range(64)) AS i, unnest(v) AS y FROM f),
            d1 AS MATERIALIZED (SELECT vec_id, r, c, sum((x - y) * (x - y)) AS d FROM x JOIN c0 USING (i) GROUP BY ALL),
            a1 AS MATERIALIZED (SELECT vec_id, r, arg_min(c, (d, c)) AS c FROM d1 GROUP BY ALL),
            s1 AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM a1 JOIN x USING (vec_id, r) GROUP BY ALL),
            c1 AS MATERIALIZED (SELECT o.c, o.i, coalesce((s - ((s % n) + n) % n) // n, y)::BIGINT AS y FROM c0 o LEFT JOIN s1 s ON o.c = s.c AND o.i = s.i),
            d2 AS MATERIALIZED (SELECT vec_id, r, c, sum((x - y) * (x - y)) AS d FROM x JOIN c1 USING (i) GROUP BY ALL),
            a2 AS MATERIALIZED (SELECT vec_id, r, arg_min(c, (d, c)) AS c FROM d2 GROUP BY ALL),
            s2 AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM a2 JOIN x USING (vec_id, r) GROUP BY ALL),
            c2 AS MATERIALIZED (SELECT o.c, o.i, coalesce((s - ((s % n) + n) % n) // n, y)::BIGINT AS y FROM c1 o LEFT JOIN s2 s ON o.c = s.c AND o.i = s.i),
            d3 AS MATERIALIZED (SELECT vec_id, r, c, sum((x - y) * (x - y)) AS d FROM x JOIN c2 USING (i) GROUP BY ALL),
            a3 AS MATERIALIZED (SELECT vec_id, r, arg_min(c, (d, c)) AS c FROM d3 GROUP BY ALL),
            s3 AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM a3 JOIN x USING (vec_id, r) GROUP BY ALL),
            c3 AS MATERIALIZED (SELECT o.c, o.i, coalesce((s - ((s % n) + n) % n) // n, y)::BIGINT AS y FROM c2 o LEFT JOIN s3 s ON o.c = s.c AND o.i = s.i),
            d AS (SELECT vec_id, r, c, sum((x - y) * (x - y))::BIGINT AS d FROM x JOIN c3 USING (i) GROUP BY ALL),
            a AS (SELECT vec_id, r, arg_min(c, (d, c)) AS c, min(d) AS d FROM d GROUP BY ALL),
            t AS (SELECT c, sum(d)::BIGINT AS t FROM a GROUP BY c),
            h AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY i)) AS h FROM c3 GROUP BY c)
            SELECT vec_id, c::INTEGER AS "cluster", d AS distance, t AS cluster_inertia, (SELECT sum(t)::BIGINT FROM t) AS inertia, h AS centroid_sha256 FROM a JOIN t USING (c) JOIN h USING (c)""",
    }

"""Ranked lexical search, a hybrid of term-at-a-time and document-at-a-time evaluation.

One pass over the documents writes, for each, its length and the query terms it holds.  Counts over that table
give the weights.  Then each task turns a run of documents into posting lists and answers all queries on it:

* short lists are read term at a time and summed into accumulators, which become one list with a bound;
* this list and the long ones go document at a time: windows of documents whose block bounds cannot reach the
  tenth best score so far are skipped, within the others only lists that could lift a document over it give
  candidates, and the rest are looked up for candidates that can still reach it.

The best of each task meet by query, in two steps, so no query's rows meet in one task.  All scores are 64-bit
integers, so every way of summing gives the same.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import cut, per_worker

#: Terms are runs of ASCII letters and digits and of everything beyond ASCII; only A-Z is lower-cased.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
TOP = 10
NO_ID = 2**63 - 1


def terms(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def query_terms(queries: DataFrame, id_col: str, text_col: str, block: int, blocks: int) -> list[tuple[int, list[bytes]]]:
    """(item_id, distinct terms) of one block of the queries."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    mine = F.pmod(F.xxhash64(F.col(id_col), text), F.lit(blocks)) == block
    rows = queries.filter(mine).select(F.col(id_col).cast("long").alias("item"), text.cast("binary").alias("text")).collect()
    return [(r["item"], sorted(set(terms(bytes(r["text"]))))) for r in rows]


HELD = "doc_id long, n long, terms array<int>, tfs array<int>"


def hold(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Of each row of (doc_id, text): its number of terms, and the query terms in it with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_worker(("ranked",), bool)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, ids, tfs, ends = [], array("i"), array("i"), [0]
                for t in part.column(1):
                    words = terms(t.as_py())
                    held = Counter(map(vocabulary.get, words))
                    held.pop(None, None)
                    n.append(len(words))
                    ids.extend(held.keys())
                    tfs.extend(held.values())
                    ends.append(len(ids))
                lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(x, np.int32) if len(x) else np.empty(0, np.int32))) for x in (ids, tfs))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, HELD)


class Lists:
    """Posting lists of one run of documents: by term, places in the run (ascending) and impacts."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, ends: np.ndarray, terms_: np.ndarray, tfs: np.ndarray, documents: int, length: int):
        rank = np.argsort(ids, kind="stable")
        self.ids = ids[rank]
        place = np.empty(len(ids), np.int64)
        place[rank] = np.arange(len(ids))
        # 10 + (90 * n * documents) div length, in whole numbers of any size
        m = np.array([10 + 90 * x * documents // length for x in n.tolist()], np.int64)
        row = np.repeat(np.arange(len(ids)), np.diff(ends))
        tf = tfs.astype(np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[row])
        order = np.lexsort((place[row], terms_))
        self.places, self.impacts = place[row][order], impact[order]
        held, starts = np.unique(terms_[order], return_index=True)
        self.at = dict(zip(held.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True), strict=True))

    def get(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = self.at.get(term, (0, 0))
        return self.places[lo:hi], self.impacts[lo:hi]


def accumulate(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Term at a time: lists of (places, scores) summed into one, by place."""
    places, scores = np.concatenate([p for p, _ in lists]), np.concatenate([s for _, s in lists])
    order = np.argsort(places, kind="stable")
    places, scores = places[order], scores[order]
    starts = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
    return places[starts], np.add.reduceat(scores, starts)


def search(index: Lists, query: list[tuple[int, int]], best: list[tuple[int, int]], top: int = TOP, share: int = 32, window: int = 1024) -> None:
    """Adds the documents of ``index`` to ``best``, a heap of the ``top`` (score, -doc_id) of a query of (term, weight).

    Lists of at most a ``share``-th of the documents are short.
    """
    size = len(index.ids)
    short, lists = [], []
    for term, weight in query:
        places, impacts = index.get(term)
        if len(places) and weight:
            (short if len(places) * share <= size else lists).append((places, impacts * weight))
    if short:
        lists.append(accumulate(short))
    if not lists:
        return
    edges = np.arange(0, size + window, window)
    cuts = [np.searchsorted(p, edges) for p, _ in lists]
    # largest score of each list in each window
    bounds = np.zeros((len(lists), len(edges) - 1), np.int64)
    for k, (at, (_, scores)) in enumerate(zip(cuts, lists, strict=True)):
        full = np.flatnonzero(at[1:] > at[:-1])
        bounds[k, full] = np.maximum.reduceat(scores, at[:-1][full])
    reach = bounds.sum(axis=0)
    for w in range(len(reach)):
        floor = best[0][0] if len(best) == top else 1
        if reach[w] < floor:
            continue
        # ascending bounds: lists whose bounds together stay under the floor give no candidates of their own
        order = np.argsort(bounds[:, w], kind="stable")
        order = order[bounds[order, w] > 0]
        sums = np.cumsum(bounds[order, w])
        first = int(np.searchsorted(sums, floor, "left"))
        parts = [(lists[k][0][cuts[k][w] : cuts[k][w + 1]], lists[k][1][cuts[k][w] : cuts[k][w + 1]]) for k in order]
        places, scores = accumulate(parts[first:])
        for k in range(first - 1, -1, -1):
            alive = scores + sums[k] >= floor
            places, scores = places[alive], scores[alive]
            if not len(places):
                break
            p, s = parts[k]
            found = np.minimum(np.searchsorted(p, places), len(p) - 1)
            scores = scores + np.where(p[found] == places, s[found], 0)
        alive = scores >= floor
        for p, s in zip(places[alive].tolist(), scores[alive].tolist(), strict=True):
            entry = (s, -int(index.ids[p]))
            if len(best) < top:
                heapq.heappush(best, entry)
            elif entry > best[0]:
                heapq.heapreplace(best, entry)


def answer(held: DataFrame, queries: list[tuple[int, list[tuple[int, int]]]], documents: int, length: int, top: int, run_postings: int) -> DataFrame:
    """The best of each task for each query: item, doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_worker(("ranked",), bool)
        best: list[list[tuple[int, int]]] = [[] for _ in queries]
        waiting, postings = [], 0

        def flush() -> None:
            table = pa.Table.from_batches(waiting).combine_chunks()
            ids = table.column(0).fill_null(NO_ID).to_numpy()
            columns = [table.column(k).combine_chunks() for k in (2, 3)]
            ends = np.r_[0, np.cumsum(columns[0].value_lengths().to_numpy())]
            index = Lists(ids, table.column(1).to_numpy(), ends, *(c.flatten().to_numpy() for c in columns), documents, length)
            for (_, query), heap in zip(queries, best, strict=True):
                search(index, query, heap, top)

        for batch in batches:
            waiting.append(batch)
            postings += len(batch.column(2).flatten())
            if postings >= run_postings:
                flush()
                waiting, postings = [], 0
        if waiting:
            flush()
        found = [(item, None if d == -NO_ID else -d, s) for (item, _), heap in zip(queries, best, strict=True) for s, d in heap]
        item, doc, score = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["item_id", "doc_id", "score"])

    return held.filter("size(terms) > 0").mapInArrow(run, "item_id long, doc_id long, score long")


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def best_documents(docs: DataFrame, queries: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", top: int = TOP, block_bytes: int = 16_000_000, run_postings: int = 2_000_000) -> DataFrame:
    """The ``top`` documents of each query: item_id, rank, doc_id, score; equal scores by doc_id, a null id last.

    Null and empty texts hold no terms and are not counted; queries without terms, or whose terms no document
    holds, give no rows.  Documents that repeat are each ranked, queries that repeat an id are one query of
    all their terms.  Queries are worked in blocks of at most about ``block_bytes`` of text, each against all
    documents.  Other columns are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    asked = queries.groupBy(F.col(item_col).alias("item_id")).agg(F.concat_ws(" ", F.sort_array(F.collect_list(query_col))).alias("query"))
    size = asked.agg(F.sum(F.octet_length("query"))).first()[0] or 0
    blocks, out = 1 + size // block_bytes, None
    for block in range(blocks):
        items = query_terms(asked, "item_id", "query", block, blocks)
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, ts in items for t in ts}))}
        held = cut(hold(source, vocabulary), "held")
        counts = held.filter("n > 0").agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
        df = {r["term"]: r["count"] for r in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}  # at most one row a query term
        weighted = [(item, [(vocabulary[t], weight(counts["documents"], df[vocabulary[t]])) for t in ts if vocabulary[t] in df]) for item, ts in items]
        found = answer(held, weighted, counts["documents"], counts["length"] or 1, top, run_postings)
        out = found if out is None else out.unionByName(found)
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    some = out.withColumn("i", F.row_number().over(W.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy(*order))).filter(F.col("i") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")

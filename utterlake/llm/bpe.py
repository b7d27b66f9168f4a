"""Byte-level BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens that a partition has not met before are laid out as one linked list of
symbols.  An index maps each mergeable pair to all its positions in that list; active ranks are
taken in ascending order, each pair's positions are merged from left to right, and the lists of the
pairs that appear are extended.  A merge only makes pairs of a higher rank, so one ascending pass
is the result.  Ids of known words come from a bounded cache, which is only a shortcut.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import per_worker

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
#: White space as the tokenizer's pattern has it.
SPACE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Fixed value: the public pre-token pattern of this vocabulary, with its white space spelled out.
PRE_TOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
DOUBLE_SPACE = regex.compile(rf"[{SPACE}][{SPACE}]")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: visible Latin-1
    characters stand for themselves, the other bytes take the code points from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    odd = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + odd.index(b)) for b in range(256)}


class PairIndexBpe:
    """Encoder and decoder over one vocabulary file."""

    def __init__(self, path: str, most: int = 1_000_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        back = {s: b for b, s in symbols.items()}
        self.first = [vocab[symbols[b]] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(back[c] for c in s) if s not in self.special else s.encode() for s, i in vocab.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.pair_at: list[tuple[int, int]] = []
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merge.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
            self.pair_at.append((vocab[a], vocab[b]))
        self.most = most
        self.words: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def merge_all(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece: one pair occurrence index over all of them."""
        if not pieces:
            return []
        merge, first = self.merge, self.first
        sym: list[int] = []
        starts: list[int] = []
        for p in pieces:
            starts.append(len(sym))
            sym += [first[b] for b in p]
            sym.append(-1)  # ends a piece; no pair holds it
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        where: dict[int, list[int]] = {}
        a = -1
        for i, b in enumerate(sym):
            if (m := merge.get((a, b))) is not None:
                where.setdefault(m[0], []).append(i - 1)
            a = b
        ranks = list(where)
        heapq.heapify(ranks)
        while ranks:
            rank = heapq.heappop(ranks)
            left, right = self.pair_at[rank]
            new = merge[left, right][1]
            for i in sorted(where.pop(rank)):
                if sym[i] != left or sym[j := after[i]] != right:
                    continue
                sym[i], sym[j] = new, -2
                k = after[i] = after[j]
                before[k] = i
                h = before[i]
                if h >= 0 and (m := merge.get((sym[h], new))) is not None:
                    if m[0] in where:
                        where[m[0]].append(h)
                    else:
                        where[m[0]] = [h]
                        heapq.heappush(ranks, m[0])
                if (m := merge.get((new, sym[k]))) is not None:
                    if m[0] in where:
                        where[m[0]].append(i)
                    else:
                        where[m[0]] = [i]
                        heapq.heappush(ranks, m[0])
        ends = [*starts[1:], n]
        return [[s for s in sym[x : y - 1] if s >= 0] for x, y in zip(starts, ends, strict=True)]

    def _learn(self, words: set[str]) -> None:
        """Puts the ids of words, each a run of whole pre-tokens, into the cache."""
        split = {w: PRE_TOKEN.findall(w) for w in words}
        new = list({t for ts in split.values() for t in ts}.difference(self.tokens))
        for t, ids in zip(new, self.merge_all([t.encode() for t in new]), strict=True):
            self.tokens[t] = np.asarray(ids, "<u4").tobytes()
        for w, ts in split.items():
            self.words[w] = b"".join(map(self.tokens.__getitem__, ts))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit words."""
        parts: list[list[str]] = []
        for text in texts:
            got: list[str] = []
            for k, plain in enumerate(self.split_special.split(text) if self.split_special else [text]):
                if k % 2:
                    got.append("\0" + plain)
                elif DOUBLE_SPACE.search(plain):
                    got += PRE_TOKEN.findall(plain)
                elif plain:
                    # without two white spaces in a row, a space and what follows it are whole pre-tokens
                    head, *rest = plain.split(" ")
                    got += [head] if head else []
                    got += [" " + w for w in rest]
            parts.append(got)
        need = set().union(*parts).difference(self.words)
        if len(self.words) + len(need) > self.most:
            self.words.clear()
            need = set().union(*parts)
        if len(self.tokens) > self.most:
            self.tokens.clear()
        special = {w for w in need if w[:1] == "\0" and w[1:] in self.special}
        self._learn(need - special)
        for w in special:
            self.words[w] = self.special[w[1:]].to_bytes(4, "little")
        return [b"".join(map(self.words.__getitem__, p)) for p in parts]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", errors="replace")


def in_groups(ids: list, texts: pa.Array, most_chars: int) -> Iterator[tuple[list, list[str]]]:
    """Rows of a batch in groups of about ``most_chars`` characters."""
    keys, group, size = [], [], 0
    for k, t in zip(ids, texts, strict=True):
        text = t.as_py()
        keys.append(k), group.append(text)
        size += len(text)
        if size >= most_chars:
            yield keys, group
            keys, group, size = [], [], 0
    if keys:
        yield keys, group


def encode_decode(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", group_chars: int = 4_000_000) -> DataFrame:
    """Encode and decode every text; returns doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no tokens and decode to the empty string.  No shuffle: rows are
    independent, repeated rows and null ids stay as they are, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = per_worker(("bpe", vocabulary), lambda: PairIndexBpe(vocabulary))
        for batch in batches:
            for keys, texts in in_groups(batch.column(0).to_pylist(), batch.column(1), group_chars):
                rows = [(k, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()) for k, ids in zip(keys, bpe.encode_many(texts), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return source.mapInArrow(run, SCHEMA)

"""Best-fit packing by hierarchical residual packing.

Each partition cuts its documents into pieces of at most ``seq_len`` tokens and packs them best-fit
in decreasing length.  Nearly full bins are final.  Underfull bins become items of the next round:
they are dealt anew to fewer tasks, packed best-fit as whole units, and so on until one task is left
or a round no longer saves bins.  A task never gets more than about ``bins_per_task`` bins, so the
last rounds stay small however many documents there are.
"""

from __future__ import annotations

import json
import math
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .store import cut, per_worker

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, done boolean"
ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("done", pa.bool_())])
#: White space for Python's split() but not for the tokenizer.
ODD_SPACE = "\x1c\x1d\x1e\x1f"


class Cache(dict):
    """A dictionary that makes what it lacks."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class WordIds:
    """Ids of a text as little-endian 32-bit words, by a cache of white-space separated words.

    The tokenizer drops white space and never looks across it, so a text's ids are those of its
    words, one after the other.  New words go to a byte-pair engine that merges by rank: the byte
    0xFF, which UTF-8 never holds, stands for the end-of-word mark and joins the last byte first.
    Words that hold a special token, and texts with odd white space, go to the tokenizer itself.
    The cache is emptied when it holds ``most`` words.
    """

    def __init__(self, path: str, most: int = 250_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        back = {s: bytes([b]) for b, s in byte_symbols().items()}
        raw = lambda s: b"".join(back[c] for c in s.removesuffix(suffix)) + b"\xff" * s.endswith(suffix)
        singles = [bytes([b]) for b in range(256)]
        ranks = {t: i for i, t in enumerate([*singles, *(t + b"\xff" for t in singles[:-1])])}
        for m in model["merges"]:
            x, y = m.split(" ") if isinstance(m, str) else m
            ranks.setdefault(raw(x + y), len(ranks))
        ids = np.full(len(ranks), -1, np.int64)
        for token, i in model["vocab"].items():
            if (rank := ranks.get(raw(token))) is not None:
                ids[rank] = i
        encoding = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.normal = self.tok.normalizer.normalize_str
        self.special = [t["content"] for t in spec["added_tokens"]]
        pieces, ids = encoding._core_bpe.encode_single_piece, ids.tolist().__getitem__
        self.most, self.known = most, Cache(self._word)
        self.parts = Cache(lambda part: array("I", map(ids, pieces(part.encode() + b"\xff"))).tobytes())

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if "<|" in word and any(s in word for s in self.special):
            return self._whole(word)
        # Latin-1 letters are in normal form and lower-cased alike everywhere
        return b"".join(map(self.parts.__getitem__, self.split(word.lower() if word.isascii() or max(word) < "\u0100" else self.normal(word))))

    def __call__(self, text: str) -> bytes:
        if any(c in text for c in ODD_SPACE):
            return self._whole(text)
        for cache in (self.known, self.parts):
            if len(cache) > self.most:
                cache.clear()
        return b"".join(map(self.known.__getitem__, text.split()))


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, fill of each bin.

    Open bins are kept by their room in stacks; a bit mask of the rooms in use finds the smallest
    room that holds an item.
    """
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    fills: list[int] = []
    mask = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        if fits := mask >> size:
            room = size + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        left = room - size
        if left:
            rooms[left].append(b)
            mask |= 1 << left
    return bins, offsets, np.asarray(fills, np.int64)


def _new_ids(n: int, level: int) -> np.ndarray:
    """Bin numbers that no other task or round gives."""
    return (level << 56) + (TaskContext.get().partitionId() << 28) + np.arange(n, dtype=np.int64)


def _first_round(path: str, seq_len: int, end_id: int, slack: int):
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = per_worker(("words", path), lambda: WordIds(path))
        doc, piece, start, length, crc = [], [], [], [], []
        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(encode(text.as_py()) + end)
                n = len(ids) // 4
                for k, s in enumerate(range(0, n, seq_len)):
                    part = ids[4 * s : 4 * (s + seq_len)]
                    doc.append(d), piece.append(k), start.append(s), length.append(len(part) // 4), crc.append(zlib.crc32(part))
        if not doc:
            return
        sizes = np.asarray(length, np.int64)
        # ties of length in a fixed order, so that a task run again packs alike
        order = np.lexsort((np.asarray(crc), np.asarray(piece), np.asarray([-1 if d is None else d for d in doc])))
        bins, offsets, fills = best_fit(sizes[order], seq_len)
        take = order.tolist()
        pick = lambda xs, kind: pa.array([xs[i] for i in take], kind)
        yield pa.RecordBatch.from_arrays([pick(doc, pa.int64()), pick(piece, pa.int32()), pick(start, pa.int64()), pick(length, pa.int64()), pick(crc, pa.int64()), pa.array(_new_ids(len(fills), 0)[bins]), pa.array(offsets), pa.array(fills[bins] >= seq_len - slack)], schema=ARROW)

    return run


def _next_round(seq_len: int, slack: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (got := [b for b in batches if b.num_rows]):
            return
        table = pa.Table.from_batches(got).sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).combine_chunks()
        old, length, offset = (table[c].to_numpy() for c in ("sequence_id", "length", "offset"))
        _, unit = np.unique(old, return_inverse=True)
        fill = np.zeros(unit.max() + 1, np.int64)
        np.maximum.at(fill, unit, offset + length)
        bins, shift, fills = best_fit(fill, seq_len)
        b = bins[unit]
        out = [table[c].combine_chunks() for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        yield pa.RecordBatch.from_arrays([*out, pa.array(_new_ids(len(fills), level)[b]), pa.array(offset + shift[unit]), pa.array(fills[b] >= seq_len - slack)], schema=ARROW)

    return run


def pack_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", seq_len: int = 2048, end_id: int = 0, slack: int = 16, bins_per_task: int = 4096) -> DataFrame:
    """Pack documents into sequences of at most ``seq_len`` tokens.

    A document is its tokens and then ``end_id``; only longer ones are cut.  Returns per piece:
    doc_id, piece, start, length, ids_crc32, sequence_id, offset.  Null and empty texts are the end
    id alone.  Null ids and repeated rows are packed like any other; other columns are not read.
    An empty table gives no rows.  Every piece is placed: ``slack`` only says when a bin counts as
    nearly full, and ``bins_per_task`` how many underfull bins a task of a later round gets.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    now = cut(source.mapInArrow(_first_round(tokenizer, seq_len, end_id, slack), SCHEMA), "pack0")
    final: list[DataFrame] = []
    left = now.filter("not done and offset = 0").count()
    level = 0
    while left > 1:
        level += 1
        final.append(now.filter("done"))
        rest = now.filter("not done")
        tasks = math.ceil(left / bins_per_task)
        now = cut(rest.repartition(tasks, "sequence_id").mapInArrow(_next_round(seq_len, slack, level), SCHEMA), f"pack{level}")
        before, left = left, now.filter("not done and offset = 0").count()
        if tasks == 1 or left > 0.99 * before:
            break
    final.append(now)
    out = final[0]
    for more in final[1:]:
        out = out.unionByName(more)
    return out.drop("done")

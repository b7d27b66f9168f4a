"""Ordered folds: rows of a key in order, one at a time, with bounded state.

Rows are dealt by key, sorted within partitions and streamed through Arrow batches; a key's state is
carried from batch to batch.  No key is ever gathered, so a source with a third of all rows costs
time in its task but not memory.  Of a batch only ``SLICE`` rows at a time are Python objects, which
take many times what they do in Arrow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


#: Rows that are Python objects at a time.
SLICE = 200


def sliced(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches in parts of a few rows, without a copy."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


class Fold(Protocol):
    """State of one key."""

    def push(self, row: dict) -> Iterable[tuple]: ...

    def close(self) -> Iterable[tuple]: ...


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[dict], Fold], schema: str, batch: int = 10_000) -> DataFrame:
    """Output rows of one fold per key; ``start`` makes the state from a key's first row.  ``batch`` rows go out at a time: few, if rows are long."""
    kind: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fold, out = None, None, []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        for b in sliced(batches):
            for row in b.to_pylist():
                key = tuple(row[k] for k in keys)
                if fold is None or key != held:
                    if fold is not None:
                        out += fold.close()
                    held, fold = key, start(row)
                out += fold.push(row)
                if len(out) >= batch:
                    yield made()
                    out.clear()
        if fold is not None:
            out += fold.close()
        if out:
            yield made()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)

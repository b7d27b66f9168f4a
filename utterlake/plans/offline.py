"""Offline transcription as one Spark job, around a decoder that the caller gives.

Durations and silences give chunk plans; planned chunks are decoded side by side under the coverage guard; chunks
of a recording are settled in order; text and words are normalised and cut into sentences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions import boundary, numbers, tokensync
from ..functions.segments import clean_segments
from ..functions.text import clean_fillers
from ..operators import guard, planner, stitch
from ..operators.planner import SplitConfig
from ..operators.segments import transcript_segments
from ..store import written

WORDS = guard.WORDS


class Decoder(Protocol):
    """The speech model: text and words (times from the slice's start) of a slice of a recording."""

    def __call__(self, source: int, start: float, end: float) -> tuple[str, list[boundary.Word]]: ...


def decoding(make: Callable[[], Decoder], key: str) -> guard.Decode:
    """A decoder over tables of slices (``key``, start, end, ...): one per task, made where it is used."""

    def decode(slices: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            call = make()
            for b in batches:
                got = [call(k, s, e) for k, s, e in zip(b[key], b["start"], b["end"], strict=True)]
                yield b.assign(text=[t for t, _ in got], words=[[{"word": w, "start": s, "end": e} for w, s, e in ws or ()] for _, ws in got])

        return slices.mapInPandas(run, StructType([*slices.schema.fields, *_parse_datatype_string(f"text string, words {WORDS}").fields]))

    return decode


def transcripts(durations: DataFrame, silences: DataFrame, make: Callable[[], Decoder], key: str, cfg: SplitConfig = SplitConfig()) -> DataFrame:
    """One row per recording: text, words, after stitching and normalisation."""
    decoded = written(guard.guard(planner.chunk_plans(durations, silences, key, cfg), silences, key, decoding(make, key)), "decoded")
    stitched = stitch.stitch(decoded, key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, words = [], []
            for text, ws in zip(b["text"], b["words"], strict=True):
                held = [(w["word"], w["start"], w["end"]) for w in ws]
                raw = boundary.joined(held)
                texts.append(numbers.to_digits(text))
                words.append([{"word": w, "start": s, "end": e} for w, s, e in tokensync.sync_to_rewrite(held, numbers.to_digits(raw))])
            yield b.assign(text=texts, words=words)

    return stitched.mapInPandas(run, f"{key} long, text string, words {WORDS}").withColumn("text", clean_fillers(F.col("text")))


def segments(done: DataFrame, key: str = "rec") -> DataFrame:
    """Segments of transcripts with the fields of a result file, without hesitation sounds; the speaker is always null."""
    return clean_segments(transcript_segments(done, [key], "words", "text"), [key])


def write_segments(rows: DataFrame, path: str) -> None:
    """JSON files that keep null fields."""
    rows.write.option("ignoreNullFields", "false").mode("overwrite").json(path)

"""Fillers taken out of finished segments, their character times kept."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

from .text import SENTENCE_END, clean_fillers

CHARS = ArrayType(StructType().add("text", StringType()).add("start", DoubleType()).add("end", DoubleType()))


def kept_chars(chars: list[dict], text: str, clean: str) -> list[dict]:
    """What of the timed pieces of ``text`` a shorter text still has; none if a piece is not in the text."""
    left = [False] * len(text)
    for at, _, n in SequenceMatcher(None, text, clean, autojunk=False).get_matching_blocks():
        left[at : at + n] = [True] * n
    out, at = [], 0
    for c in chars:
        at = text.find(c["text"], at)
        if at < 0:
            return []
        piece = "".join(x for x, stays in zip(c["text"], left[at:], strict=False) if stays)
        at += len(c["text"])
        if piece:
            out.append({"text": piece, "start": c["start"], "end": c["end"]})
    return out


@F.pandas_udf(CHARS)
def _kept(chars: pd.Series, text: pd.Series, clean: pd.Series) -> pd.Series:
    return pd.Series([kept_chars(list(c if c is not None else ()), t, n) for c, t, n in zip(chars, text, clean, strict=True)], dtype=object)


def clean_segments(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments (``keys``, index, start, end, text, punctuation, chars, ...) with cleaned text.

    Empty ones go and the rest are numbered anew from 1.  Only segments that change lose characters, and take
    start and end from those that are left; the others need no worker.
    """
    rows = segments.withColumn("clean", clean_fillers(F.col("text"))).filter(F.coalesce(F.col("clean"), F.lit("")) != "")
    same, other = rows.filter(F.col("clean") == F.col("text")), rows.filter(F.col("clean") != F.col("text"))
    other = other.withColumn("chars", _kept("chars", "text", "clean"))
    some = F.size("chars") > 0
    other = other.withColumn("start", F.when(some, F.element_at("chars", 1)["start"]).otherwise(F.col("start"))).withColumn("end", F.when(some, F.element_at("chars", -1)["end"]).otherwise(F.col("end")))
    other = other.withColumn("punctuation", F.regexp_extract("clean", f"[{SENTENCE_END}]*$", 0))
    found = same.unionByName(other).withColumn("text", F.col("clean")).drop("clean")
    return found.withColumn("index", F.row_number().over(W.partitionBy(*keys).orderBy("index")).cast("long"))

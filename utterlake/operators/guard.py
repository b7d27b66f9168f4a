"""Coverage guard: chunks whose decoded text does not account for the speech in them are decoded again.

The guard runs in waves over all chunks of all recordings, not chunk by chunk: what speech statistics call for in
one wave is decoded side by side in the next, and each wave is written once, so a lost executor repeats no
decoder call of an earlier wave.

1. Tails with next to no speech are not decoded at all.
2. Chunks without text that hold speech are decoded once more, and then as shorter slices (``rescue``).
3. Chunks whose words end well before the speech does get their end decoded again, from a second before the last
   word; if that gives nothing, as shorter slices.  What the chunk said already is taken out.
4. Short texts of tails that none of this confirmed are dropped.

A decoder is a function from slices (key, start, end, attempt) to the same rows with text and words, whose times
count from the slice's start.  ``attempt`` tells the calls for one chunk apart: 0 first, 1 again, 2 in
slices, 3 its end, 4 its end in slices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import boundary as B
from ..functions.text import has_content
from ..store import written
from . import stitch
from .fold import SLICE, ordered_fold
from .packets import hallucinated
from .planner import SplitConfig, chunk_plans

Decode = Callable[[DataFrame], DataFrame]

WORDS = "array<struct<word:string,start:double,end:double>>"
NO_WORDS = f"cast(array() as {WORDS})"
#: Seconds.  A tail is skipped below both of these.
SKIP_SPEECH, SKIP_LONGEST = 0.30, 0.20
#: Speech that an empty text cannot be; speech behind the last word that is too much, at any share and at a half.
EMPTY_SPEECH, TAIL_SPEECH, TAIL_SHARED, TAIL_SHARE = 2.0, 1.5, 1.0, 0.5
#: How far a rescue reaches back before the last word, and how early its words may start.
REACH_BACK, TOLERANCE = 1.0, 0.1
#: Slices of a rescue, and up to where a slice is decoded as it is.
LONGEST_SLICE = 20.0
BUCKET = 60.0


def speech(spans: DataFrame, silences: DataFrame, key: str, span: list[str], start: str, end: str) -> DataFrame:
    """Of each span (key and ``span``, ``start``, ``end``) the seconds of speech, the longest stretch, and the share.

    Spans and silences (key, start, end; apart from each other) meet in buckets of a minute, each pair in
    the first bucket that they share.  Spans are chunks, so one holds few silences.
    """
    buckets = lambda a, b: F.explode(F.sequence(F.floor(a / BUCKET), F.floor(F.greatest(a, b) / BUCKET)))
    one = spans.select(key, *span, F.col(start).alias("from_"), F.col(end).alias("to_"))
    left = one.withColumn("bucket", buckets(F.col("from_"), F.col("to_")))
    right = silences.select(F.col(key).alias("key_"), F.col("start").alias("s_"), F.col("end").alias("e_")).withColumn("bucket_", buckets(F.col("s_"), F.col("e_")))
    first = F.floor(F.greatest("from_", "s_") / BUCKET)
    lo, hi = F.greatest("from_", "s_"), F.least("to_", "e_")
    met = left.join(right, (F.col(key) == F.col("key_")) & (F.col("bucket") == F.col("bucket_")) & (F.col("bucket") == first) & (hi > lo))
    quiet = met.groupBy(key, *span).agg(F.array_sort(F.collect_list(F.struct(lo.alias("lo"), hi.alias("hi")))).alias("quiet"))
    every = one.join(quiet, [key, *span], "left").withColumn("quiet", F.coalesce("quiet", F.expr("cast(array() as array<struct<lo:double,hi:double>>)")))
    sums = F.aggregate("quiet", F.struct(F.lit(0.0).alias("covered"), F.lit(0.0).alias("longest"), F.col("from_").alias("at")), lambda a, x: F.struct((a["covered"] + x["hi"] - x["lo"]).alias("covered"), F.greatest(a["longest"], x["lo"] - a["at"]).alias("longest"), F.greatest(a["at"], x["hi"]).alias("at")))
    total = F.greatest(F.lit(0.0), F.col("to_") - F.col("from_"))
    heard = F.greatest(F.lit(0.0), total - F.col("a.covered"))
    share = F.when(total > 0, F.round(heard / total, 3)).otherwise(0.0)
    found = every.withColumn("a", sums)
    return found.select(key, *span, F.round(heard, 3).alias("speech"), F.when(total > 0, F.round(F.greatest("a.longest", F.col("to_") - F.col("a.at")), 3)).otherwise(0.0).alias("longest"), share.alias("share"))


class _Slices:
    """Pieces of one slice, settled one after the other; its words count only if every piece with text has some."""

    def __init__(self, row: dict, eps: float):
        self.id, self.eps, self.text, self.last, self.words, self.lacks = row["slice"], eps, "", "", (), False

    def push(self, row: dict) -> Iterator[tuple]:
        heard = stitch.Piece(row["text"] or "", tuple((w["word"], w["start"], w["end"]) for w in row["words"] or ()))
        piece = stitch.settle(heard, stitch.Chunk(row["audio_start"], row["audio_end"], row["drop_before"], row["kind"] == "hard", self.eps), self.last)
        if piece.text:
            self.text, self.last = self.text + piece.text, piece.text
            ours, theirs = stitch.seam(stitch.Piece("", self.words), stitch.Piece("", piece.words))
            self.words, self.lacks = ours.words + theirs.words, self.lacks or not piece.words
        return iter(())

    def close(self) -> Iterator[tuple]:
        held = () if self.lacks else self.words
        yield self.id, self.text, [{"word": w, "start": s, "end": e} for w, s, e in held]


def rescue(slices: DataFrame, silences: DataFrame, key: str, decode: Decode, attempt: int, longest: float = LONGEST_SLICE) -> DataFrame:
    """Slices (key, slice, start, end) decoded in shorter ones: slice, text, words (from the slice's start).

    A slice of up to one and a half times ``longest`` is decoded as it is.  Others are planned anew as
    recordings of their own, with the silences inside them, and the pieces are settled against each other.
    """
    cfg = replace(SplitConfig(), target=0.75 * longest, search=0.25 * longest, max_chunk=longest)
    total = F.col("end") - F.col("start")
    short = decode(slices.filter(total <= 1.5 * longest).select(key, "slice", "start", "end", F.lit(attempt).alias("attempt"))).select("slice", "text", "words")
    long_ = slices.filter(total > 1.5 * longest)
    inner = long_.select(key, "slice", F.col("start").alias("from_"), F.col("end").alias("to_")).join(silences, key).filter((F.col("end") > F.col("from_")) & (F.col("start") < F.col("to_")))
    local = inner.select("slice", F.greatest(F.lit(0.0), F.col("start") - F.col("from_")).alias("start"), F.least(F.col("to_") - F.col("from_"), F.col("end") - F.col("from_")).alias("end"))
    plans = chunk_plans(long_.select("slice", total.alias("duration")), local, "slice", cfg)
    asked = plans.join(long_.select(key, "slice", F.col("start").alias("from_")), "slice")
    asked = asked.select(key, "slice", "chunk", "kind", "drop_before", "audio_start", "audio_end", (F.col("from_") + F.col("audio_start")).alias("start"), (F.col("from_") + F.col("audio_end")).alias("end"), F.lit(attempt).alias("attempt"))
    return short.unionByName(ordered_fold(decode(asked), ["slice"], ["chunk"], lambda row: _Slices(row, 0.15), f"slice long, text string, words {WORDS}", SLICE))


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    return written(rows.withColumn("slice", F.monotonically_increasing_id()), name)


@F.pandas_udf(StringType())
def _new_text(before: pd.Series, text: pd.Series) -> pd.Series:
    """A rescued text without words, less what its chunk said already."""
    return pd.Series([B.rescue_dedup([], t, b, 0.0)[0] for b, t in zip(before, text, strict=True)], dtype=object)


def _moved(words: str, by: Column) -> Column:
    return F.transform(words, lambda w: F.struct(w["word"].alias("word"), F.round(w["start"] + by, 3).alias("start"), F.round(w["end"] + by, 3).alias("end")))


def guard(plans: DataFrame, silences: DataFrame, key: str, decode: Decode) -> DataFrame:
    """Decoded chunks: the plan's columns, text, words (from the chunk's start), status, passed (statuses on the way), speech.

    ``plans`` is of :func:`planner.chunk_plans`; ``silences`` has key, start, end.
    """
    base = [key, "chunk"]
    plan = [*base, "audio_start", "audio_end", "kind", "drop_before"]
    sil = silences.select(key, F.col("start").cast("double"), F.col("end").cast("double"))
    heard = written(plans.select(*plan).join(speech(plans, sil, key, ["chunk"], "audio_start", "audio_end"), base), "heard")
    skipped = (F.col("kind") == "tail") & (F.col("speech") < SKIP_SPEECH) & (F.col("longest") < SKIP_LONGEST)
    none, blank = F.expr(NO_WORDS), F.lit("")
    call = lambda rows, start, end, attempt: decode(rows.withColumn("start", start).withColumn("end", end).withColumn("attempt", F.lit(attempt)))
    clean = lambda rows: rows.withColumn("text", F.coalesce("text", blank)).withColumn("words", F.coalesce("words", none))
    bounds = (F.col("audio_start"), F.col("audio_end"))

    # once, and once more where there is speech and no text
    first = written(clean(call(heard.filter(~skipped), *bounds, 0)).drop("start", "end", "attempt"), "first")
    empty, loud = F.col("text") == "", F.col("speech") >= EMPTY_SPEECH
    silent = first.filter(empty & ~loud).withColumn("passed", F.array(F.lit("EMPTY_OK")))
    spoken = first.filter(~empty).withColumn("passed", F.array(F.lit("ok")))
    again = _numbered(clean(call(first.filter(empty & loud).drop("text", "words"), *bounds, 1)), "again")
    retried = again.filter(~empty).withColumn("passed", F.array(F.lit("SUSPICIOUS_EMPTY_EOS"), F.lit("RESCUED_EMPTY_RETRY")))
    failed = again.filter(empty).drop("text", "words")
    cut_up = failed.join(clean(rescue(failed.select(key, "slice", "start", "end"), sil, key, decode, 2)), "slice")
    told = F.array(F.lit("SUSPICIOUS_EMPTY_EOS"), F.lit("EMPTY_RETRY_FAILED"), F.when(F.col("text") != "", "RESCUED_EMPTY_SPLIT").otherwise("EMPTY_VAD_FALSE_POSITIVE"))
    shown = [*plan, "speech", "text", "words", "passed"]
    out = written(spoken.select(*shown).unionByName(silent.select(*shown)).unionByName(retried.select(*shown)).unionByName(cut_up.withColumn("passed", told).select(*shown)), "covered")

    # the end again, where speech goes on behind the last word
    last = F.col("audio_start") + F.array_max(F.transform("words", lambda w: w["end"]))
    worded = out.filter((F.col("text") != "") & (F.size("words") > 0)).select(*plan, "text", last.alias("last"))
    behind = speech(worded, sil, key, ["chunk"], "last", "audio_end")
    odd = (F.col("speech") >= TAIL_SPEECH) | (F.col("speech") >= TAIL_SHARED) & (F.col("share") >= TAIL_SHARE)
    ends = worded.join(behind.filter(odd).select(*base), base).withColumn("start", F.greatest("audio_start", F.col("last") - REACH_BACK)).withColumn("end", F.col("audio_end"))
    once = _numbered(clean(decode(ends.select(*base, "audio_start", "last", F.col("text").alias("before"), "start", "end", F.lit(3).alias("attempt")))), "ends")
    open_ = once.filter(empty).drop("text", "words")
    twice = open_.join(clean(rescue(open_.select(key, "slice", "start", "end"), sil, key, decode, 4)), "slice")
    got = once.filter(~empty).withColumn("sliced", F.lit(False)).unionByName(twice.withColumn("sliced", F.lit(True)).select(*once.columns, "sliced"))
    placed = got.withColumn("words", _moved("words", F.col("start") - F.col("audio_start")))
    since = F.col("last") - F.col("audio_start") - TOLERANCE
    fresh = F.filter("words", lambda w: w["start"] >= since)
    said = F.array_join(F.transform(fresh, lambda w: w["word"]), "")
    timed = placed.filter(F.size("words") > 0).select(*base, "sliced", F.lit(True).alias("any"), fresh.alias("more_words"), said.alias("more"))
    untimed = placed.filter(F.size("words") == 0).select(*base, "sliced", (F.col("text") != "").alias("any"), none.alias("more_words"), _new_text("before", "text").alias("more"))
    ended = timed.unionByName(untimed)
    new = has_content(F.col("more"))
    outcome = F.when(~F.col("any"), "TAIL_VAD_FALSE_POSITIVE").when(F.col("sliced"), F.when(new, "RESCUED_TAIL_SPLIT").otherwise("TAIL_SPLIT_RESCUE_NO_NEW_TEXT")).otherwise(F.when(new, "RESCUED_TAIL").otherwise("TAIL_RESCUE_NO_NEW_TEXT"))
    ended = ended.select(*base, outcome.alias("outcome"), F.when(new, F.col("more")).otherwise("").alias("more"), F.when(new, F.col("more_words")).otherwise(none).alias("more_words"))

    rows = out.join(ended, base, "left")
    rows = rows.withColumn("text", F.concat("text", F.coalesce("more", blank))).withColumn("words", F.concat("words", F.coalesce("more_words", none)))
    rows = rows.withColumn("passed", F.when(F.col("outcome").isNull(), F.col("passed")).otherwise(F.concat("passed", F.array(F.lit("PREMATURE_EOS"), "outcome"))))
    status = F.element_at("passed", -1)
    drop = hallucinated(F.col("kind"), status, F.col("speech"), F.col("text"))
    rows = rows.withColumn("passed", F.when(drop, F.concat("passed", F.array(F.lit("TAIL_HALLUCINATION_DROP")))).otherwise(F.col("passed")))
    dropped = status == "TAIL_HALLUCINATION_DROP"
    rows = rows.withColumn("text", F.when(dropped, "").otherwise(F.col("text"))).withColumn("words", F.when(dropped, none).otherwise(F.col("words")))
    gone = heard.filter(skipped).select(*plan, "speech", blank.alias("text"), none.alias("words"), F.array(F.lit("SKIP_TAIL_LOW_VAD")).alias("passed"))
    return rows.select(*shown).unionByName(gone).withColumn("status", status)

"""Arithmetic of packets and partials, as column expressions: no Python per row, no state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Sample rates that a client may send.
RATES = (8000, 16000)
#: Fixed value: what a decoder leaves where it was stopped.
ABORTED = "====解码有误，强制熔断===="
#: Outcomes of a tail's rescue that added nothing; speech and text up to which such a tail is dropped.
NOTHING_NEW = ("TAIL_VAD_FALSE_POSITIVE", "TAIL_RESCUE_NO_NEW_TEXT", "TAIL_SPLIT_RESCUE_NO_NEW_TEXT")
LEAST_SPEECH, SHORT_TEXT = 0.40, 20


def slice_bounds(start: Column, end: Column, size: Column, rate: Column | int) -> tuple[Column, Column]:
    """First and end sample of a slice in seconds, rounded (half to even) and kept inside the signal."""
    inside = lambda x, low: F.greatest(low, F.least(F.rint(x * rate).cast("long"), size))
    first = inside(start, F.lit(0).cast("long"))
    return first, inside(end, first)


def fresh_samples(size: Column, audio_start: Column, commit: Column, rate: Column | int) -> Column:
    """Samples of a buffer that the utterance owns, without the context it repeats."""
    context = F.greatest(F.lit(0).cast("long"), F.rint((commit - audio_start) * rate).cast("long"))
    return size - F.least(size, context)


def retied(overlap: Column, following: Column, stream: Column, rate: int) -> tuple[Column, Column]:
    """Start of a buffer that ends with the stream, and the end of the overlap at its head, in seconds."""
    origin = F.greatest(F.lit(0.0), (stream - overlap - following) / rate)
    return origin, origin + overlap / rate


def rejected(rate: Column, size: Column) -> Column:
    """Why an upload or stream is not taken; null if it is."""
    return F.when(~rate.isin(*RATES), "UNSUPPORTED_SAMPLE_RATE").when(F.coalesce(size, F.lit(0)) <= 0, "EMPTY_AUDIO")


def pre_roll(packets: DataFrame, key: str, order: list[str], length: str, level: str, keep: int) -> DataFrame:
    """Of each packet: how much the ring of the last ``keep`` holds, how much of it came before, and the loudest of that."""
    run = W.partitionBy(key).orderBy(*order)
    ends = packets.withColumn("end_", F.sum(length).over(run.rowsBetween(W.unboundedPreceding, W.currentRow)))
    start = F.col("end_") - F.col(length)
    before = W.partitionBy(key).orderBy("end_").rangeBetween(-keep, -1)
    out = ends.withColumn("ring", F.least(F.lit(keep), "end_")).withColumn("unused", F.greatest(F.lit(0), F.least(F.lit(keep), "end_") - F.col(length)))
    return out.withColumn("loudest_before", F.max(level).over(before)).withColumn("start", start).drop("end_")


def partial_blocks(size: Column, cap: int) -> Column:
    """Blocks of a growing utterance: whole ones of ``cap``, then the open one; none overlap."""
    last = F.floor((size - 1) / cap).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((k * cap).alias("start"), F.least((k + 1) * cap, size).alias("end"), ((k + 1) * cap <= size).alias("complete")))
    return F.when(size > 0, blocks)


def current_partials(messages: DataFrame, session: str, utt: str, kind: str, at: str, batch: int) -> DataFrame:
    """Of the partials of each batch of time and utterance the last, unless a final of it or of a later one came by then."""
    rows = messages.withColumn("batch", F.floor(F.col(at) / batch).cast("long"))
    final = W.partitionBy(session).orderBy("batch").rangeBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("done", F.max(F.when(F.col(kind) == "final", F.col(utt))).over(final))
    open_ = rows.filter((F.col(kind) == "partial") & (F.col("done").isNull() | (F.col("done") < F.col(utt))))
    return open_.groupBy(session, "batch", utt).agg(F.max(at).alias(at))


def without_abort(text: Column) -> Column:
    """Without the mark of a stopped decoder, and white space at either end."""
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit(ABORTED), F.lit("")), r"(?U)^\s+|\s+\z", "")


def hallucinated(kind: Column, status: Column, speech: Column, text: Column) -> Column:
    """Whether a tail's short text on next to no speech, which no rescue confirmed, is to be dropped."""
    return (kind == "tail") & status.isin(*NOTHING_NEW) & (speech < LEAST_SPEECH) & (F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+\z", "")) <= SHORT_TEXT)

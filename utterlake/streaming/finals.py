"""Realtime finals: what a decoder says of an utterance to the message that goes out, in order.

What depends on the final before (overlap, fallback, echo, the prefix that is carried on) is a fold with
one short string of state.  Numbers, the lexicon and hesitation sounds then work on each final by itself, and
its words follow the rewritten text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import boundary as B
from ..functions import hotwords, numbers, tokensync
from ..functions.text import SENTENCE_END, clean_fillers
from ..operators.fold import ordered_fold
from ..sources import lexicons

#: Characters that are carried on as prefix, and the shortest final that gives one.
CARRY, LEAST = 16, 4
WORDS = "array<struct<word:string,start:double,end:double>>"
SETTLED = f"session_id long, utt long, raw string, start double, end double, words {WORDS}, dropped string"


def carried(text: str) -> str | None:
    """The prefix that a final leaves to the next one, or none if it is too short."""
    text = text.strip()
    if len(text.rstrip(SENTENCE_END)) < LEAST:
        return None
    return text[-CARRY:] if any("一" <= c <= "鿿" for c in text) else " ".join(text.split()[-CARRY:])


class Finals:
    """State of a session: the prefix that its last final left."""

    def __init__(self, session: int):
        self.session, self.prefix = session, ""

    def push(self, row: dict) -> list[tuple]:
        words = [(w["word"], w["start"], w["end"]) for w in row["words"] or ()]
        got = B.settle_final(words, row["text"] or "", row["audio_start"], row["duration"], row["commit"], row["drop_before"], self.prefix)
        text, kept = got.text, got.words
        if row["reason"] in ("hard_cut", "soft_cut"):
            text = B.without_forced_stop(text)
            kept = B.words_of(kept, text)
        if not text:
            text = B.fallback_final(row["text"] or "", "", row["partial"] or "", self.prefix, row["drop_before"])
            kept = []
        if B.is_leftover(self.prefix, text):
            return [(self.session, row["utt"], None, got.start, got.end, [], "echo" if B.sound(row["text"]) else "empty")]
        start, end = (max(row["commit"], kept[0][1]), kept[-1][2]) if kept else (got.start, got.end)
        self.prefix = carried(text) or self.prefix
        return [(self.session, row["utt"], text, start, end, [{"word": w, "start": s, "end": e} for w, s, e in kept], None)]

    def close(self) -> list[tuple]:
        return []


def settle(finals: DataFrame) -> DataFrame:
    """Of each final what is new in it (raw, start, end, words), or why it is dropped.

    ``finals``: session_id, utt, reason, text, words, audio_start, duration, commit, drop_before, partial.
    """
    return ordered_fold(finals, ["session_id"], ["utt"], lambda row: Finals(row["session_id"]), SETTLED)


def finish(settled: DataFrame, terms: list[hotwords.Term], least: float = 0.85) -> DataFrame:
    """Numbers, then the lexicon, then hesitation sounds: session_id, utt, text, start, end, words, dropped.

    A dropped final keeps its row with a null text, so that ordered output knows that it will not come.
    """
    rows = settled.withColumn("text", numbers.normalise(F.col("raw")))
    if terms:

        @F.pandas_udf("string")
        def right(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            found = hotwords.Lexicon(terms, least=least)
            for texts in parts:
                yield texts.map(lambda t: found.correct(t)[0], na_action="ignore")

        rows = rows.withColumn("text", right("text"))
    rows = rows.withColumn("text", clean_fillers(F.col("text")))

    @F.pandas_udf(WORDS)
    def follow(words: pd.Series, raw: pd.Series, text: pd.Series) -> pd.Series:
        out = []
        for ws, r, t in zip(words, raw, text, strict=True):
            held = [(w["word"], w["start"], w["end"]) for w in ws]
            new = tokensync.sync_to_rewrite(held, t) if t and t != r else held if t else []
            out.append([{"word": w, "start": s, "end": e} for w, s, e in new])
        return pd.Series(out)

    rows = rows.withColumn("words", follow("words", "raw", "text"))
    gone = F.when(F.col("text") == "", "fillers").otherwise(F.col("dropped"))
    timed = F.size("words") > 0
    return rows.select(
        "session_id", "utt", F.when(F.col("text") != "", F.col("text")).alias("text"),
        F.when(timed, F.greatest("start", F.get("words", F.lit(0))["start"])).otherwise(F.col("start")).alias("start"),
        F.when(timed, F.element_at("words", -1)["end"]).otherwise(F.col("end")).alias("end"), "words", gone.alias("dropped"),
    )


def lexicon_terms(spark: SparkSession, path: str) -> list[hotwords.Term]:
    """The lexicon as it stands now; it is read by Spark, so any store will do."""
    rows = lexicons.read(spark, path).collect()
    return [hotwords.Term(r["target"], tuple(r["aliases"]), tuple(r["black"])) for r in sorted(rows, key=lambda r: r["target"])]


def reloading(settled: DataFrame, lexicon: str, write: Callable[[DataFrame, int], None], least: float = 0.85) -> DataStreamWriter:
    """Finishes a stream of settled finals with a lexicon that may change while it runs.

    Each batch reads the lexicon once, when it begins, and keeps that version to its end; ``write`` takes the
    finished rows and the batch's number, by which a replayed batch can be told.
    """
    return settled.writeStream.foreachBatch(lambda batch, number: write(finish(batch, lexicon_terms(batch.sparkSession, lexicon), least), number))

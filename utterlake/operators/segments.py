"""Transcripts to subtitle segments: sentences with timed characters and punctuation.

Marks are not spoken, so each takes the end of what was spoken before it.  Sentences and anchors come from
one window over a recording's tokens; tokens then meet again per sentence, which bounds a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import PUNCTUATION, SENTENCE_END, has_content, strip

_MARKS = PUNCTUATION.strip().replace("[", r"\[").replace("]", r"\]").replace("-", r"\-")
CHAR = "struct<text:string,start:double,end:double>"


def transcript_segments(transcripts: DataFrame, keys: list[str], words: str = "words", fallback: str | None = None, ends: str = SENTENCE_END) -> DataFrame:
    """One row per segment: keys, index (from 1), start, end, text, punctuation, speaker (null), chars.

    ``words`` holds structs of word, start, end.  A token's trailing marks, and tokens of marks alone, are
    characters of their own at the end of the content before them in the recording, or, where there is
    none, at their token's own time.  A mark of ``ends`` closes a segment; one without content is left
    out.  A recording without words gives its ``fallback`` text as one segment at 0.0.
    """
    has = F.coalesce(F.size(words), F.lit(0)) > 0
    t = transcripts.filter(has).select(*keys, F.posexplode(words).alias("pos", "w"))
    word = F.coalesce("w.word", F.lit(""))
    spoken = has_content(word)
    lead = F.when(spoken, F.regexp_extract(word, rf"(?sU)^(.*?)[{_MARKS}\p{{P}}]*\z", 1)).otherwise("")
    t = t.select(*keys, "pos", word.alias("word"), F.col("w.start").cast("double").alias("s"), F.col("w.end").cast("double").alias("e"), spoken.alias("spoken"), lead.alias("lead"))
    t = t.withColumn("marks", F.substring("word", F.char_length("lead") + 1, F.char_length("word"))).withColumn("closes", F.col("marks").rlike(f"[{ends}]").cast("int"))
    so_far = W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    t = t.withColumn("sent", F.sum("closes").over(so_far) - F.col("closes")).withColumn("anchor", F.coalesce(F.last(F.when(F.col("spoken"), F.col("e")), ignorenulls=True).over(so_far), F.col("s")))
    heard = F.filter(F.split(F.regexp_replace("marks", r"(?U)\s+", ""), ""), lambda c: c != "")
    chars = F.concat(
        F.when(F.col("spoken"), F.array(F.struct(F.col("lead").alias("text"), F.col("s").alias("start"), F.col("e").alias("end")))).otherwise(F.expr(f"cast(array() as array<{CHAR}>)")),
        F.transform(heard, lambda c: F.struct(c.alias("text"), F.col("anchor").alias("start"), F.col("anchor").alias("end"))),
    )
    rolled = t.groupBy(*keys, "sent").agg(F.array_sort(F.collect_list(F.struct("pos", "word", chars.alias("chars")))).alias("x"), F.min_by("s", F.when(F.col("spoken"), F.col("pos"))).alias("start"), F.max_by("e", F.when(F.col("spoken"), F.col("pos"))).alias("end"))
    made = rolled.select(*keys, "sent", "start", "end", strip(F.array_join(F.transform("x", lambda x: x["word"]), "")).alias("text"), F.flatten(F.transform("x", lambda x: x["chars"])).alias("chars")).filter(has_content(F.col("text")))
    if fallback:
        text = strip(F.coalesce(fallback, F.lit("")))
        none = transcripts.filter(~has).select(*keys, F.lit(0).cast("long").alias("sent"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), text.alias("text"), F.expr(f"cast(array() as array<{CHAR}>)").alias("chars"))
        made = made.unionByName(none.filter(has_content(F.col("text"))))
    index = F.row_number().over(W.partitionBy(*keys).orderBy("sent")).cast("long")
    return made.select(*keys, index.alias("index"), "start", "end", "text", F.regexp_extract("text", f"[{ends}]*\\z", 0).alias("punctuation"), F.lit(None).cast("string").alias("speaker"), "chars")

"""Lexicon joins: fuzzy terms, blacklists in a window, best matches.

Fuzzy terms meet by deletion keys, an equi join without loss, instead of a product of both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def one_less(term: Column) -> Column:
    """A term and all that is left of it without one character."""
    n = F.char_length(term)
    return F.array_distinct(F.concat(F.array(term), F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.left(term, i - 1), F.substr(term, i + 1)))))


def fuzzy_terms(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """Pairs (token, term) within one edit; both sides are one column of distinct strings."""
    left, right = tokens.select("token", F.explode(one_less(F.col("token"))).alias("key")), terms.select("term", F.explode(one_less(F.col("term"))).alias("key"))
    return left.join(right, "key").select("token", "term").distinct().withColumn("distance", F.levenshtein("token", "term")).filter("distance <= 1")


def blacklisted(words: Column, at: Column, black: list[str], window: int = 5) -> Column:
    """Whether one of the black words stands within ``window`` words of a place."""
    near = F.slice(words, F.greatest(at - window, F.lit(0)) + 1, F.least(at, F.lit(window)) + window + 1)
    return F.arrays_overlap(near, F.array(*map(F.lit, black)))


def best_per_group(scored: DataFrame, group: str, item: str, score: str, k: int) -> DataFrame:
    """The ``k`` best items of each group by their best score; an item counts once."""
    best = scored.groupBy(group, item).agg(F.max(score).alias(score))
    order = W.partitionBy(group).orderBy(F.desc(score), item)
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

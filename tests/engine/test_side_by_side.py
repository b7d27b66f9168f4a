"""Texts that a lexicon searches side by side."""

from utterlake.functions.hotwords import Lexicon, Term
from utterlake.plans import registry


def test_texts_side_by_side_are_as_alone(spark):
    terms = [Term(t, (t,), b) for t, b in (("almond", ()), ("misty", ("steel",)), ("天地人", ()), ("x" * 70, ()))]
    texts = ["", ".", "almnd of a misti steel", "a misti day, almondd", "天土人和天地入", "red " * 200 + "almont", "x" * 69]
    for least in (0.6, 0.75):
        found = Lexicon(terms, least=least)
        assert found.correct_all(texts) == [found.correct(t) for t in texts]
    assert found.ends_of([]) == [] and Lexicon([]).correct_all(texts) == [(t, []) for t in texts]


def test_texts_of_one_file_are_dealt(spark):
    out = registry.queries()["lexicon_correction"](spark, "/root/testdata/sf0.001")
    assert out.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism

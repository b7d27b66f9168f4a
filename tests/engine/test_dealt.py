"""Long work on rows of one file goes to all cores, and is done once for what comes again."""

import pytest

from utterlake.functions import numbers
from utterlake.plans import registry


@pytest.mark.parametrize("name", ["spoken_shares", "spoken_clocks", "spoken_dates"])
def test_rows_of_one_file_are_dealt(spark, name):
    out = registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert out.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_phrases_are_read_once():
    numbers._sure.cache_clear()
    assert [numbers.sure(t) for t in ("共三百五十元", "共三百五十元", "百分之五")] == ["共350元", "共350元", "5%"]
    assert numbers._sure.cache_info().hits >= 1

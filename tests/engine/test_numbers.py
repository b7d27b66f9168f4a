import pytest

from utterlake.functions import numbers as N

GOLDEN = """十五六个 15~16个|十一点五 11.5|三百块 300块|零点零五 0.05|幺九二点幺六八 192.168|十二点零五 12.05|五点五万亿元 5.5万亿元
二零二六年九月六日上午十一点五十 2026年9月6日上午11:50|一点二万亿元 1.2万亿元|2026年9月6号上午11点50分10秒 2026年9月6号上午11:50:10
国内生产总值达到五点五万亿元 国内生产总值达到5.5万亿元|上午11点50 上午11:50|百分之百 100%|11点50 11:50|九月六日 9月6日|下午3点5 下午3:05|九月六号 9月6号
在国内外形势十分复杂 在国内外形势十分复杂|二零二六年九月六号 2026年9月6号|今天我给你打十分 今天我给你打10分|十一点五十 11:50|十分钟后出发 10分钟后出发|打二十分 打20分
一千八 1800|一万二千五 12500|三分之二 2/3|三比五 3:5|乱七八糟 乱七八糟|几十个 几十个|一百二三十 120~130|三五百 300~500|三四十万 30~40万|千分之五 5‰|负五 -5|两万零五 20005|我有一本书 我有一本书|万一 万一|五千克 5kg|三点一四 3.14|五点五五米 5.55米|十二点二五 12.25|八点三七 8.37|上午八点三七 上午8:37|八点三十七 8:37"""


@pytest.mark.parametrize("case", GOLDEN.replace("\n", "|").split("|"))
def test_golden(case):
    text, want = case.split(" ")
    assert N.to_digits(text) == want


def test_round_trip(spark):
    from pyspark.sql import functions as F

    rows = spark.range(11, 300_000, 13).union(spark.range(10**8 - 5, 2 * 10**8, 999_983)).union(spark.range(10**11, 10**11 + 50, 7)).withColumn("s", N.spell(F.col("id"))).withColumn("t", N.normalise(F.concat(F.lit("共"), "s", F.lit("元"))))
    bad = rows.filter(F.col("t") != F.concat(F.lit("共"), F.when(F.col("id") % 10**8 == 0, F.concat((F.col("id") / 10**8).cast("long").cast("string"), F.lit("亿"))).when(F.col("id") % 10_000 == 0, F.concat((F.col("id") / 10_000).cast("long").cast("string"), F.lit("万"))).otherwise(F.col("id").cast("string")), F.lit("元"))).collect()
    assert bad == []


def test_runs_with_a_written_zero_stay():
    from utterlake.functions.numbers import to_digits

    assert to_digits("在二〇二四年五月") == "在二〇二四年五月" and to_digits("一〇一室有十五人") == "一〇一室有15人"

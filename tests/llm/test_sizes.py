"""Tables that an explode or a mapInArrow makes larger than Spark thinks are shuffled, not broadcast."""

import uuid

from pyspark.sql import functions as F

from utterlake.llm import jaccard, lines, neardup, pii
from utterlake.llm.store import cut


def plans(spark, act) -> dict[str, str]:
    """Physical plans of the tables that an action writes, by the tables' names."""
    store = spark._jsparkSession.sharedState().statusStore()
    mark = uuid.uuid4().hex
    spark.sparkContext.setJobDescription(mark)
    try:
        act()
    finally:
        spark.sparkContext.setJobDescription(None)
    found = {}
    for k in range(store.executionsCount()):
        run = store.executionsList().apply(k)
        plan = run.physicalPlanDescription()
        if run.description() == mark and "InsertIntoHadoopFsRelationCommand" in plan:
            name = plan.split("InsertIntoHadoopFsRelationCommand")[-1].split("Arguments: ")[1].split(",")[0].rsplit("/", 1)[1].rsplit("-", 1)[0]
            found[name] = plan
    return found


def docs(spark):
    words = [" ".join(f"w{(k * 7 + j) % 400}" for j in range(60)) for k in range(0, 200, 3)]
    rows = [(i, f"{t} {'end' if i % 2 else ''}\nA line of this very text, long enough to be compared: {i // 2}") for i, t in enumerate(words + words)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_keys_of_signatures_are_shuffled(spark):
    d = docs(spark)
    made = plans(spark, lambda: neardup.near_duplicates(d).collect())
    assert "BroadcastExchange" not in made["grouped"] and "BroadcastExchange" not in made["early"]


def test_leaves_are_shuffled(spark):
    d = docs(spark)
    made = plans(spark, lambda: jaccard.join_components(d).collect())
    leaves = made["leaves"]
    assert "SortMergeJoin" in leaves


def test_keys_of_lines_are_shuffled(spark):
    d = docs(spark)
    made = plans(spark, lambda: lines.dedup_lines(d).collect())
    assert "BroadcastExchange" not in made["maybe"]


def test_components_beyond_the_broadcast(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") - F.col("id") % 7).alias("b"))
    few, many = (sorted(map(tuple, neardup.components(edges, most_broadcast=n).collect())) for n in (200_000, 0))
    assert few == many == [(k, k - k % 7) for k in range(300) if k % 7]


def personal(spark):
    rows = [(i, f"mail me at user{i}@mail.example or +1 555 010 {i:04d}\n" + (f"mail me at user{i} at mail dot example" if i % 3 else "")) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_scanned_rows_are_shuffled(spark):
    d = personal(spark)
    made = plans(spark, lambda: cut(pii.find(d), "spans"))
    assert "SortMergeJoin" in made["spans"]


def test_many_edges_are_shuffled(spark):
    scanned = cut(pii.scan(personal(spark).withColumn("text_key", F.xxhash64("text"))), "scanned")
    found = []
    for n in (200_000, 0):
        made = plans(spark, lambda n=n: found.append(sorted(map(tuple, pii.discover(scanned, None, 0.8, 3, few_edges=n).collect()))))
    assert found[0] == found[1] and "BroadcastExchange" not in made["edges"] + made["sides"] + made["good"]


def test_more_links_join_components_without_the_old_ones(spark):
    rows = [(k, k - k % 7) for k in range(300)]
    more = [(0, 7), (13, 290), (7, 14), (400, 401), (401, 3), (500, 510), (20, 16), (9, 9)]
    first, later = (spark.createDataFrame(x, "a long, b long") for x in (rows, more))
    labels = neardup.components(first)
    found = []
    made = plans(spark, lambda: found.append(neardup.extended(labels, later)))
    want = sorted(map(tuple, neardup.components(first.unionByName(later)).collect()))
    assert sorted(map(tuple, found[0].collect())) == want and "labels" in made
    none = neardup.extended(labels, later.limit(0))
    assert sorted(map(tuple, none.collect())) == sorted(map(tuple, labels.collect()))


def test_settled_stars_take_one_round(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (5, 9)], "a long, b long")
    before = spark._jsparkSession.sharedState().statusStore().executionsCount()
    got = neardup.components(edges)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert spark._jsparkSession.sharedState().statusStore().executionsCount() - before == 2  # the edges, and one round
    assert sorted(map(tuple, got.collect())) == [(2, 1), (3, 1), (9, 5)]
    assert neardup.components(edges.limit(0)).collect() == []

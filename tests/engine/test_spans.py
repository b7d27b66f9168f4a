"""Replaced spans, a few rows at a time."""

from utterlake.operators import fold
from utterlake.plans import stream


def test_replaced_spans_over_many_slices(spark, tmp_path):
    n = 2 * fold.SLICE + 7
    rows = [(k, 0, "user", None if k % 50 == 0 else f"word{k:05} and others follow it" if k % 3 else "short") for k in range(n)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    out = stream.replaced_spans(spark, str(tmp_path))
    assert "MapInArrow" in out._jdf.queryExecution().toString()
    got = {r.conv_id: (r.text, r.start_ms, r.end_ms) for r in out.collect()}
    assert got.keys() == {k for k, _, _, t in rows if t}
    assert all(v == ("short", None, None) if k % 3 == 0 else v == (f"word{k:05}a<X>llowit", 250, 950) for k, v in got.items())

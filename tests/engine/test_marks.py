"""Boundary marks against their SQL on texts with line ends."""

from collections import Counter

import duckdb

from utterlake.plans import registry

TEXTS = ["è.\néç Ñ.", "ab.\ncd ef.\n", "\nab.", "é\tè\n\nç.\n", "ab\r\ncd. é\r\nè.", "\n", "ÑÉ.\nÓ a\n", "  éè.  ", "", None]


def test_line_ends_inside_words(spark, tmp_path):
    spark.createDataFrame([(k, 0, "user", t) for k, t in enumerate(TEXTS)], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    out = registry.queries()["boundary_marks"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(f"SELECT {', '.join(out.columns)} FROM ({registry.oracle_sql()['boundary_marks']})").fetchall()
    assert Counter(map(tuple, out.collect())) == Counter(want)

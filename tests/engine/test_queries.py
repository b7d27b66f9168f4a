"""Every registered query against its SQL on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from utterlake.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    out = registry.queries()[name](spark, SF)
    rows = out.collect()
    assert rows
    if sql := registry.oracle_sql().get(name):
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        columns = sorted(out.columns)
        want = con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
        assert Counter(tuple(r[c] for c in columns) for r in rows) == Counter(want)

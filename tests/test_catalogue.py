"""Every registered query of the readers and row operators against its SQL."""

import math

import duckdb
import pytest

from rivulet.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows):
    return sorted(tuple("nan" if isinstance(v, float) and math.isnan(v) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = got.select(*(f"`{c}`" for c in columns)).collect()
    assert len(rows)
    if name not in ORACLE_SQL:
        return
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "events", "documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert plain(map(tuple, rows)) == plain([tuple(r[i] for i in order) for r in want.fetchall()])

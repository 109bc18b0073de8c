"""Every query that has SQL must give the rows DuckDB gives for it."""

import os

import duckdb
import pandas as pd
import pytest

from pairlattice.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(frame: pd.DataFrame) -> list:
    def value(x):
        if x is None or x is pd.NA or x != x:
            return None
        return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted((tuple(map(value, r)) for r in frame[sorted(frame.columns)].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_gives_what_its_sql_gives(name, spark, duck):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_gives_rows(name, spark):
    assert registry.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["fragment_overlap_join", "nested_overlap_join"])
def test_overlaps_do_not_broadcast_a_side(name, spark, tmp_path):
    """With 200 times the parts, and broadcasts of a megabyte at most."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{SF}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'")
    con.execute(f"COPY (SELECT p.* REPLACE (p_partkey + i * (SELECT max(p_partkey) + 1 FROM '{SF}/part.parquet') AS p_partkey) FROM '{SF}/part.parquet' p, range(200) r(i)) TO '{tmp_path}/part.parquet'")
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    spark.conf.set("spark.sql.maxBroadcastTableSize", 1 << 20)
    try:
        got = registry.QUERIES[name](spark, str(tmp_path)).toPandas()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    want = con.execute(registry.ORACLES[name]).df()
    assert len(want) > 0
    by = sorted(want.columns)
    pd.testing.assert_frame_equal(*(x[by].astype("int64").sort_values(by, ignore_index=True) for x in (got, want)))

"""Every query of the catalogue that has SQL gives the same rows in DuckDB."""

import math

import duckdb
import pytest

from catlake.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return round(float(v), 6) if type(v).__name__ == "Decimal" else v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    if name in ORACLE_SQL:
        found = duck.sql(ORACLE_SQL[name])
        assert sorted(found.columns) == columns
        at = [list(found.columns).index(c) for c in columns]
        assert ordered(rows) == ordered([tuple(r[i] for i in at) for r in found.fetchall()])


@pytest.mark.parametrize("name", ["facet_places", "interval_week_join", "block_pairs", "source_health", "calendar_days", "semantic_duplicates"])
def test_no_nested_loops(spark, name):
    plan = QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan

"""Every query that has SQL gives DuckDB's rows on the smallest tables."""

import math

import duckdb
import pytest

from glossarium.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v


def rows(names, found):
    order = sorted(names)
    at = [names.index(n) for n in order]
    return sorted((tuple(plain(r[k]) for k in at) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, con):
    got = registry.queries()[name](spark, DATA)
    want = con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(name, spark):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_plans_read_few_columns_and_stay_in_the_jvm(spark):
    plan = registry.queries()["flt14_is_sentence"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<item_id" in plan and "Python" not in plan
    for name in ("flt05_like_escape", "fn04_fnv1a", "str17_hun_eum", "ag15_interacting_caps"):
        assert "Python" not in registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()

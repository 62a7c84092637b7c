"""Positions in sorted order against sorted lists."""

import random

import pytest
from pyspark.sql import functions as F

from glossarium.operators.numbering import numbered
from glossarium.plans import registry

DATA = "/root/testdata/sf0.001"


def rows():
    rng = random.Random(3)
    own = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), rng.randrange(40), k) for k in range(3000)]
    return own + [(None, None, 9000 + k) for k in range(5)]


def test_within_groups(spark):
    own = rows()
    df = spark.createDataFrame(own, "g string, v int, id long").repartition(7)
    got = {r.id: (r.at, r.size) for r in numbered(df, ["v", F.desc("id")], by=["g"], name="at", total="size").collect()}
    for g in {g for g, _, _ in own}:
        group = sorted((x for x in own if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, -x[2]))
        assert [got[i] for _, _, i in group] == [(k, len(group)) for k in range(len(group))]


def test_over_all_rows_and_none(spark):
    own = rows()
    df = spark.createDataFrame(own, "g string, v int, id long").repartition(5)
    assert [r.id for r in numbered(df, ["id"]).orderBy("n").collect()] == sorted(i for _, _, i in own)
    assert sorted(r.n for r in numbered(df, ["v"]).collect()) == list(range(len(own)))  # ties get some order
    assert numbered(df.limit(0), ["id"]).count() == 0 == numbered(df.limit(0), ["id"], by=["g"]).count()


def test_columns_may_clash(spark):
    df = spark.createDataFrame([(2, "x", 1), (1, "y", 2)], "id long, _all string, `a.b` int")
    assert sorted((r.n, r["_all"]) for r in numbered(df, ["a.b"]).collect()) == [(0, "x"), (1, "y")]


@pytest.mark.parametrize("name", ["win01_wotd", "win05_global_rank", "srt08_grammar_order", "utl21_batches", "jn04_word_of_day_join"])
def test_no_window_over_one_partition(name, spark):
    plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan or "SinglePartition" not in plan

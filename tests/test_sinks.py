import pytest

from glossarium.functions.korean import initial_sound
from glossarium.functions.writing import tone_mark
from glossarium.sources import sinks


def test_commit_replaces_whole_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.commit(spark.range(5).toDF("id"), path) == 5
    assert sinks.commit(spark.range(7).toDF("id"), path) == 7
    with pytest.raises(ValueError):
        sinks.commit(spark.range(1).toDF("id"), path, at_least=2)
    assert spark.read.parquet(path).count() == 7
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_commit_heals_a_stop_between_renames(spark, tmp_path):
    path = tmp_path / "t"
    sinks.commit(spark.range(5).toDF("id"), str(path))
    path.rename(tmp_path / "t.old")
    with pytest.raises(ValueError):
        sinks.commit(spark.range(1).toDF("id"), str(path), at_least=2)
    assert spark.read.parquet(str(path)).count() == 5


def test_digest_ignores_order_and_sees_nulls(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "id long, w string")
    assert sinks.digest(a).first() == sinks.digest(a.orderBy("id", ascending=False)).first()
    assert sinks.digest(a).first() != sinks.digest(a.fillna("y")).first()
    assert '"n": 2' in sinks.manifest({"a": a})


def test_merge_by_key(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id long, w string")
    got = sinks.merge_by_key(old, spark.createDataFrame([(2, "z"), (None, "y")], "id long, w string"), "id").collect()
    assert sorted((str(r.id), r.w) for r in got) == [("1", "a"), ("2", "z"), ("None", "c"), ("None", "y")]


def test_readings(spark):
    words = spark.createDataFrame([("lu:4", "력사"), ("hao3", "여자"), (None, None)], "p string, k string")
    assert [tuple(r) for r in words.select(tone_mark(words.p), initial_sound(words.k)).collect()] == [("lǜ", "역사"), ("hǎo", "여자"), (None, None)]

"""What larger tables have and the small ones lack: ties, folders of files, names with many rows."""

import random

import duckdb
import pytest

from glossarium.operators import corpus, longest
from glossarium.plans import registry, router


@pytest.fixture
def same_as_sql(spark, tmp_path):
    """A query's sorted rows over tables given as DataFrames (one file each) or as folders, which must be those of its SQL."""

    def check(name, **tables):
        con = duckdb.connect(config={"threads": 1})
        for t, sql in tables.items():
            con.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        got = registry.queries()[name](spark, str(tmp_path))
        columns = ", ".join(f'"{c}"' for c in got.columns)
        want = con.execute(f"SELECT {columns} FROM ({registry.oracle_sql()[name]})").fetchall()
        rows = [tuple(r) for r in got.collect()]
        assert sorted(rows, key=repr) == sorted(want, key=repr)
        return rows

    return check


def parts(rows):
    return f"SELECT * FROM (VALUES {', '.join(map(str, rows))}) t(p_partkey, p_name, p_brand, p_type, p_size, p_retailprice)".replace("None", "NULL")


def test_curriculum_keeps_kinds_without_homonym_apart(same_as_sql):
    rows = same_as_sql("src17_curriculum", part=parts([(1, "cold ring", "Brand#1", "SMALL", 1, 9.5), (7, "cold ring", "Brand#1", "SMALL", 2, 9.5), (13, "cold ring", "Brand#1", "SMALL", 4, 9.5), (19, "cold ring", "Brand#1", "SMALL", 3, 9.5)]))
    assert sorted(r[-1] for r in rows) == [1, 1, 2]


def test_game_words_that_tie(same_as_sql):
    # 1024 and 4024 differ in nothing that orders them; two files' worth of rows would leave it to chance
    rows = same_as_sql("qry27_game_words", part=parts([(1024 + 3000 * k, "cold ring", "Brand#1", "SMALL", 3, 9.5) for k in range(40)] + [(5, "hot ring", "Brand#1", "SMALL", 3, None)]))
    assert dict(rows)["cold ring"] == min(i for i in (1024 + 3000 * k for k in range(40)) if i % 6 == 4 and i % 1000 == 24)


def test_three_way_takes_the_first_of_lines_that_tie(same_as_sql, spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    try:
        rows = same_as_sql(
            "jn19_three_way",
            customer="SELECT i AS c_custkey, 'c' || i % 9 AS c_name FROM range(12) t(i)",
            orders="SELECT i AS o_orderkey, i % 12 AS o_custkey FROM range(60) t(i)",
            lineitem="SELECT i * 7 % 60 AS l_orderkey, CAST(CASE WHEN i % 11 = 0 THEN NULL ELSE 1 + i // 300 END AS INT) AS l_linenumber, i * 13 % 50 AS l_suppkey FROM range(600) t(i)",
            supplier="SELECT i AS s_suppkey, 's' || i AS s_name FROM range(50) t(i)",
        )
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) == 9


def test_feeds_of_folders(spark, tmp_path):
    url = [(f"u{k % 7}", k) for k in range(30)]
    spark.createDataFrame(url, "url string, page_id long").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(r.url for r in registry.queries()["stm03_new_items"](spark, str(tmp_path)).collect()) == [f"u{k}" for k in range(7)]
    spark.sql("SELECT id AS event_id, id % 3 AS user_id, timestamp_seconds(id) AS ts, CASE WHEN id % 4 = 0 THEN 'error' ELSE 'view' END AS event_type FROM range(40)").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    assert sorted((r.card, r.seen) for r in registry.queries()["stm04_review_stream"](spark, str(tmp_path)).collect()) == [(0, 14), (1, 13), (2, 13)]


def test_linkage_by_classes(same_as_sql, spark):
    rows = same_as_sql("jn22_scored_linkage", part="SELECT i AS p_partkey, 'cold ring ' || i % 3 AS p_name, 'Brand#' || (i % 4 + 1) AS p_brand, ['SMALL', 'LARGE'][i % 2 + 1] AS p_type, CAST(i * 5 % 50 AS INT) AS p_size, 9.5 AS p_retailprice FROM range(4000) t(i)")
    assert len(rows) == 1000
    # candidates met by name are classes: the join of 4000 rows makes fewer than one of theirs a row
    plan = registry.queries()["jn22_scored_linkage"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") >= 3


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    return [line for line in plan.split("\n") if "Exchange" in line and "Broadcast" not in line]


def test_places_are_looked_up_where_the_text_lies(spark):
    # only keys are grouped, by their first characters
    assert all("_groupingexpression" in line for line in exchanges(registry.queries()["srt14_longest_spans"](spark, "/root/testdata/sf0.001")))


@pytest.mark.parametrize("parts", [(64, 8, 3), (1 << 15, 1 << 11, 1 << 7)])
def test_sorted_keys_and_parts_of_texts_give_the_same_matches(spark, monkeypatch, parts):
    monkeypatch.setattr(longest, "PARTS", parts)
    text = "".join(random.Random(7).choice(["a", "ab", "바다", " ", "𠀀", "c-", "학"]) for _ in range(900))
    keys = ["a", "ab", "aba", "바다", "𠀀𠀀", "다 ", *("a" * k for k in range(2, 30))]
    df = spark.createDataFrame([(1, text, "p"), (2, "", "q"), (3, "학" * 200 + "ab", "q")], "id long, text string, more string")
    k = spark.createDataFrame([(x,) for x in keys], "key string")
    want = {(i, at, max((x for x in keys if t.startswith(x, at)), key=len), more) for i, t, more in [tuple(r) for r in df.collect()] for at in range(len(t)) if any(t.startswith(x, at) for x in keys)}
    for most in (50_000, 0):
        monkeypatch.setattr(longest, "MOST_KEYS", most)
        assert {(r.id, r.start, r.key, r.more) for r in longest.matches(df, k, longest.EVERY_PLACE).collect()} == want


def test_spans_move_once_and_without_their_keys(spark):
    moved = exchanges(registry.queries()["qry23_leftmost_spans"](spark, "/root/testdata/sf0.001"))
    assert moved and not any("window" in line or "key" in line for line in moved)
    plan = registry.queries()["qry23_leftmost_spans"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "key#" not in plan.split("Window ")[0]


def test_study_counts_places_where_they_are(spark):
    # what moves are counts by language and key, never places
    assert not any("start" in line or "doc_id" in line or "id#" in line.replace("pid#", "").replace("plan_id", "") for line in exchanges(registry.queries()["ag21_study"](spark, "/root/testdata/sf0.001")))


def test_pattern_counts_move_once_by_document(spark):
    plan = registry.queries()["ag21_pattern_counts"](spark, "/root/testdata/sf0.001")
    assert len([line for line in exchanges(plan) if "id#" in line.replace("plan_id", "")]) == 1
    assert "SortMergeJoin" not in plan._jdf.queryExecution().executedPlan().toString()


def test_totals_look_for_no_pattern(spark, monkeypatch):
    def never(*_):
        raise AssertionError("totals need no matches")

    for module in (corpus, longest):
        monkeypatch.setattr(module, "matches", never)
        monkeypatch.setattr(module, "all_hits", never)
    assert registry.queries()["ag21_totals"](spark, "/root/testdata/sf0.001").count() > 0


def test_totals_make_no_list_of_tokens(spark, same_as_sql, tmp_path):
    texts = ["NULL", "''", "' '", "chr(9) || chr(10)", "'one'", "' a  b' || chr(13) || chr(10) || 'c '", "'a' || chr(160) || 'b' || chr(11) || '바다'", "chr(12) || 'x'"]
    rows = ", ".join(f"({k}, {t}, {'NULL' if k % 3 == 0 else repr('l' + str(k % 3))})" for k, t in enumerate(texts))
    same_as_sql("ag21_totals", documents=f"SELECT * FROM (VALUES {rows}) t(doc_id, text, lang)", benchmark="SELECT 1 AS item_id, 'some words' AS text")
    plan = registry.queries()["ag21_totals"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "split(" not in plan


def test_lookup_meets_the_first_entries_of_a_key(spark):
    rows = [(k, "krdict", "바다", None, "noun", "sea", "salt water", 1000 - k // 2, 1, False, ["바다"]) for k in range(60)]
    lex = router.lexicon(spark.createDataFrame(rows, router.COLUMNS.replace("forms string", "forms array<string>")))
    taps = spark.createDataFrame([(1, "바다", 0), (2, "바다", 0), (3, None, 0), (4, "바다", None)], "tap long, text string, offset int")
    found = router.lookup_in_text(lex, taps)
    want = [k for k in sorted(range(60), key=lambda k: (1000 - k // 2, k))][:20]
    got = {}
    for r in found.collect():
        got.setdefault(r.tap, []).append((r.n, r.id))
    assert {t: [i for _, i in sorted(x)] for t, x in got.items()} == {1: want, 2: want, 4: want}
    # a key's entries are ranked before taps meet them
    assert found._jdf.queryExecution().optimizedPlan().toString().count("row_number") >= 3

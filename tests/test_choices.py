"""Claims, caps and similar sets against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from glossarium.operators import capped, claims, similar


def by_loop(rows, options):
    claimed, out = set(), {}
    for row, _ in sorted(rows, key=lambda x: x[1]):
        own, pick = [o for o in options if o[0] == row], None
        for alt in sorted({o[1] for o in own}):
            best = None
            for _, a, i, score, loss, fits in own:
                if a == alt and not (i in claimed and loss is None):
                    key = (score - (loss if i in claimed else 0), -i)
                    if best is None or key > best[0]:
                        best = key, i, fits
            if best and best[2]:
                pick = best[1]
                break
        out[row] = pick
        if pick is not None:
            claimed.add(pick)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_choices_are_those_of_a_loop(spark, seed, monkeypatch):
    monkeypatch.setattr(claims, "BLOCK", [4, 256, 16][seed])
    rng = random.Random(seed)
    rows = [(k, k * 7 % 211) for k in range(150)]
    options = []
    for k, _ in rows[:-5]:  # five have none
        hot = rng.random() < 0.5
        for alt in range(rng.choice([1, 1, 2])):
            for i in rng.sample(range(8) if hot else range(10 + k // 9 * 4, 14 + k // 9 * 4), 3):
                options.append((k, alt, i, rng.randrange(30), None if seed == 2 else 15, rng.random() < 0.7))
    got = claims.choose(spark.createDataFrame(rows, "row long, ord long"), spark.createDataFrame(options, "row long, alt int, id long, score long, loss long, fits boolean"))
    assert {r.row: r.id for r in got.collect()} == by_loop(rows, options)


@pytest.mark.parametrize("seed", range(3))
def test_choices_among_alike_are_those_of_a_loop(spark, seed, monkeypatch):
    monkeypatch.setattr(claims, "TURN", [50, 1 << 16, 80][seed])
    rng = random.Random(seed)
    ids = rng.sample(range(1000), 60)
    members = [(k % 17, i) for k, i in enumerate(ids)]
    of_kind = [(kind, alt, cls, rng.choice([0, 8, 15, 23, 40, 48, 55]), None if seed == 2 and cls % 3 == 0 else 15, rng.random() < 0.7) for kind in range(12) for alt in range(2) for cls in rng.sample(range(17), rng.randrange(5))]
    rows = [(k, k * 7 % 211, rng.randrange(13)) for k in range(150)]  # the last kind has no options
    each = [(row, alt, i, score, loss, fits) for row, _, kind in rows for k, alt, cls, score, loss, fits in of_kind if k == kind for c, i in members if c == cls]
    want = by_loop([r[:2] for r in rows], each)
    options = spark.createDataFrame(of_kind, "kind long, alt int, cls long, score long, loss long, fits boolean")
    got = claims.choose_alike(spark.createDataFrame(rows, "row long, ord long, kind long"), options, spark.createDataFrame(members, "cls long, id long"))
    assert sorted((r.row, r.id) for r in got.select("row", F.coalesce("id", F.lit(-1)).alias("id")).collect()) == sorted((k, -1 if i is None else i) for k, i in want.items())
    assert claims.may_win(options).count() < len(of_kind)


def test_wanted_parts_meet_kinds_not_entries(spark, tmp_path):
    # 2000 parts of one kind: as many options as rows times entries would be a million
    spark.range(2000).select(F.col("id").alias("p_partkey"), F.lit("red bolt").alias("p_name"), F.lit("B").alias("p_brand"), F.lit("T").alias("p_type"), F.lit(3).alias("p_size"), F.lit(1.0).alias("p_retailprice")).write.parquet(f"{tmp_path}/part.parquet")
    rows, options, members = claims._kinds(spark, str(tmp_path))
    assert (rows.count(), options.count(), members.count()) == (1000, 1, 1000)
    assert {r.row: r.id for r in claims.claims_query(spark, str(tmp_path)).collect()} == {k: k - 1 for k in range(1, 2000, 2)}


def test_list_of_words(spark):
    wanted = [
        (1, 1, ["배"], "명사", "배를 타다", 1, 1),
        (2, 2, ["배"], "명사", "배를 먹다", 1, 2),
        (3, 3, ["배"], "명사", "", 1, None),
        (4, 4, ["다양"], "명사", "다양하다", 3, None),
        (5, 5, ["없음", "가게"], "명사", None, 1, None),
        (6, 6, ["가게"], "동사", "모르는 말", 6, None),
        (7, 7, [], "명사", None, 1, None),
    ]
    entries = [
        (10, "배", "noun", 1, 1, "배를 타다 강을 건너는 것"),
        (11, "배", "noun", 1, 2, "배를 먹다 과일"),
        (12, "배", "noun", 2, 3, "몸"),
        (20, "다양하다", "adjective", 2, None, "여러 가지"),
        (21, "다양하다", "noun", 2, None, ""),
        (30, "가게", "noun", 1, None, "물건을 파는 곳"),
    ]
    w = spark.createDataFrame(wanted, "row long, ord long, headwords array<string>, pos string, hint string, level int, homonym int")
    e = spark.createDataFrame(entries, "id long, headword string, pos string, level int, homonym int, text string")
    got = {r.row: r.id for r in claims.link_words(w, e).collect()}
    # the third row finds both good entries claimed: 15 less each outweighs the level
    assert got == {1: 10, 2: 11, 3: 12, 4: 20, 5: 30, 6: 30, 7: None}


def by_reading(rows):
    state, out = {}, []
    for term, grp, item, ord_ in sorted(rows, key=lambda r: (r[3], r[1], r[2])):
        s = state.setdefault(term, {"seen": set(), "groups": {}, "n": 0})
        if s["n"] >= 48 or (grp, item) in s["seen"]:
            continue
        s["seen"].add((grp, item))
        if grp not in s["groups"]:
            if len(s["groups"]) >= 12:
                continue
            s["groups"][grp] = 0
        if s["groups"][grp] >= 6:
            continue
        s["groups"][grp] += 1
        out.append((term, grp, item, ord_, s["n"]))
        s["n"] += 1
    return out


def test_caps_are_those_of_a_reader(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abh") if rng.random() < 0.5 else "h", rng.randrange(20), rng.randrange(15), k) for k in range(3000)]
    rows += [("z", 1, 1, 5), ("z", 1, 1, 5), ("few", 1, 2, 0)]
    got = capped.capped(spark.createDataFrame(rows, "term string, grp int, item int, ord long"))
    assert sorted(tuple(r) for r in got.select("term", "grp", "item", "ord", "n").collect()) == sorted(by_reading(rows))


def jaccard(a, b):
    return 100 * len(a & b), len(a | b)


@pytest.mark.parametrize("percent", [40, 70, 85, 100])
def test_similar_sets_by_brute_force(spark, percent):
    rng = random.Random(percent)
    base = [[rng.randrange(60) for _ in range(rng.randrange(1, 14))] for _ in range(40)]
    sets = [(k, rng.choice(base) + [rng.randrange(60)] * rng.randrange(2)) for k in range(150)] + [(900, []), (901, None), (902, [None, 1]), (903, [1, 1])]
    members, pairs = similar.similar_sets(spark.createDataFrame(sets, "id long, items array<int>"), percent)
    own = {k: frozenset(x for x in s or [] if x is not None) for k, s in sets}
    want = {k: min(j for j, t in own.items() if t == s) for k, s in own.items() if s}
    assert {r.id: r.cls for r in members.collect()} == want
    reps = sorted(set(want.values()))
    expect = {(a, b) for a in reps for b in reps if a < b and jaccard(own[a], own[b])[0] >= percent * jaccard(own[a], own[b])[1]}
    assert {(r.a, r.b) for r in pairs.collect()} == expect


def test_merged_pairs(spark):
    rows = [
        (1, 1, "P", "이", "marks the subject of a sentence"),
        (2, 2, "P", "이", "marks the subject of a clause"),
        (3, 3, "P", "가", "marks the subject of a sentence too"),
        (4, 4, "P", "가", "Marks the subject, of a clause"),
        (5, 5, "P", "아", "address someone"),
        (6, 6, "P", "야", "emphasis on one thing"),
        (7, 7, "Q", "가", "marks the subject of a sentence"),
        (8, 8, "P", "은", None),
        (9, 9, "P", "는", ""),
    ]
    df = spark.createDataFrame(rows, "id long, ord long, category string, pattern string, summary string")
    got = {(r.id, r.twin) for r in similar.merged_pairs(df, [("이", "가"), ("아", "야"), ("은", "는")]).collect()}
    assert got == {(1, 3), (2, 4)}
    assert similar.merged_pairs(df.filter("id > 4"), [("이", "가")]).count() == 0

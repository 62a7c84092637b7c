"""Longest matches against a scan of every place."""

import random

from pyspark.sql import functions as F

from glossarium.operators import corpus, longest
from glossarium.operators.numbering import carried

KEYS = ["a", "ab", "abc", "b c", "bc", "바", "바다", "바다표범", "學", "學生", "cab cab", "x" * 40, "", "𠀀𠀀", "aa", "aaaa"]


def texts():
    rng = random.Random(4)
    parts = ["a", "ab", "abc", "c", " ", "  ", "b c", "바다", "바", "표범", "學生", "𠀀", "x" * 17, "-", "\n", "cab", "aa"]
    own = [(k, "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for k in range(60)]
    return own + [(900, None), (901, ""), (902, "a" * 3000), (903, "x" * 200), (904, " \n")]


def by_scan(text, every):
    out = []
    for k in range(len(text or "")):
        word = lambda c: c.isascii() and c.isalnum() or not c.isascii()
        if every or word(text[k]) and not (k and word(text[k - 1])):
            fits = [x for x in KEYS if x and text.startswith(x, k)]
            if fits:
                out.append((k, max(map(len, fits))))
    return out


def test_matches_and_choice(spark):
    df = spark.createDataFrame(texts(), "id long, text string").repartition(3)
    keys = spark.createDataFrame([(k,) for k in KEYS] + [("ab",), (None,)], "key string")
    for starts, every in ((longest.WORD_STARTS, False), (longest.EVERY_PLACE, True)):
        found = longest.matches(df, keys, starts)
        got = {}
        for r in found.collect():
            assert dict(texts())[r.id][r.start : r.start + r.len] == r.key
            got.setdefault(r.id, []).append((r.start, r.len))
        want = {i: by_scan(t, every) for i, t in texts()}
        assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in want.items() if x}
        chosen = {}
        for r in longest.leftmost(found).collect():
            chosen.setdefault(r.id, []).append((r.start, r.len))
        for i, spans in want.items():
            end, left = 0, []
            for a, n in spans:
                if a >= end:
                    left.append((a, n))
                    end = a + n
            assert sorted(chosen.get(i, [])) == left


def test_nothing(spark):
    df = spark.createDataFrame(texts(), "id long, text string")
    none = spark.createDataFrame([], "key string")
    assert longest.matches(df, none).count() == 0
    assert longest.leftmost(longest.matches(df.limit(0), spark.createDataFrame([("a",)], "key string"))).count() == 0


def test_extensions(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice("pq"), rng.randrange(50), rng.choice(["ab", "abc", "abcd", "x", "abd", "학교", "학교생활"])) for k in range(400)]
    e = spark.createDataFrame(rows, "id long, pack string, rank long, key string")
    got = {}
    for r in longest.extensions(spark.createDataFrame([("ab",), ("ab",), ("학",), ("zz",), ("x",)], "q string"), e).collect():
        got.setdefault((r.q, r.pack), []).append((r.n, r.id))
    for q in ("ab", "학", "zz", "x"):
        for pack in "pq":
            want = sorted((rank, i) for i, p, rank, key in rows if p == pack and key.startswith(q) and key != q)[:25]
            assert sorted(got.get((q, pack), [])) == [(n + 1, i) for n, (_, i) in enumerate(want)]


def test_carried(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice([None, None, None, f"v{k}"]) if 40 < k < 2500 else None) for k in range(3000)]
    got = {r.k: r.last for r in carried(spark.createDataFrame(rows, "k long, v string").repartition(9), ["k"], "v", "last").collect()}
    last = None
    for k, v in rows:
        last = v or last
        assert got[k] == last
    assert carried(spark.createDataFrame([], "k long, v string"), ["k"], "v", "last").count() == 0
    assert carried(spark.createDataFrame([(2, None), (1, None)], "k long, v string"), [F.desc("k")], "v", "last").filter("last IS NULL").count() == 2


def test_all_hits_and_study(spark):
    df = spark.createDataFrame([(i, "pq"[i % 2], t) for i, t in texts()], "id long, corpus string, text string")
    for keys in (KEYS, ["abc", "bc a", "바다표범", "aaaa"], ["zzz"], []):
        want = {(i, k, x) for i, t in texts() for x in keys for k in range(len(t or "")) if x and t.startswith(x, k)}
        assert {(r.id, r.start, r.key) for r in longest.all_hits(df, spark.createDataFrame([(k,) for k in keys], "key string")).collect()} == want
    patterns = [(1, "abc", False), (1, "ab", True), (2, "aa", False), (2, "aaaa", False), (3, "바", True), (4, "b c", True), (4, "c", False)]
    counts, totals = corpus.study(df, spark.createDataFrame(patterns, "pid int, key string, partial boolean"))
    want = {}
    for i, t in texts():
        for pid in (1, 2, 3, 4):
            at = lambda kind: {k for p, x, part in patterns if p == pid and part == kind for k in range(len(t or "")) if t.startswith(x, k)}
            if at(False) | at(True):
                own = want.setdefault(("pq"[i % 2], pid), [0, 0])
                own[0] += len(at(False))
                own[1] += len(at(True) - at(False))
    assert {(r.corpus, r.pid): [r.whole, r.part] for r in counts.collect()} == want
    for r in totals.collect():
        own = [t or "" for i, t in texts() if "pq"[i % 2] == r.corpus]
        assert (r.tokens, r.syllables, r.texts) == (sum(len(t.split()) for t in own), sum(len("".join(t.split())) for t in own), len(own))

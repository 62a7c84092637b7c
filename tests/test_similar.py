"""Candidates for similar sets are few before sets are moved, and no pair is lost."""

import random

import pytest

from glossarium.operators import similar


@pytest.mark.parametrize("percent", [40, 70, 100])
def test_candidates_are_ruled_out_before_sets_move(spark, monkeypatch, percent):
    pick = random.Random(3)
    sets = {k: {f"w{int(pick.random() ** 2 * 90)}" for _ in range(pick.randint(0, 40))} for k in range(150)}
    for k in range(150, 200):
        base = sorted(sets[k - 150])
        sets[k] = set(base[pick.randint(0, 3) :]) | {f"w{pick.randint(0, 200)}" for _ in range(pick.randint(0, 4))}
    made = {}

    def kept(df, label, cut=similar.cut):
        out = cut(df, label)
        made[label] = out.count()
        return out

    monkeypatch.setattr(similar, "cut", kept)
    members, pairs = similar.similar_sets(spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id long, items array<string>"), percent)
    first = {}
    for k in sorted(sets):
        if sets[k]:
            first.setdefault(frozenset(sets[k]), k)
    assert {(r.id, r.cls) for r in members.collect()} == {(k, first[frozenset(v)]) for k, v in sets.items() if v}
    own = sorted(first.values())
    want = {(a, b, len(sets[a] & sets[b])) for a in own for b in own if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    assert {(r.a, r.b, r.shared) for r in pairs.collect()} == want
    assert made["near"] <= 2 * len(want) + 5

"""The synonym bridge against the definition, member by member."""

import random

from glossarium.operators import bridge


def by_definition(members, similar, hits):
    best = {}
    for t, p, w, tier, score in hits:
        best.setdefault((t.lower(), p), []).append((score, w, tier))
    leads = {}
    for key, rows in best.items():
        own = leads.setdefault(key, {})
        for _, w, tier in sorted(rows)[:4]:
            own.setdefault(w, 2 if tier == 0 else 1)
    sets = {}
    for s, p, _, lemma, place in members:
        sets.setdefault((s, p), []).append((place, lemma.lower()))
    out = {}
    for lemma in {m[3] for m in members}:
        rows, n = [], 0
        for p in sorted({m[1] for m in members if m[3] == lemma}):
            if (lemma.lower(), p) in leads:
                continue
            used = 0
            for _, s in sorted({(m[2], m[0]) for m in members if m[3] == lemma and m[1] == p}):
                line = [c for _, c in sorted(sets[s, p])]
                if p == "a":
                    for o in sorted({b for a, b in similar if a == s}):
                        line += [c for _, c in sorted(sets.get((o, "a"), []))]
                score, order = {}, {}
                for c in dict.fromkeys(line):
                    if c == lemma.lower() or " " in c:
                        continue
                    for w, points in leads.get((c, p), {}).items():
                        score[w] = score.get(w, 0) + points
                        order.setdefault(w, (len(order), c))
                words = sorted((order[w], w) for w, k in score.items() if k >= 2)[:6]
                if words and used < 3:
                    used += 1
                    for (_, via), w in words:
                        rows.append((p, s, n, w, via))
                        n += 1
        if rows:
            out[lemma] = rows
    return out


def test_by_definition(spark):
    for seed in range(3):
        rng = random.Random(seed)
        lemmas = [f"w{k}" for k in range(40)] + ["two words", "W3x"]
        members, at = [], 0
        for s in range(14):
            p = rng.choice("an")
            for lemma in rng.sample(lemmas, rng.randrange(1, 30 if s == 0 else 7)):
                members.append((f"s{s:02}", p, rng.randrange(5), lemma, at))
                at += 1
        adjectives = sorted({m[0] for m in members if m[1] == "a"})
        similar = [(rng.choice(adjectives), rng.choice(adjectives)) for _ in range(6)] if adjectives else []
        hits = [(rng.choice(lemmas[:25]), rng.choice("an"), f"k{rng.randrange(12)}", rng.randrange(2), k) for k in range(160)]
        got = {}
        rows = bridge.bridged(
            spark.createDataFrame(members, "synset string, pos string, n int, lemma string, place long"),
            spark.createDataFrame(similar, "synset string, other string"),
            spark.createDataFrame(hits, "term string, pos string, word string, tier int, score long"),
        )
        for r in rows.collect():
            got.setdefault(r.lemma, []).append((r.pos, r.synset, r.n, r.word, r.via))
        assert {k: sorted(v, key=lambda x: x[2]) for k, v in got.items()} == by_definition(members, similar, hits)

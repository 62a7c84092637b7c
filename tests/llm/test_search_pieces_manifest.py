"""Lexical search, SentencePiece and the Merkle manifest against definitions in plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from glossarium.llm import op11_lexical_search as op11
from glossarium.llm import op12_sentencepiece as op12
from glossarium.llm import op13_merkle_manifest as op13

DOCS = "doc_id long, text string, score long, rank int, item_id long, `a b` string"


def sentences(rng, n, kinds=60):
    return " ".join(rng.choice(["", "É", "Ж"]) + "".join(rng.choice("abC9") for _ in range(1 + k % 4)) + rng.choice(["", ".", "-x", "_"]) for k in (rng.randrange(kinds) for _ in range(n)))


def corpus():
    rng = random.Random(3)
    rows = [(k, sentences(rng, rng.randrange(60))) for k in range(120)]
    rows += [(None, rows[3][1]), (500, rows[3][1]), (500, rows[3][1]), (501, None), (502, ""), (503, " .,\n"), (504, sentences(rng, 9000)), (-1, rows[3][1]), (None, None)]
    return rows


def items():
    rng = random.Random(4)
    return [(k, sentences(rng, 1 + k % 9)) for k in range(40)] + [(7, "a a b"), (7, "a a b"), (90, None), (91, ""), (92, "nowhere"), (None, "a b C9a")]


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, asked, top, once):
    own = [(i, terms(t)) for i, t in docs]
    n_docs, words = sum(bool(t) for _, t in own), sum(len(t) for _, t in own)
    df = Counter(x for _, t in own for x in set(t))
    out = Counter()
    for item, text in set(asked):
        query = Counter(terms(text))
        scored = []
        for doc, t in own:
            tf, score = Counter(t), 0
            m = 10 + 90 * len(t) * n_docs // words if words else 0
            for x, times in query.items():
                if tf[x]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                    score += w * ((1000000000 * tf[x]) // (1000 * tf[x] + 8 * m)) * (1 if once else times)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out.update((item, k + 1, doc, -score) for k, (score, _, _, doc) in enumerate(sorted(scored, key=lambda x: x[:3])[:top]))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, 7, 7, "x") for i, t in rows], DOCS)


@pytest.mark.parametrize("how", [op11.Ranking(), op11.Ranking(top=3, item_bytes=100, spread=2), op11.Ranking(once=False)])
def test_search_by_formula(spark, how):
    asked = spark.createDataFrame([(i, t, 1) for i, t in items()], "item_id long, text string, doc_id long")
    got = op11.search(frame(spark, corpus()).repartition(5), asked, how)
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()) == ranked(corpus(), items(), how.top, how.once)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]


def test_search_without_rows(spark):
    asked = spark.createDataFrame(items(), "item_id long, text string")
    docs = frame(spark, corpus())
    for d, q in ((docs.limit(0), asked), (docs, asked.limit(0)), (docs.filter("text IS NULL"), asked), (docs, asked.filter("item_id IN (90, 91, 92)"))):
        assert op11.search(d, q).count() == 0


def test_best_rows_survive_many_blocks(monkeypatch):
    """What a task keeps between blocks are the first of each item, ties by id."""
    import numpy as np

    rng = np.random.default_rng(1)
    item, place, score = rng.integers(0, 5, 4000), rng.permutation(4000), rng.integers(0, 30, 4000)
    got = op11.best(item, place, score, 10)
    want = [k for i in range(5) for k in sorted(np.nonzero(item == i)[0], key=lambda k: (-score[k], place[k]))[:10]]
    assert got.tolist() == want


def odd_texts():
    rng = random.Random(9)
    model = op12.model(public_tokenizers.path(op12.MODEL))
    pieces = list(model.normal)
    made = ["", " ", "  a  b ", "▁a", "\0x", "<s>", "<0x41>", "日本語 學", "\n\t", "é" * 50, "x" * 5000, " " * 3000, "🙂" * 20, "the" * 2000]
    made += ["".join(rng.choice(pieces).replace("▁", rng.choice([" ", "▁"])) for _ in range(rng.randrange(40))) for _ in range(60)]
    made += ["".join(rng.choice("etaoin  shr") for _ in range(rng.randrange(200))) for _ in range(60)]
    made += ["".join(chr(rng.choice([rng.randrange(0x250), rng.randrange(0xE000, 0x110000), rng.randrange(0x3000, 0xD7A4)])) for _ in range(rng.randrange(40))) for _ in range(60)]
    return made


def test_pieces_are_the_librarys(monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(op12.MODEL))
    for long, remembered in ((op12.LONG, op12.REMEMBERED), (8, 10)):  # the second way for long words, and forgetting
        monkeypatch.setattr(op12, "LONG", long)
        monkeypatch.setattr(op12, "REMEMBERED", remembered)
        encoder = op12.Encoder(public_tokenizers.path(op12.MODEL))
        for k in range(0, len(odd_texts()), 50):
            part = odd_texts()[k : k + 50]
            assert list(encoder.encode(part)) == [library.encode(t) for t in part]
    assert list(encoder.encode([None, ""])) == [[], []]


def test_pieces_on_spark(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(op12.MODEL))
    rows = list(enumerate(odd_texts())) + [(None, "null id"), (None, None), (5, "again"), (5, "again")]
    got = op12.sentence_pieces(frame(spark, rows), with_ids=True).collect()
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert all(len(r.ids) == r.n_tokens and hashlib.sha256(r.decoded.encode()).hexdigest() == r.decoded_sha256 for r in got)
    assert op12.sentence_pieces(frame(spark, []).limit(0)).count() == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def up(nodes):
    """All levels of a tree over digests, and the siblings of each leaf by level: (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 16] for k in range(0, len(nodes), 16)]
        for k, a in enumerate(at):
            run = runs[a // 16]
            paths[k].append(("".join(run[: a % 16]), "".join(run[a % 16 + 1 :])))
        nodes, at = [sha("".join(run)) for run in runs], [a // 16 for a in at]
    return nodes[0], paths


def manifest_by_hand(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    groups = {}
    for i, s, lang, n, t in rows:
        h = sha("".join(map(part, (i, s, lang, n, t))))
        tampered = sha("".join(map(part, (i, s, lang, n, low(t))))) if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else None
        groups.setdefault(s, []).append((i is not None, i or 0, h, i, tampered))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: up([x[2] for x in sorted(groups[s], key=lambda x: (x[:3], x[4] or ""))]) for s in names}
    root, tops = up([trees[s][0] for s in names])
    out = Counter()
    for s, top in zip(names, tops):
        for (_, _, h, i, tampered), path in zip(sorted(groups[s], key=lambda x: (x[:3], x[4] or "")), trees[s][1]):
            whole = path + top
            acc = tampered or h
            for a, b in whole:
                acc = sha(a + acc + b)
            out[i, h, trees[s][0], root, sha("".join(a + b for a, b in whole)), acc, acc == root] += 1
    return out


def documents(sizes):
    rng = random.Random(6)
    rows = []
    for s, n in sizes.items():
        rows += [(rng.randrange(10**6), s, rng.choice(["en", None]), rng.choice([None, 3]), rng.choice([None, "", "Abc É", "low", "Z" * 50 + str(rng.random())])) for _ in range(n)]
    return rows


@pytest.mark.parametrize(
    "sizes, more",
    [
        ({"a": 300, None: 17, "b": 1, "é": 16, "": 33, "zz": 2}, [(None, "a", None, None, "X"), (None, "a", None, None, "X"), (7, "a", "en", 1, "T"), (7, "a", "en", 1, "T"), (7, "a", "en", 1, "other")]),
        ({f"s{k}": 1 + k % 3 for k in range(40)}, []),
        ({"only": 5}, []),
        ({"only": 1}, []),
    ],
)
def test_manifest_by_hand(spark, sizes, more):
    rows = documents(sizes) + more
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, idx int").repartition(5)
    got = op13.manifest(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert Counter(tuple(r) for r in got.collect()) == manifest_by_hand(rows)


def test_manifest_without_rows(spark):
    df = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    got = op13.manifest(df)
    assert got.count() == 0 and got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_tampering_shows(spark):
    rows = [(k, "s", "en", 1, "Upper" if k % 2 else "lower") for k in range(60)]
    got = op13.manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))
    touched = {k for k in range(60) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert {r.doc_id for r in got.filter(~F.col("verified")).collect()} == {k for k in touched if k % 2}

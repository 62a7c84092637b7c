"""Each stage of the pipeline against its definition, on rows with null and repeated ids, ties, repeated rows and columns with clashing names; and the classifiers on Spark."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glossarium.llm import op3_toxicity as op3
from glossarium.llm import op4_quality as op4
from glossarium.llm import op6_suffix_array as op6
from glossarium.llm import op10_jaccard_join as op10
from tests.llm.test_ops import BIG, lines_kept, words

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, key int, score double, c0 string, doc long, `keys` string"
NAMES = [x.split()[0].strip("`") for x in SCHEMA.split(", ")]


def texts():
    rng = random.Random(21)
    line, passage, base = "this line is in very many documents", words(rng, 50, 10**6), words(rng, 90, 10**6)
    near = base.split(" ")
    near[3] = "changed"
    rows = [(1, base), (2, " ".join(near)), (3, base), (None, base), (None, base), (4, base + " "), (None, None), (5, None), (6, ""), (6, "")]
    rows += [(k, f"{words(rng, 30, 10**6)}\n{line}\n{words(rng, 4, 10**6)}") for k in (BIG, BIG + 1, BIG + 1, None)]
    rows += [(20, passage + " " + words(rng, 20, 10**6)), (21, words(rng, 20, 10**6) + " " + passage), (None, words(rng, 9, 10**6) + passage), (22, "x " * 30)]
    rows += [rows[-2], rows[0], (3, words(rng, 60, 10**6))]
    return [(i, t and t.replace("é", "e")) for i, t in rows]  # so that bytes are characters


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", 0, "a", k, 0.5, "b", 7, "c") for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, texts())


STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stage_keeps_columns_and_takes_empty_tables(name, spark, docs):
    got = STAGES[name](spark, docs.limit(0), SF)
    assert got.columns == NAMES and got.count() == 0
    assert [f.dataType for f in STAGES[name](spark, docs, SF).schema] == [f.dataType for f in docs.schema]


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_toxicity(spark, docs):
    model = op3.train(spark, SF, docs)
    want = [(i, t) for i, t in texts() if op3.score([t], model, op3.Toxicity().width)[0] < 0.5]
    got = corpus_pipeline.reject_toxic(spark, docs, SF)
    assert rows_of(got) == Counter(want)
    assert {r.key for r in got.collect()} <= set(range(len(texts())))


def test_line_dedup(spark, docs):
    got = corpus_pipeline.drop_repeated_lines(spark, docs, SF)
    want = Counter((i, kept if gone else t) for (i, t), (_, gone, kept) in zip(texts(), lines_kept(texts())))
    assert rows_of(got) == want
    assert all(r.n_chars == len(r.text or "") for r in got.collect())


def test_near_duplicates(spark, docs):
    own = texts()
    groups = {}
    least = op10.brute_force([(k, t) for k, (_, t) in enumerate(own)], 5, 80)
    want = []
    for k, (i, t) in enumerate(own):
        if (t or "").split():
            groups.setdefault(least[k], []).append((i is None, i or 0, hashlib.sha256(t.encode()).digest(), k))
        else:
            want.append((i, t))
    want += [own[min(g)[3]] for g in groups.values()]
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert rows_of(got) == Counter(want)


def test_repeated_passages(spark, docs):
    got = corpus_pipeline.drop_repeated_passages(spark, docs, SF)
    want = Counter((i, x[0] - x[1], x[3]) for (i, _), x in zip(texts(), op6.brute_force(texts())))
    assert Counter((r.doc_id, len(r.text), hashlib.sha256(r.text.encode()).hexdigest()) for r in got.collect()) == want


def test_packing(spark, docs):
    got = corpus_pipeline.pack(spark, docs, SF)
    assert Counter(r.doc_id for r in got.filter("start = 0").collect()) == Counter(i for i, _ in texts())
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
    assert STAGES["packing"](spark, docs.limit(0), SF).count() == 0


def labels(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("op", [op3, op4])
def test_classifiers_on_spark(op, spark, tmp_path):
    """Long texts teach and are scored whole; null, clashing and missing labels, null and repeated ids don't harm."""
    rng = random.Random(2)
    bad = lambda n: " ".join(w + ("$$$ stupid" if k % 5 == 0 else "") for k, w in enumerate(words(rng, 2 * n).split(" ")))
    rows = [(k, words(rng, 3000 if k % 4 == 0 else 60)) for k in range(0, 120, 2)] + [(k, bad(1500 if k % 3 == 0 else 30)) for k in range(1, 121, 2)]
    odd = [(None, words(rng, 50)), (None, None), (500, ""), (500, words(rng, 20)), (BIG, bad(20)), (BIG + 1, words(rng, 4000) + " stupid$$$ worthless$$$ " * 3)]
    d = spark.createDataFrame([(i, t, 0.0, "x") for i, t in rows + odd], "doc_id long, text string, score double, predicted string")
    marks = [(k, int(k % 2 == 0), int(k % 2 == 1)) for k in range(121)] + [(None, 1, 1), (500, None, None), (7, 1, 0), (500, 2, 2)]
    folder = labels(spark, tmp_path, marks)
    d.write.parquet(f"{folder}/documents.parquet")
    got = op.query(spark, folder).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows + odd)
    assert all(0 <= r.score <= 1 for r in got)
    wrong = [r.doc_id for r in got if r.doc_id is not None and r.doc_id < 121 and r.doc_id != 7 and r.predicted != (r.doc_id % 2 if op is op3 else 1 - r.doc_id % 2)]
    assert len(wrong) <= 3
    assert {r.doc_id: r.predicted for r in got if r.doc_id in (BIG,)} == {BIG: 1 if op is op3 else 0}
    assert op.query(spark, folder).filter("held_out").count() > 10


@pytest.mark.parametrize("op", [op3, op4])
def test_classifiers_without_labels_or_rows(op, spark, tmp_path):
    folder = labels(spark, tmp_path, [(None, None, None)])
    spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    assert [r.predicted for r in op.query(spark, folder).collect()] == [0, 0]
    spark.createDataFrame([], "doc_id long, text string").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    assert op.query(spark, folder).count() == 0


def test_long_texts_teach_stretches_of_the_whole():
    from glossarium.llm.subword import stretches

    w = [str(k) for k in range(10_000)]
    got = stretches(w, 2000)
    assert len(got) == 2000 and got[0] == "0" and got[-1] == "9999" and stretches(w[:2000], 2000) == w[:2000]

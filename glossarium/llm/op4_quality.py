"""Quality by supervised subword vectors.

A document is the mean of the hashed vectors of its words, of their character
n-grams and of its pairs of neighbouring words; a softmax on the mean gives
the odds of good quality. Words keep their case and punctuation, which carry
much of what sets junk apart. All pairs of a word with itself share one bucket
of their own, so that repetition is seen whatever word it is that repeats.

Fitting reads at most ``Quality.rows`` labelled rows of each class, each of
them whole: executors count a text's buckets, and what comes to the driver is
a row for each bucket that it has. Scoring reads every whole text. The model is
one array of fixed size. The sample holds the classes in the same number as far as they have it, so the odds are those of equal classes; with the usual threshold
of 0.3 a document is called bad only where that is clearly likelier.

Defined results: null texts, empty ones and those without words score 0; where
the labels have one class only, every score says that class, and without
labels every score is 0. Rows with a null id and repeated rows are scored one
by one; labels that are null, of a null id, or clash for one id teach nothing;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossarium.llm.common import WORD, id_remainder, per_row
from glossarium.llm.subword import Model, Shape, Trainer, in_parts, labelled_rows, ngram_buckets, sigmoid, word_buckets, word_sums


#: A text's buckets are counted so many words at a time.
PART_WORDS = 50_000


@dataclass(frozen=True)
class Quality:
    #: Most labelled rows of each class that fitting reads.
    rows: int = 2000
    rounds: int = 4
    batch: int = 64
    #: Small samples get more rounds, up to so many steps.
    least_steps: int = 300
    #: Pairs of words hash to this many buckets behind those of n-grams; the first is for pairs of equal words.
    pairs: int = 1 << 15
    shape: Shape = Shape(buckets=1 << 17, dim=8, least=3, most=4, word=True, seed=11)


def pair_buckets(words: np.ndarray, how: Quality) -> np.ndarray:
    """words: the words' own buckets, in the text's order."""
    a, b = words[:-1].astype(np.uint64), words[1:].astype(np.uint64)
    mixed = (a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)
    return how.shape.buckets + np.where(a == b, 0, 1 + (mixed % np.uint64(how.pairs - 1)).astype(np.int64))


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def bag(text: str | None, how: Quality) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a whole text, each once and ascending, and how often it has them: no more than there are buckets."""
    words, total = words_of(text), np.zeros(how.shape.buckets + how.pairs, np.int64)
    for k in range(0, len(words), PART_WORDS):
        part = words[k : k + PART_WORDS]
        found, _ = ngram_buckets(part, how.shape)
        for bucket, ok in found:
            total += np.bincount(bucket[ok], minlength=len(total))
        own = word_buckets(words[k : k + PART_WORDS + 1], how.shape)  # with the next part's first word, for the pair over the border
        total += np.bincount(own[: len(part)], minlength=len(total)) + np.bincount(pair_buckets(own, how), minlength=len(total))
    at = np.nonzero(total)[0]
    return at.astype(np.int32), total[at]


def fit(rows: Iterable[tuple[np.ndarray, np.ndarray, int]], how: Quality = Quality()) -> Model:
    """rows: the buckets of each text and how often it has them (bag), and its label."""
    bags, labels = [], []
    for items, times, y in rows:
        if len(items):
            bags.append((items, times))
            labels.append(y)
    both = Shape(how.shape.buckets + how.pairs, how.shape.dim, how.shape.least, how.shape.most, how.shape.word, how.shape.seed)
    if len(set(labels)) < 2:
        return Model(np.zeros(both.buckets, np.float32), -30.0 if not sum(labels) else 30.0, how.shape)
    y = np.array(labels)
    trainer = Trainer(both)
    rng = np.random.default_rng(how.shape.seed)
    for _ in range(max(how.rounds, -(-how.least_steps * how.batch // len(bags)))):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), how.batch):
            picked = order[k : k + how.batch]
            owner = np.repeat(np.arange(len(picked)), [len(bags[i][0]) for i in picked])
            trainer.step(np.concatenate([bags[i][0] for i in picked]), owner, y[picked], np.concatenate([bags[i][1] for i in picked]))
    got = trainer.model()
    return Model(got.weight, got.bias, how.shape)


def score(texts: Iterable[str | None], model: Model, how: Quality = Quality()) -> list[float]:
    out: list[float] = []
    for part in in_parts(WORD.findall(t or "") for t in texts):
        words = [w for t in part for w in t]
        sums, counts = word_sums(words, model) if words else (np.zeros(0), np.zeros(0, np.int64))
        own = word_buckets(words, how.shape)
        k = 0
        for t in part:
            if t:
                n = len(t)
                total = sums[k : k + n].sum() + model.weight[pair_buckets(own[k : k + n], how)].sum()
                out.append(sigmoid(model.bias + total / (counts[k : k + n].sum() + n - 1)))
                k += n
            else:
                out.append(0.0)
    return out


def scores(docs: DataFrame, model: Model, how: Quality = Quality(), text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with one more column, the score of each whole text."""
    held = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias, model.shape))  # of fixed size

    def task():
        own = Model(*held.value)
        return lambda texts: ((x,) for x in score(texts, own, how))

    return per_row(docs, task, f"`{out_col}` double", keep=docs.columns, read=(text_col,))


def train(spark: SparkSession, sf_dir: str, docs: DataFrame, how: Quality = Quality()) -> Model:
    def packed(text: str) -> tuple[bytes, bytes]:
        items, times = bag(text, how)
        return items.tobytes(), times.tobytes()

    rows = labelled_rows(spark, sf_dir, "quality", docs, how.rows, packed, "items binary, times binary")
    return fit(((np.frombuffer(r["items"], np.int32), np.frombuffer(r["times"], np.int64), r["y"]) for r in rows), how)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scores(docs, train(spark, sf_dir, docs))
    return out.select("doc_id", (id_remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

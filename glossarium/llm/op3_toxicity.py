"""Toxicity by subword bags.

A text is read in windows of a few words. Each window is the mean of its
character n-grams' vectors, and the softmax on that mean says how toxic the
window is; a text is as toxic as its worst window, so that a single insult in
a long text counts. A misspelt insult shares most n-grams with the insult, and
so its vectors.

Training alternates: with the present vectors find the worst window of each
toxic text and the worst few of each other one, which must all be harmless,
then step on those windows with the texts' labels. The first rounds, when no
vectors are learnt yet, use random windows instead. The odds so learnt are
those of the sample's share of toxic texts; once fitted, the bias is moved to
equal shares, where a score of one half stands.

Fitting reads at most ``Toxicity.rows`` texts of each class, whatever their
length (see subword.labelled_sample); of a text over ``Toxicity.words`` words
it takes stretches dealt evenly over the whole, so that limit is far above
most texts, as a stretch left out may be the one that the label is about.
Scoring reads every whole text. The model is two arrays of fixed size.

Defined results: null or empty texts, and texts without words, get the score
that the bias alone gives, 0.25 at most; where the labels have one class only,
every score says that class, and without labels every score is 0. Rows with a
null id and repeated rows are scored one by one; labels that are null, of a
null id, or clash for one id teach nothing; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossarium.llm.common import id_remainder, per_row
from glossarium.llm.subword import Model, Shape, Trainer, Words, in_parts, labelled_sample, sigmoid, spread, windows, word_sums


@dataclass(frozen=True)
class Toxicity:
    rows: int = 1500
    #: Words of one text that fitting holds at most.
    words: int = 20_000
    width: int = 3
    warm_windows: int = 24
    warm_rounds: int = 2
    rounds: int = 8
    #: So many worst windows of a text that isn't toxic are stepped on each round.
    hard: int = 4
    batch: int = 256
    #: Small samples get more rounds, up to so many steps.
    least_steps: int = 150
    shape: Shape = Shape(buckets=1 << 17, dim=8, least=3, most=5, seed=3)


#: A word without what isn't a letter, digit or _ at either end; or a run of other characters.
_TOKEN = re.compile(r"\w(?:[^\x20\x09-\x0D]*\w)?|[^\x20\x09-\x0D\w]+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def fit(rows: Iterable[tuple[list[str], int]], how: Toxicity = Toxicity()) -> Model:
    """rows: the words of each text, and its label."""
    vocabulary = Words(how.shape)
    texts, labels = [], []
    for text, y in rows:
        ids = vocabulary.number(text)
        if len(ids):
            texts.append(ids.astype(np.int32))
            labels.append(y)
    trainer = Trainer(how.shape)
    if len(set(labels)) < 2:
        return Model(np.zeros(how.shape.buckets, np.float32), -30.0 if not sum(labels) else 30.0, how.shape)
    y = np.array(labels)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    words = np.concatenate(texts)
    items, begins = vocabulary.flat()
    sizes = np.diff(begins).astype(np.float64)
    rng = np.random.default_rng(how.shape.seed)

    def steps(at: np.ndarray, of: np.ndarray) -> None:
        """Steps on the windows that begin at words ``at`` of texts ``of``, in random batches."""
        order = rng.permutation(len(at))
        for k in range(0, len(order), how.batch):
            own = order[k : k + how.batch]
            begin = at[own]
            count = np.minimum(begin + how.width, starts[of[own] + 1]) - begin
            which = np.repeat(np.arange(len(own)), count)
            inside = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            place, owner = spread(begins, words[begin[which] + inside])
            trainer.step(items[place], which[owner], y[of[own]])

    length = np.diff(starts)
    for _ in range(max(how.warm_rounds, -(-how.least_steps * how.batch // (len(texts) * how.warm_windows)))):
        of = np.repeat(np.arange(len(texts)), how.warm_windows)
        steps(starts[of] + (rng.random(len(of)) * np.maximum(length[of] - how.width + 1, 1)).astype(np.int64), of)
    number = np.concatenate([[0], np.cumsum(sizes[words])])
    at = np.arange(len(words), dtype=np.int32)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), length)
    place = at - starts[:-1].astype(np.int32)[text]  # in its text; and among its text's windows, worst first
    end = np.minimum(at + how.width, starts[1:].astype(np.int32)[text])
    short = (end - at < how.width) & (place > 0)
    count = np.maximum(number[end] - number[at], 1).astype(np.float32)
    for _ in range(max(how.rounds, -(-how.least_steps * how.batch // len(texts)))):
        model = trainer.model()
        total = np.concatenate([[0], np.cumsum(np.add.reduceat(model.weight[items].astype(np.float64), begins[:-1])[words])])
        mean = np.where(short, -np.inf, (total[end] - total[at]) / count).astype(np.float32)
        worst = np.lexsort((-mean, text))
        keep = (place < np.where(y[text] == 1, 1, how.hard)) & np.isfinite(mean[worst])
        hit, of = worst[keep], text[keep]
        steps(hit, of)
    model = trainer.model()
    return Model(model.weight, model.bias + float(np.log((y == 0).sum() / (y == 1).sum())), model.shape)


def score(texts: Iterable[str | None], model: Model, width: int) -> list[float]:
    out: list[float] = []
    for part in in_parts(map(tokens, texts)):
        words = [w for t in part for w in t]
        sums, counts = word_sums(words, model) if words else (np.zeros(0), np.zeros(0, np.int64))
        k = 0
        for t in part:
            if t:
                out.append(sigmoid(model.bias + float(windows(sums[k : k + len(t)], counts[k : k + len(t)], width).max())))
            else:
                out.append(min(sigmoid(model.bias), 0.25))
            k += len(t)
    return out


def scores(docs: DataFrame, model: Model, width: int, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with one more column, the score of each whole text."""
    held = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias, model.shape))  # of fixed size

    def task():
        own = Model(*held.value)
        return lambda texts: ((x,) for x in score(texts, own, width))

    return per_row(docs, task, f"`{out_col}` double", keep=docs.columns, read=(text_col,))


def train(spark: SparkSession, sf_dir: str, docs: DataFrame, how: Toxicity = Toxicity()) -> Model:
    return fit(labelled_sample(spark, sf_dir, "toxic", docs, how.rows, how.words, tokens), how)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    how = Toxicity()
    out = scores(docs, train(spark, sf_dir, docs, how), how.width)
    return out.select("doc_id", (id_remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""Subword vectors averaged into a linear softmax, trained in numpy.

A word is the bag of its hashed character n-grams (and, if asked for, of the
word itself). Each bucket of the hash has a vector; a stretch of text is the
mean of its buckets' vectors, and a softmax over two classes stands on that
mean. Vectors and softmax are trained together by stochastic gradient descent.

For scoring the softmax is folded into the vectors: the difference of the two
logits is the mean of one number per bucket, so a model is two small arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import xxhash


@dataclass(frozen=True)
class Shape:
    #: A power of two.
    buckets: int = 1 << 17
    dim: int = 8
    least: int = 3
    most: int = 5
    word: bool = False
    seed: int = 0


@dataclass
class Model:
    """weight[b] is bucket b's part of the log odds; bias is what every stretch of text starts from."""

    weight: np.ndarray
    bias: float
    shape: Shape


_MUL, _FIN = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


def ngram_buckets(words: Sequence[str], shape: Shape) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each size of n-gram: the bucket at each character of the marked words, and whether such an n-gram lies inside one word there; then the marked words' lengths."""
    codes = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    left = (np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))).astype(np.int32)
    shift = np.uint32(32 - (shape.buckets.bit_length() - 1))
    h = np.full(len(codes), shape.seed + 1, np.uint32)
    out = []
    for size in range(1, shape.most + 1):
        h = (h[: len(codes) - size + 1] + codes[size - 1 :]) * _MUL
        h ^= h >> np.uint32(15)
        if size >= shape.least:
            out.append(((h * _FIN) >> shift, left[: len(h)] >= size))
    return out, sizes


def word_buckets(words: Sequence[str], shape: Shape) -> np.ndarray:
    h, s = xxhash.xxh32_intdigest, shape.seed + 1
    return np.fromiter((h(w, s) for w in words), np.int64, len(words)) % shape.buckets


class Words:
    """Numbers words as they come; then gives the buckets of each, as a ragged array."""

    def __init__(self, shape: Shape):
        self.shape = shape
        self.ids: dict[str, int] = {}

    def number(self, words: Iterable[str]) -> np.ndarray:
        ids = self.ids
        return np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """All buckets one after the other, and where each word's begin (with the end)."""
        words = list(self.ids)
        found, sizes = ngram_buckets(words, self.shape)
        owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        items = [b[ok].astype(np.int32) for b, ok in found]
        owners = [owner[: len(ok)][ok] for _, ok in found]
        if self.shape.word:
            items.append(word_buckets(words, self.shape).astype(np.int32))
            owners.append(np.arange(len(words), dtype=np.int32))
        owners = np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        starts = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bincount(owners, minlength=len(words)), out=starts[1:])
        return np.concatenate(items)[order], starts


def word_sums(words: Sequence[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The sum of weights and the number of buckets of each word."""
    found, sizes = ngram_buckets(words, model.shape)
    at = np.zeros(int(sizes.sum()), np.float32)
    count = np.zeros(len(words), np.int64)
    for size, (bucket, ok) in enumerate(found, model.shape.least):
        at[: len(ok)] += model.weight.take(bucket) * ok
        count += np.maximum(sizes - size + 1, 0)
    sums = np.add.reduceat(at, np.cumsum(sizes) - sizes).astype(np.float64)
    if model.shape.word:
        sums += model.weight[word_buckets(words, model.shape)]
        count += 1
    return sums, count


def in_parts(texts: Iterable[list[str]], most: int = 20_000) -> Iterable[list[list[str]]]:
    """Lists of words in parts of about ``most`` words together, so that short texts share the work of one call."""
    part: list[list[str]] = []
    n = 0
    for words in texts:
        part.append(words)
        n += len(words)
        if n >= most:
            yield part
            part, n = [], 0
    if part:
        yield part


def spread(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of a ragged array: the positions of all their items, and the row (0, 1, ...) of each."""
    counts = starts[rows + 1] - starts[rows]
    owner = np.repeat(np.arange(len(rows)), counts)
    first = np.cumsum(counts) - counts
    return starts[rows][owner] + np.arange(len(owner)) - first[owner], owner


class Trainer:
    """Vectors and softmax, with AdaGrad steps."""

    def __init__(self, shape: Shape, rate: float = 0.3):
        rng = np.random.default_rng(shape.seed + 7)
        self.shape, self.rate, self.rng = shape, rate, rng
        self.v = rng.uniform(-1 / shape.dim, 1 / shape.dim, (shape.buckets, shape.dim)).astype(np.float32)
        self.w = rng.normal(0, 0.3, (shape.dim, 2)).astype(np.float32)
        self.b = np.zeros(2, np.float32)
        self.where = np.zeros(shape.buckets, np.int64)
        self.seen = np.full(shape.buckets, 1e-4, np.float32)
        self.seen_w = np.full((shape.dim, 2), 1e-2, np.float32)

    def step(self, items: np.ndarray, owner: np.ndarray, labels: np.ndarray, amount: np.ndarray | None = None) -> None:
        """One step on stretches 0..len(labels)-1; item k is a bucket of stretch owner[k], counted amount[k] times."""
        n, d = len(labels), self.shape.dim
        amount = np.ones(len(items), np.float32) if amount is None else amount.astype(np.float32)
        size = np.maximum(np.bincount(owner, amount, n), 1e-9).astype(np.float32)
        share = amount / size[owner]
        ids = np.nonzero(np.bincount(items, minlength=self.shape.buckets))[0]
        self.where[ids] = np.arange(len(ids))
        where = self.where[items]
        vec = self.v[ids]
        mean = np.empty((n, d), np.float32)
        for k in range(d):
            mean[:, k] = np.bincount(owner, share * vec[where, k], n)
        z = mean @ self.w + self.b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), labels] -= 1
        p /= n
        back = p @ self.w.T
        grad = np.empty((len(ids), d), np.float32)
        for k in range(d):
            grad[:, k] = np.bincount(where, share * back[owner, k], len(ids))
        self.seen[ids] += (grad**2).mean(1)
        self.v[ids] -= self.rate * grad / np.sqrt(self.seen[ids])[:, None]
        grad_w = mean.T @ p
        self.seen_w += grad_w**2
        self.w -= self.rate * grad_w / np.sqrt(self.seen_w)
        self.b -= self.rate * p.sum(0)

    def model(self) -> Model:
        return Model((self.v @ (self.w[:, 1] - self.w[:, 0])).astype(np.float32), float(self.b[1] - self.b[0]), self.shape)


def sigmoid(z: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def windows(sums: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """The mean weight in the window of ``width`` words from each word on (shorter at the end)."""
    n = len(sums)
    s, c = np.concatenate([[0], np.cumsum(sums)]), np.concatenate([[0], np.cumsum(counts)])
    last = max(n - width, 0)
    at = np.arange(last + 1)
    end = np.minimum(at + width, n)
    return (s[end] - s[at]) / np.maximum(c[end] - c[at], 1)


def stretches(words: list[str], most: int, size: int = 100) -> list[str]:
    """All the words, or where there are more than ``most`` of them stretches of ``size`` words, dealt evenly over the whole text."""
    if len(words) <= most:
        return words
    number = most // size
    step = (len(words) - size) / (number - 1)
    return [w for k in range(number) for w in words[int(k * step) : int(k * step) + size]]


def labelled_rows(spark, sf_dir: str, label: str, docs, most_rows: int, made: Callable[[str], tuple], added: str) -> Iterator:
    """What made() gives for each of at most most_rows labelled rows of each class, from rows that aren't held out, with the label ``y``.

    Ids are chosen by a hash, and of the rows of one id each different text is
    a row; rows beyond the limit are passed over as they come. Executors apply
    made() to whole texts, and its columns come to the driver a partition at a
    time. Labels that are null or clash for one id are left out.
    """
    from pyspark.sql import functions as F

    from glossarium.llm.common import id_remainder, per_row

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    labels = labels.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (id_remainder(F.col("doc_id")) != 0))
    labels = labels.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").select("doc_id", F.col("y").cast("int").alias("y"), F.xxhash64("doc_id").alias("o"))
    each = [labels.filter(F.col("y") == y).orderBy("o", "doc_id").limit(most_rows) for y in (0, 1)]
    wanted = F.broadcast(each[0].unionByName(each[1]))  # 2 * most_rows ids at most
    texts = docs.select(F.col("doc_id").alias("d"), "text").filter(F.col("text").isNotNull()).join(wanted, F.col("d") == F.col("doc_id")).select("y", "o", "doc_id", "text")
    texts = texts.withColumn("th", F.sha2("text", 256)).dropDuplicates(["doc_id", "th"])
    rows = per_row(texts, lambda: lambda batch: map(made, batch), added, keep=("y", "o", "doc_id", "th"))
    had = [0, 0]
    for row in rows.orderBy("o", "doc_id", "th").toLocalIterator():
        if had[row["y"]] < most_rows:
            had[row["y"]] += 1
            yield row


def labelled_sample(spark, sf_dir: str, label: str, docs, most_rows: int, most_words: int, words) -> Iterator[tuple[list[str], int]]:
    """The words of labelled rows; of a text with more than most_words words, stretches dealt evenly over the whole of it."""
    for row in labelled_rows(spark, sf_dir, label, docs, most_rows, lambda t: (" ".join(stretches(words(t), most_words)),), "words string"):
        yield row["words"].split(" ") if row["words"] else [], row["y"]

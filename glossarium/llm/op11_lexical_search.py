"""Ranked lexical search as a blocked product of sparse integer matrices.

The items are one matrix (item by term: how often an item has a term), the
documents the other (term by document: int64 impacts). Items come in blocks of
bounded bytes; a block's terms are the columns that its product needs. Slices
of documents become blocks of the second matrix in one pass over the texts:
how often each document has each of these terms, and how many terms it has in
all. Sums over these blocks give N, L and the document frequencies; then each
task reads its blocks again, turns counts into impacts and multiplies: a row of
the product is the sum of the rows of the second matrix that the item's terms
name, merged into one dense int64 row as long as the block (Gustavson). Of each
row only the k best stay, of all blocks of a task again the k best, and Spark
reduces those in two steps.

Nothing about a document is left out before its score is known, and scores are
integers, so that the result doesn't depend on how documents are dealt. What a
task holds is a block; what the driver holds is one block of items and a count
for each of its terms.

Defined results: null or empty texts have no terms, and match nothing; a text
is read whole. Items with the same id and another text are items of their own,
rows that repeat both are one. Documents that repeat an id are ranked one by
one; a null id comes last among equal scores. Items without a match, and empty
tables, give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossarium.llm.common import cut, id_and_text, slices, uncut

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
BLOCK = "ids array<long>, totals binary, ends binary, terms binary, times binary, docs long, words long"
FOUND = "item int, doc_id long, score long"


@dataclass(frozen=True)
class Ranking:
    top: int = 10
    #: Fixed values of the formula: weight of the length in percent, and the scales of weights and impacts.
    length_percent: int = 90
    weight_scale: int = 1000
    impact_scale: int = 1_000_000_000
    #: An item's term counts once, or as often as the item has it.
    once: bool = True
    #: Items are taken in blocks of about so many bytes of text.
    item_bytes: int = 4 << 20
    #: So many groups of an item's rows are reduced before the last step.
    spread: int = 32


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of characters beyond ASCII; only A-Z become lower case."""
    return TERM.findall((text or "").encode("utf-8", "surrogatepass").lower())


def item_blocks(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[int | None, str]]]:
    """The distinct (id, text), block by block; the driver holds one of them."""
    items = id_and_text(items, id_col, text_col).filter("text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    n = max(1, math.ceil(size / most))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)))
    for k in range(n):
        yield [(r.doc_id, r.text) for r in dealt.filter(F.col("block") == k).collect()]


def document_blocks(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """The documents' matrix in blocks: by document the numbers of the terms that it has of the vocabulary, and how often."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            for part in slices(batch, "text"):
                totals, ends, terms, times = [], [], [], []
                for text in part.column("text").to_pylist():
                    found = terms_of(text)
                    totals.append(len(found))
                    own = sorted((t, n) for t, n in ((number(t), n) for t, n in Counter(found).items()) if t is not None)
                    terms += [t for t, _ in own]
                    times += [n for _, n in own]
                    ends.append(len(terms))
                ids = part.column("doc_id")
                row = [pa.array([ids.to_pylist()], pa.list_(pa.int64()))]
                row += [pa.array([np.array(x, kind).tobytes()], pa.binary()) for x, kind in ((totals, np.int64), (ends, np.int64), (terms, np.int32), (times, np.int64))]
                row += [pa.array([x], pa.int64()) for x in (sum(n > 0 for n in totals), sum(totals))]
                yield pa.RecordBatch.from_arrays(row, names=["ids", "totals", "ends", "terms", "times", "docs", "words"])

    return docs.mapInArrow(run, BLOCK)


def frequencies(blocks: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for batch in batches:
            for raw in batch.column("terms").to_pylist():
                sums += np.bincount(np.frombuffer(raw, np.int32), minlength=size)
        there = np.nonzero(sums)[0]
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(sums[there], pa.int64())], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for r in blocks.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row a term of the block of items
        out[r.term] = r.df
    return out


def weights(df: np.ndarray, n_docs: int, how: Ranking) -> np.ndarray:
    return np.array([math.floor(how.weight_scale * math.log((2 * n_docs + 2) / (2 * int(f) + 1))) for f in df], np.int64)


def best(item: np.ndarray, place: np.ndarray, score: np.ndarray, top: int) -> np.ndarray:
    """Which of these rows are among the first of their item: by score, then by place."""
    order = np.lexsort((place, -score, item))
    item = item[order]
    begins = np.maximum.accumulate(np.where(np.append(True, item[1:] != item[:-1]), np.arange(len(item)), 0)) if len(item) else item
    return order[np.arange(len(item)) - begins < top]


def multiplied(batches: Iterator[pa.RecordBatch], rows: list[list[tuple[int, int]]], weight: np.ndarray, n_docs: int, words: int, how: Ranking) -> Iterator[pa.RecordBatch]:
    """The best documents of each item over the blocks of a task: rows are the items' (term, times)."""
    nothing = np.zeros(0, np.int64)
    kept, held = (nothing, nothing, nothing), 0  # item, doc_id with null as the largest, score
    null = np.iinfo(np.int64).max

    for batch in batches:
        for block in batch.to_pylist():
            totals, ends = np.frombuffer(block["totals"], np.int64), np.frombuffer(block["ends"], np.int64)
            terms, times = np.frombuffer(block["terms"], np.int32), np.frombuffer(block["times"], np.int64)
            if not len(terms):
                continue
            ids = np.array([null if i is None else i for i in block["ids"]], np.int64)
            order = np.argsort(ids, kind="stable")  # by place is by id
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            length = np.array([100 - how.length_percent + how.length_percent * n * n_docs // words for n in totals.tolist()], np.int64)
            doc = np.repeat(np.arange(len(ids)), np.diff(ends, prepend=0))
            impact = weight[terms] * (how.impact_scale * times // (1000 * times + 8 * length[doc]))
            by_term = np.argsort(terms, kind="stable")
            column, value = place[doc[by_term]], impact[by_term]
            begin = np.searchsorted(terms[by_term], np.arange(len(weight) + 1))
            found = [kept]
            for k, row in enumerate(rows):
                merged = np.zeros(len(ids), np.int64)
                for term, count in row:
                    a, b = begin[term], begin[term + 1]
                    if a < b:
                        merged[column[a:b]] += value[a:b] * count
                at = np.nonzero(merged > 0)[0]
                if len(at) > how.top:
                    least = np.partition(merged[at], -how.top)[-how.top]
                    at = at[merged[at] >= least]
                    if len(at) > how.top:
                        at = at[np.argsort(-merged[at], kind="stable")[: how.top]]
                if len(at):
                    found.append((np.full(len(at), k), ids[order[at]], merged[at]))
            kept = tuple(np.concatenate(x) for x in zip(*found))
            if len(kept[0]) > 2 * held + 4096:
                stays = best(*kept, how.top)
                kept, held = tuple(x[stays] for x in kept), len(stays)
    stays = best(*kept, how.top)
    item, doc, score = (x[stays] for x in kept)
    yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64(), mask=doc == null), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])


def search(docs: DataFrame, items: DataFrame, how: Ranking = Ranking(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's best documents."""
    spark = docs.sparkSession
    docs = id_and_text(docs, id_col, text_col)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in item_blocks(items, item_col, item_text, how.item_bytes):
        counts = [Counter(terms_of(text)) for _, text in block]
        vocabulary = {t: k for k, t in enumerate(sorted({t for c in counts for t in c}))}
        if not vocabulary:
            continue
        rows = [[(vocabulary[t], 1 if how.once else n) for t, n in sorted(c.items())] for c in counts]
        blocks = cut(document_blocks(docs, vocabulary), "blocks")
        sums = blocks.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
        if not sums["words"]:
            uncut(blocks)
            continue
        weight = weights(frequencies(blocks, len(vocabulary)), sums["docs"], how)
        shared = spark.sparkContext.broadcast((rows, weight, sums["docs"], sums["words"], how))
        found = blocks.mapInArrow(lambda batches, shared=shared: multiplied(batches, *shared.value), FOUND)
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        spread = F.pmod(F.xxhash64("doc_id"), F.lit(how.spread))
        found = found.withColumn("spread", spread).withColumn("rank", F.row_number().over(Window.partitionBy("item", "spread").orderBy(*order))).filter(F.col("rank") <= how.top)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= how.top)
        named = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], "item int, item_id long")
        found = cut(found.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score"), "ranked")
        uncut(blocks)
        out = out.unionByName(found)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL
), l AS MATERIALIZED (SELECT row, doc_id, len(terms) AS n FROM t WHERE len(terms) > 0),
s AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS words FROM l),
q AS MATERIALIZED (
  SELECT DISTINCT item, item_id, term FROM (SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark))
), p AS MATERIALIZED (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY row, term
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s
), i AS MATERIALIZED (
  SELECT p.row, p.term, l.doc_id, w.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * l.n * s.n_docs) // s.words))) AS impact
  FROM p JOIN l USING (row) JOIN w USING (term), s
), c AS (
  SELECT q.item, q.item_id, i.row, i.doc_id, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY ALL
), r AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score FROM c WHERE score > 0
)
SELECT * FROM r WHERE rank <= 10
"""

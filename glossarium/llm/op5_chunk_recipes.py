"""Exact duplicates by content-defined chunk recipes.

The normalised text is cut where a hash of the bytes just before says so, so
equal stretches are cut alike wherever they stand. Each chunk is moved once
per map task that has it, to check that its 128-bit identifier stands for one
string of bytes only; were two strings to share one, all chunks are named
anew with another seed. After that a document is its recipe, the list of
identifiers in order, and documents are equal when their recipes are: whole
texts move no further.

Defined results: a null text counts as empty, and all empty texts are equal;
of rows that repeat both text and doc_id one is kept; a null doc_id comes
after every other; a table without rows gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossarium.llm.common import cut, id_and_text, join_hot, per_row

#: A cut comes where the low bits of the hash are 0, about every 2 ** CUT_BITS bytes, but not within LEAST bytes of the last; and after MOST bytes at the latest.
CUT_BITS, LEAST, MOST = 11, 256, 16384
#: The white space that normalising deletes.
_SPACE = b" \t\n\x0b\x0c\r"


def normalise(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, _SPACE)


def cuts(data: bytes) -> list[int]:
    """Where the chunks of data end."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = np.frombuffer(data, np.uint8).astype(np.uint32) + np.uint32(0x51)
    for size, mul in ((1, 0x9E3779B1), (2, 0x85EBCA77), (4, 0xC2B2AE3D), (8, 0x27D4EB2F)):  # each step doubles the bytes that h covers, to 16
        h = h[:-size] * np.uint32(mul) + h[size:]
    places = np.nonzero(h >> np.uint32(32 - CUT_BITS) == 0)[0] + 16
    ends, last = [], 0
    for p in [*places.tolist(), n]:
        while p - last > MOST:
            last += MOST
            ends.append(last)
        if p - last >= LEAST or p == n and p > last:
            last = p
            ends.append(p)
    return ends


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def chunk_table(docs: DataFrame, seed: int) -> DataFrame:
    """(id, chunk) for each distinct chunk of each map task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: dict[bytes, bytes] = {}
            for text in pdf["text"]:
                for c in chunks(normalise(text)):
                    found.setdefault(c, xxhash.xxh3_128_digest(c, seed))
            yield pd.DataFrame({"id": list(found.values()), "chunk": list(found)})

    return docs.select("text").mapInPandas(run, "id binary, chunk binary")


def recipe_table(docs: DataFrame, seed: int) -> DataFrame:
    def make(texts: list) -> Iterator[tuple]:
        for text in texts:
            data = normalise(text)
            yield len(text or ""), hashlib.sha256(data).hexdigest(), b"".join(xxhash.xxh3_128_digest(c, seed) for c in chunks(data))

    return per_row(docs, lambda: make, "n_chars long, text_sha256 string, recipe binary")


def clashes(docs: DataFrame, seed: int) -> int:
    """Identifiers that stand for more than one chunk."""
    distinct = chunk_table(docs, seed).groupBy("id", "chunk").agg(F.lit(1).alias("one"))
    return distinct.groupBy("id").agg(F.count("one").alias("n")).filter("n > 1").count()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs, with the group it belongs to and whether it stays."""
    docs = id_and_text(docs, id_col, text_col)
    seed = 0
    while clashes(docs, seed):
        seed += 1
    rows = cut(recipe_table(docs, seed), "recipes")
    order = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id"))
    groups = cut(rows.groupBy("recipe").agg(F.min(order).alias("best"), F.count("*").alias("group_size")), "groups")
    groups = groups.select("recipe", "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.col1")).alias("_most"))
    out = join_hot(rows, groups, "recipe", "group_size")
    best = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("_most"))
    # rows that repeat text and doc_id of the row that stays: number them; all other rows are numbered freely
    one = Window.partitionBy("doc_id", "text_sha256", "_best", "_any").orderBy("n_chars")
    out = out.withColumn("_best", best).withColumn("_any", F.when(best, F.lit(0)).otherwise(F.xxhash64("doc_id", "text_sha256", "n_chars") % 1024))
    out = out.withColumn("kept", F.col("_best") & (F.row_number().over(one) == 1))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY t) AS group_size,
         first_value(doc_id) OVER (PARTITION BY t ORDER BY n_chars DESC, doc_id) AS keep_id
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""

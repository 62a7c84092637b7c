"""Line deduplication with two Bloom filters.

Every line's key is hashed. One filter holds hashes seen once, the other those
seen twice or more: each map task fills a pair of its own, kept as sorted bit
positions, and pairs are merged by segment of the filter (a bit that two tasks
have in their first filter goes to the second). Keys that the second filter
denies are unique; only the rest, suspected repeats, are shuffled, counted and
confirmed by the key itself. Of the texts, only those of documents that lose
lines are moved to the list of these; a third filter tells them apart.

The filters grow with the input up to a limit, so what is broadcast is
bounded; on inputs that fill them more lines are suspected and more texts
moved, and the result is the same.

Defined results: a null or empty text is one empty line. A document is a
doc_id with a text: rows that repeat both are one document and lose the same
lines; texts that share a doc_id are documents of their own, and of one id for
"the largest doc_id holding it", so that all of them keep the line. A null
doc_id is the smallest. A table without rows gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossarium.llm.common import WS, cut, id_and_text, join_hot, per_row, slices, uncut, with_key
from glossarium.llm.two_bloom import fitting, meet, repeated


@dataclass(frozen=True)
class LineRule:
    least_chars: int = 20
    least_docs: int = 3
    #: Most positions of each filter, a power of two; 2 ** 27 positions are 16 MB.
    bits: int = 1 << 27
    #: Most positions of the filter of documents that lose lines.
    doc_bits: int = 1 << 26


def line_key(line: str) -> str:
    """White space stripped at both ends, A-Z lower-cased."""
    return line.strip(WS).encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def keys_of(text: str | None, least: int) -> set[str]:
    """The distinct keys of a text that are long enough."""
    return {line_key(x) for x in set((text or "").split("\n")) if len(x) >= least and len(x.strip(WS)) >= least}


def hashes_of(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k.encode("utf-8", "surrogatepass")) for k in keys), np.uint64)


def dropped_keys(docs: DataFrame, rule: LineRule) -> DataFrame:
    """(doc_id, th, key, keys) of each document (doc_id, th, key, text) that loses lines."""
    least = rule.least_chars
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    twice = repeated(docs.select("text"), lambda pdf: hashes_of(k for t in pdf["text"] for k in keys_of(t, least)), fitting(size // max(least, 1), rule.bits))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                own, out = [], []
                for k, text in enumerate(part.column("text").to_pylist()):
                    lines = list(keys_of(text, least))
                    if lines:
                        known = [x for x, h in zip(lines, twice.has(hashes_of(lines))) if h]
                        out += known
                        own += [k] * len(known)
                at = pa.array(own, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("th").take(at), pa.array(out, pa.string())], names=["doc_id", "th", "line"])

    seen = docs.select("doc_id", "th", "text").mapInArrow(suspects, "doc_id long, th binary, line string")
    seen = cut(seen.withColumn("kid", F.sha2("line", 256)), "suspects")
    twice.destroy()
    # a line's rows are one per doc_id, but for repeated rows and ids: those count once
    again = docs.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0
    each = seen.select("kid", "line", "doc_id").distinct() if again else seen
    counted = each.groupBy("line").agg(F.count("*").alias("docs"), F.max(F.coalesce("doc_id", F.lit(-(2**63)))).alias("last"))
    counted = cut(counted.filter(F.col("docs") >= rule.least_docs).select(F.sha2("line", 256).alias("kid"), "docs", "last"), "repeats")
    gone = join_hot(seen.select("kid", "doc_id", "th", "line"), counted, "kid", "docs")
    gone = gone.filter(F.coalesce("doc_id", F.lit(-(2**63))) < F.col("last"))
    out = gone.groupBy("doc_id", "th").agg(F.collect_set("line").alias("keys"))  # no more than a document's own lines
    out = cut(out.withColumn("key", F.xxhash64("doc_id", "th")), "gone")
    uncut(seen, counted)
    return out


def without_lines(text: str | None, keys) -> tuple[str, int, int]:
    """The text without the lines that have these keys; its number of lines before, and of those dropped."""
    lines = (text or "").split("\n")
    if not keys:
        return text or "", len(lines), 0
    gone = set(keys)
    kept = [x for x in lines if line_key(x) not in gone]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def line_dedup(docs: DataFrame, rule: LineRule = LineRule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: lines before, lines dropped, digest of what stays."""
    docs = with_key(id_and_text(docs, id_col, text_col))
    joined = meet(docs, dropped_keys(docs, rule), rule.doc_bits)

    def make(texts: list, keys: list) -> Iterator[tuple]:
        for text, gone in zip(texts, keys):
            kept, before, dropped = without_lines(text, gone)
            yield before, dropped, hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()

    return per_row(joined, lambda: make, "n_lines long, n_dropped long, kept_sha256 string", read=("text", "keys"))


def texts_without_lines(docs: DataFrame, rule: LineRule = LineRule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text of each row without the lines that go; a text that loses nothing stays as it is, null too."""
    names = [f"c{k}" for k in range(len(docs.columns))]  # further columns can't clash with those needed here
    plain = docs.toDF(*names)
    doc, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    rows = with_key(plain.select(*(c for c in names if c != text), F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text")))
    joined = meet(rows, dropped_keys(rows.select("doc_id", "th", "key", "text"), rule), rule.doc_bits)

    def make(texts: list, keys: list) -> Iterator[tuple]:
        for t, gone in zip(texts, keys):
            yield (without_lines(t, gone)[0] if gone else t,)

    made = per_row(joined, lambda: make, f"{text} string", keep=[c for c in names if c != text], read=("text", "keys"))
    return made.select(*names).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH l AS (
  SELECT d.doc_id, u.i, string_split(coalesce(d.text, ''), chr(10))[u.i] AS line
  FROM documents d, LATERAL (SELECT unnest(range(1, len(string_split(coalesce(d.text, ''), chr(10))) + 1)) AS i) u
), k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT k.doc_id, k.i, k.line, r.key IS NOT NULL AND k.doc_id < r.last AS gone FROM k LEFT JOIN r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

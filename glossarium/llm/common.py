"""Pieces that the operators of this subpackage share.

Every operator selects the columns it needs by name before it does anything
else, so further columns of a table, whatever they are called, never reach its
plans.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from glossarium.sources.shared import cut, drop_cuts, uncut

__all__ = ["cut", "drop_cuts", "uncut"]

#: ASCII white space, as the contracts of this subpackage mean it.
WS = "\x20\t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Python works on slices of about so many bytes of text, or one text that is longer.
SLICE_BYTES = 2 << 20

#: A key with more than 1 / HOT_SHARE of all rows is hot; there are fewer than HOT_SHARE such keys.
HOT_SHARE = 2000


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have about ``most`` bytes, so that a worker's memory doesn't grow with a batch."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // most
    begins = [0, *(np.nonzero(part[1:] != part[:-1])[0] + 1).tolist(), batch.num_rows]
    for a, b in zip(begins, begins[1:]):
        yield batch.slice(a, b - a)


def per_row(docs: DataFrame, task: Callable[[], Callable], added: str, keep: Sequence[str] = ("doc_id",), read: Sequence[str] = ("text",)) -> DataFrame:
    """One row for each row of docs: the columns ``keep`` as they are, and the columns ``added`` that Python makes.

    task() is called once per task and gives a function of lists, the values
    of the columns ``read`` (the first of them the text), that returns a tuple
    for each row. Kept columns never become Python values, so an id is what it
    was, null or not.
    """
    new = StructType.fromDDL(added)
    kept = [docs.schema[c] for c in keep]
    arrow = list(to_arrow_schema(new))
    names = [*keep, *(f.name for f in arrow)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = task()
        for batch in batches:
            for part in slices(batch, read[0]):
                made = list(zip(*make(*(part.column(c).to_pylist() for c in read))))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(v, f.type) for v, f in zip(made, arrow))], names=names)

    return docs.select(*dict.fromkeys([*keep, *read])).mapInArrow(run, StructType([*kept, *new.fields]))


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def with_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with ``th``, 128 bits of the text's SHA-256 (null as empty), and ``key``, a 64-bit hash of id and text.

    Id and th together name a row, or rows that repeat both; key spreads rows,
    those of one id or without any too.
    """
    th = F.unhex(F.substring(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"), 256), 1, 32))
    return docs.withColumn("th", th).withColumn("key", F.xxhash64(F.col(f"`{id_col}`"), "th"))


def id_remainder(doc_id: Column, mod: int = 5) -> Column:
    """crc32 of the id written as text, modulo mod; 0 marks the held-out rows."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def join_hot(big: DataFrame, small: DataFrame, key: str, rows: str, how: str = "inner", share: int = HOT_SHARE) -> DataFrame:
    """Join big to small, which has one row for each key and in column ``rows`` how many rows of big have that key.

    Keys with more than 1 / share of all those rows are joined by broadcast
    (there are fewer than ``share`` of them, by arithmetic); they never enter
    the shuffle, which so has no hot partition. Both inputs should be cheap to
    read twice. ``how`` is inner or left; null keys match nothing.
    """
    total = small.agg(F.sum(rows).alias("n")).first()["n"] or 0
    small = small.withColumn("_hot", F.lit(True))
    most = max(1000, total // share)
    hot = F.broadcast(small.filter(F.col(rows) > most))
    cold = small.filter(F.col(rows) <= most)
    out = big.join(hot, key, "inner")
    rest = big.join(hot.select(key), key, "left_anti")
    return out.unionByName(rest.join(cold, key, how)).drop("_hot")

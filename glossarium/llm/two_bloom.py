"""A pair of Bloom filters over a whole table: hashes seen once, and seen twice or more.

Each map task keeps its pair as sorted bit positions; pairs are merged by
segment of the filter, where a position that two tasks have in their first
filter goes to the second. A hash has two positions. Filters grow with the
input up to a limit, so what is broadcast is bounded: on inputs that fill them
more hashes are suspected of being repeats, never fewer.

Where most hashes of a very large table occur once, these would fill the pair.
``repeated_alone`` leaves them out: each map task sends its different hashes on
as 32-bit numbers by their leading bits, those with the same leading bits meet
in one task, and only hashes that are there twice go into one plain filter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions of a segment; each is merged by itself.
SEGMENT = 1 << 22
#: A segment's pairs from so many tasks are merged first, and then what comes of that.
FAN_IN = 1000
#: A map task sends its positions on after so many of them.
FLUSH = 1 << 20
#: Rows are turned into Python values about so many bytes at a time.
ROWS_BYTES = 2 << 20
#: Leading bits of a hash that repeated_alone looks at, and about how many hashes meet in one of its tasks.
CODE, MEET = 40, 1 << 21


def positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two positions for each 64-bit hash."""
    mixed = (hashes ^ (hashes >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (hashes & np.uint64(bits - 1)).astype(np.uint32), (mixed >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.uint32)


def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        step = max(1, batch.num_rows * ROWS_BYTES // max(batch.nbytes, 1))
        for a in range(0, batch.num_rows, step):
            yield batch.slice(a, step).to_pandas()


def twice_seen(rows: DataFrame, hashes: Callable[[pd.DataFrame], np.ndarray], bits: int, once: bool = False) -> bytes:
    """The second filter, bits / 8 bytes; or with ``once`` a plain filter of all hashes. hashes gives the 64-bit hashes of a batch of rows, repeats included."""
    span = min(bits, SEGMENT)
    segments = bits // span

    def packed(found: list[np.ndarray]) -> pa.RecordBatch:
        at, times = np.unique(np.concatenate(found), return_counts=True)
        ends = np.searchsorted(at, np.arange(1, segments + 1, dtype=np.int64) * span)
        begins = np.concatenate([[0], ends[:-1]])
        own, more = (at & np.uint32(span - 1)).astype("<u4"), times > 1 if not once else np.ones(len(at), bool)
        some = np.nonzero(ends > begins)[0]
        cells = [(own[a:b][~more[a:b]].tobytes(), own[a:b][more[a:b]].tobytes()) for a, b in zip(begins[some], ends[some])]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([x for x, _ in cells], pa.binary()), pa.array([x for _, x in cells], pa.binary())], names=["segment", "once", "twice"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for pdf in frames(batches):
            h = np.unique(hashes(pdf), return_counts=True) if not once else (np.unique(hashes(pdf)), None)
            for at in positions(h[0], bits):
                found += [at] if once else [at, at[h[1] > 1]]
            size = sum(map(len, found))
            if size > FLUSH:
                yield packed(found)
                found, size = [], 0
        if size:
            yield packed(found)

    def merge(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = np.zeros(span, bool), np.zeros(span, bool)
        for pdf in batches:
            for a, b in zip(pdf["once"], pdf["twice"]):
                a, b = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
                second[a[first[a]]] = True
                second[b] = True
                first[a] = True
                first[b] = True
        yield pd.DataFrame({"segment": [key[0]], "once": [np.packbits(first).tobytes()], "twice": [np.packbits(second).tobytes()]})

    def join(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = np.zeros(span // 8, np.uint8), np.zeros(span // 8, np.uint8)
        for pdf in batches:
            for a, b in zip(pdf["once"], pdf["twice"]):
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                second |= (a & first) | b
                first |= a
        yield pd.DataFrame({"segment": [key[0]], "twice": [second.tobytes()]})

    schema = "segment int, once binary, twice binary"
    parts = rows.mapInArrow(fill, schema).withColumn("part", F.floor(F.spark_partition_id() / FAN_IN))
    parts = parts.groupBy("segment", "part").applyInPandas(merge, schema).groupBy("segment").applyInPandas(join, "segment int, twice binary")
    out, size = bytearray(bits // 8), span // 8
    for row in parts.toLocalIterator():
        out[row["segment"] * size : (row["segment"] + 1) * size] = row["twice"]
    return bytes(out)


def has(filter_bytes: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes the filter knows."""
    out = np.ones(len(hashes), bool)
    for at in positions(hashes, bits):
        out &= (filter_bytes[at >> np.uint32(3)] >> (np.uint32(7) - (at & np.uint32(7))).astype(np.uint8) & 1).astype(bool)
    return out


def fitting(n: int, most: int) -> int:
    """Positions for n hashes: a power of two, ten a hash or more, and ``most`` at most."""
    return min(most, max(1 << 16, 1 << (10 * n).bit_length()))


@dataclass(frozen=True)
class Known:
    """A broadcast filter, bits / 8 bytes."""

    held: Broadcast
    bits: int
    #: Whether it was filled with shortened hashes.
    short: bool = False

    def has(self, hashes: np.ndarray) -> np.ndarray:
        return has(np.frombuffer(self.held.value, np.uint8), shortened(hashes) if self.short else hashes, self.bits)

    def maybe(self, key: Column) -> Column:
        """Whether a column of 64-bit keys may be in the filter; false only where it surely isn't. Python sees the key alone."""

        @F.pandas_udf("boolean")
        def known(keys: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for k in keys:
                yield pd.Series(self.has(k.to_numpy().view(np.uint64)))

        return known(key)

    def destroy(self) -> None:
        """Free it, once nothing that is still to run needs it."""
        self.held.destroy()


def repeated(rows: DataFrame, hashes: Callable[[pd.DataFrame], np.ndarray], bits: int) -> Known:
    """The filter of hashes that rows have twice."""
    return Known(rows.sparkSession.sparkContext.broadcast(twice_seen(rows, hashes, bits)), bits)


def spread(hashes: np.ndarray) -> np.ndarray:
    """The hashes with well mixed leading bits."""
    return (hashes ^ (hashes >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)


def shortened(hashes: np.ndarray) -> np.ndarray:
    """A hash of the leading bits of each."""
    return (spread(hashes) >> np.uint64(64 - CODE)) * np.uint64(0x9E3779B97F4A7C15)


def twice_there(rows: DataFrame, hashes: Callable[[pd.DataFrame], np.ndarray], n: int) -> DataFrame:
    """(codes), the leading bits of hashes that rows have twice or more, of about n, as cells of 64-bit numbers."""
    lead = max(CODE - 32, (n // MEET).bit_length())

    def packed(found: list[np.ndarray]) -> pa.RecordBatch:
        at, times = np.unique(np.concatenate(found), return_counts=True)
        some, begins = np.unique(at >> np.uint64(32), return_index=True)
        own, more = at.astype("<u4"), times > 1
        cells = [(own[a:b][~more[a:b]].tobytes(), own[a:b][more[a:b]].tobytes()) for a, b in zip(begins, [*begins[1:], len(at)])]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([x for x, _ in cells], pa.binary()), pa.array([x for _, x in cells], pa.binary())], names=["lead", "once", "twice"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for pdf in frames(batches):
            found.append(spread(hashes(pdf)) >> np.uint64(32 - lead))
            size += len(found[-1])
            if size > FLUSH:
                yield packed(found)
                found, size = [], 0
        if size:
            yield packed(found)

    def meet_again(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = [np.frombuffer(x, "<u4") for pdf in batches for c in ("once", "twice", "twice") for x in pdf[c]]
        own, times = np.unique(np.concatenate(cells), return_counts=True)
        again = ((np.uint64(key[0]) << np.uint64(32)) | own[times > 1]) >> np.uint64(32 + lead - CODE)
        yield pd.DataFrame({"codes": [again.astype("<u8").tobytes()]})

    return rows.mapInArrow(send, "lead int, once binary, twice binary").groupBy("lead").applyInPandas(meet_again, "codes binary")


def of_cells(pdf: pd.DataFrame) -> np.ndarray:
    """The shortened hashes of the cells of twice_there."""
    codes = np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(x, "<u8") for x in pdf["codes"])])
    return codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def repeated_alone(rows: DataFrame, hashes: Callable[[pd.DataFrame], np.ndarray], n: int, most: int) -> Known:
    """The filter of hashes that rows have twice, of about n; those that are there once don't fill it."""
    bits = fitting(n, most)
    return Known(rows.sparkSession.sparkContext.broadcast(twice_seen(twice_there(rows, hashes, n), of_cells, bits, once=True)), bits, short=True)


def of_column(column: str) -> Callable[[pd.DataFrame], np.ndarray]:
    return lambda pdf: pdf[column].to_numpy().view(np.uint64)


def key_filter(rows: DataFrame, column: str, most: int) -> Known:
    """The filter of a column of 64-bit keys; rows should be cheap to read twice."""
    bits = fitting(rows.count(), most)
    return Known(rows.sparkSession.sparkContext.broadcast(twice_seen(rows.select(column), of_column(column), bits, once=True)), bits)


def meet(rows: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """rows (with doc_id, th and key) left-joined to found (doc_id, th, key and further columns).

    Only rows whose key a filter of found's keys has are shuffled; the others
    surely have no match and pass as they are.
    """
    known = key_filter(found, "key", most)
    more = [f for f in found.schema if f.name not in ("doc_id", "th", "key")]
    other = found.select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th"), F.col("key").alias("_key"), *(f.name for f in more))
    same = (F.col("key") == F.col("_key")) & (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
    near = rows.filter(known.maybe(F.col("key"))).join(other, same, "left").drop("_doc", "_th", "_key")
    far = rows.filter(~known.maybe(F.col("key"))).select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in more))
    return near.unionByName(far)

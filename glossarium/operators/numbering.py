"""Positions in a sorted order, without one task that holds all rows.

Rows are dealt to partitions by ranges of their keys and sorted there; each
keeps its partition and its place in it. Counts by partition (and group) make
the offsets, and a row's position is its place plus its partition's offset.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from glossarium.sources.shared import cut

#: monotonically_increasing_id has the row's place in its partition in so many low bits.
_PLACE = (1 << 33) - 1


def _laid(df: DataFrame, keys: Sequence[Column], part: str, place: str) -> DataFrame:
    """df in order, as a table, with each row's partition and its place there."""
    laid = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return cut(laid.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))), "numbered")


def numbered(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), name: str = "n", total: str | None = None) -> DataFrame:
    """df with its rows' positions, from 0, in the order of ``order`` among rows with the same ``by`` (null is a value), and their number as ``total``.

    Ties get positions in some order, fixed once: the sorted rows are a table
    in the shared folder. A group, or one key, may hold any share of the rows;
    rows that tie in every column of ``order`` stay in one partition, so
    callers with many of these add a column that tells them apart. Names of
    other columns can't clash with the ones added here.
    """
    mark = uuid.uuid4().hex[:8]
    part, place, rows, before, first = (f"_{x}_{mark}" for x in ("part", "place", "rows", "before", "first"))
    keys = [*(F.col(f"`{c}`").asc_nulls_first() for c in by), *(F.col(f"`{c}`").asc() if isinstance(c, str) else c for c in order)]
    laid = _laid(df, keys, part, place)
    group = [F.col(f"`{c}`").alias(f"_g{k}_{mark}") for k, c in enumerate(by)]
    counted = laid.groupBy(*group, part).agg(F.count("*").alias(rows), F.min(place).alias(first))
    names = [f"_g{k}_{mark}" for k in range(len(by))]
    if by:
        # a group has a row for each partition that holds some of it
        w = Window.partitionBy(*names)
        whole = F.sum(rows).over(w)
        counted = counted.withColumn(before, F.coalesce(F.sum(rows).over(w.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", whole)
        counted = cut(counted, "offsets")
    else:
        # one row for each partition
        found, at = [], 0
        for r in sorted(counted.collect(), key=lambda r: r[part]):
            found.append((r[part], r[first], at))
            at += r[rows]
        counted = df.sparkSession.createDataFrame([(*f, at) for f in found], f"{part} int, {first} long, {before} long, _all long")
    offsets = counted.select(*names, F.col(part).alias(f"{part}_"), first, before, F.col("_all").alias(f"_all_{mark}"))
    same = F.col(part) == F.col(f"{part}_")
    for k, c in enumerate(by):
        same = same & laid[f"`{c}`"].eqNullSafe(offsets[names[k]])
    out = laid.join(offsets if by else F.broadcast(offsets), same)
    added = [(F.col(place) - F.col(first) + F.col(before)).alias(name)]
    if total:
        added.append(F.col(f"_all_{mark}").alias(total))
    return out.select(*(F.col(f"`{c}`") for c in df.columns), *added)


def carried(df: DataFrame, order: Sequence[str | Column], value: str, name: str) -> DataFrame:
    """df with ``name``: the last value that isn't null, at the row or before it in the order; null where there is none.

    Only the last value of each partition passes through the driver.
    """
    mark = uuid.uuid4().hex[:8]
    part, place, before = (f"_{x}_{mark}" for x in ("part", "place", "before"))
    laid = _laid(df, [F.col(f"`{c}`").asc() if isinstance(c, str) else c for c in order], part, place)
    ends = laid.filter(F.col(f"`{value}`").isNotNull()).groupBy(part).agg(F.max_by(F.col(f"`{value}`"), place).alias("end"))
    last = sorted(ends.collect(), key=lambda r: r[part])  # a row for each partition
    # a partition without a value gets that of the one before it too: ranges [from, to) of partitions with one value
    known = [r[part] for r in last]
    spans = [(a, b, r["end"]) for a, b, r in zip(known, [*known[1:], 1 << 30], last)]
    parts = [r[part] for r in laid.select(part).distinct().collect()]
    carry = [(p, end) for p in parts for a, b, end in spans if a < p <= b]
    kind = StructType([StructField(f"{part}_", IntegerType()), StructField(before, df.schema[value].dataType)])
    out = laid.join(F.broadcast(df.sparkSession.createDataFrame(carry, kind)), F.col(part) == F.col(f"{part}_"), "left")
    w = Window.partitionBy(part).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    found = F.coalesce(F.last(F.col(f"`{value}`"), ignorenulls=True).over(w), F.col(before))
    return out.select(*(F.col(f"`{c}`") for c in df.columns), found.alias(name))

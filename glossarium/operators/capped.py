"""The first rows of a term under caps that act on each other.

A reader in order keeps a row unless it repeats, its group is one too many,
its group is full, or the term is. A repeat is dropped whatever became of the
first, a group is admitted by its first row, and the last cap only ends a
term; so the rows kept are the term's first ones among the first of each of its
first groups. Each of these steps keeps a bounded number for a key, and is done
on shares of a key's rows before the shares meet: a hot term or group is never
in one task with more rows than the caps times the shares.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossarium.plans.registry import query
from glossarium.plans.tables import table

#: Groups of a term, rows of a group, rows of a term.
GROUPS, IN_GROUP, IN_TERM = 12, 6, 48
SHARES = 64


def first_of(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], most: int, shares: int = SHARES) -> DataFrame:
    """The first ``most`` rows of each key, found in shares of its rows first."""
    share = F.pmod(F.xxhash64(*rows.columns), F.lit(shares))
    n = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    some = rows.withColumn("_share", share).withColumn("_n", n(*by, "_share")).filter(F.col("_n") <= most)
    return some.withColumn("_n", n(*by)).filter(F.col("_n") <= most).drop("_n", "_share")


def capped(rows: DataFrame, groups: int = GROUPS, in_group: int = IN_GROUP, in_term: int = IN_TERM) -> DataFrame:
    """(term, grp, item, ord) that a reader of rows (term, grp, item, ord) keeps, with its place ``n`` in the term from 0; null is a value in every column but ord, and rows that tie in ord are read by group and item."""
    once = rows.groupBy("term", "grp", "item").agg(F.min("ord").alias("ord"))  # combined before the shuffle
    first = once.groupBy("term", "grp").agg(F.min("ord").alias("first"))
    admitted = first_of(first, ["term"], ["first", "grp"], groups).withColumnsRenamed({"term": "t", "grp": "g"})
    kept = first_of(once, ["term", "grp"], ["ord", "item"], in_group)
    kept = kept.join(admitted, F.col("term").eqNullSafe(F.col("t")) & F.col("grp").eqNullSafe(F.col("g")), "left_semi")
    n = F.row_number().over(Window.partitionBy("term").orderBy("ord", "grp", "item"))  # groups * in_group rows of a term at most
    return kept.withColumn("n", n - 1).filter(F.col("n") < in_term)


@query(
    "ag15_interacting_caps",
    """WITH r AS (SELECT l_suppkey % 7 AS term, l_shipdate AS d, l_quantity AS grp, l_partkey % 10 AS item, l_orderkey * 10 + l_linenumber AS ord FROM lineitem),
o AS (SELECT term, grp, item, min(ord) AS ord FROM r GROUP BY ALL),
g AS (SELECT *, min(ord) OVER (PARTITION BY term, grp) AS first, row_number() OVER (PARTITION BY term, grp ORDER BY ord, item) AS k FROM o),
a AS (SELECT *, dense_rank() OVER (PARTITION BY term ORDER BY first, grp) AS place FROM g)
SELECT term, grp, item, ord, n FROM (SELECT term, grp, item, ord, CAST(row_number() OVER (PARTITION BY term ORDER BY ord, grp, item) - 1 AS INT) AS n FROM a WHERE place <= 12 AND k <= 6) WHERE n < 48""",
)
def interacting_caps(spark, d):
    """Seven hot terms over all line items."""
    l = table(spark, d, "lineitem")  # noqa: E741
    return capped(l.select((F.col("l_suppkey") % 7).alias("term"), F.col("l_quantity").alias("grp"), (F.col("l_partkey") % 10).alias("item"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord")))

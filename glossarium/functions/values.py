"""Dates, numbers, JSON, arrays and hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from glossarium.plans.registry import query
from glossarium.plans.tables import table


@query("fn01_epoch_days", "SELECT o_orderkey, datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders")
def epoch_days(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.unix_date(F.to_date("o_orderdate")).cast("long").alias("days"))


@query("fn02_day_number", "SELECT event_id, greatest(0, datediff('day', DATE '2024-01-10', CAST(ts AS DATE))) AS n FROM events")
def day_number(spark, d):
    return table(spark, d, "events").select("event_id", F.greatest(F.lit(0), F.datediff(F.to_date("ts"), F.lit("2024-01-10"))).cast("long").alias("n"))


@query("fn03_day_key", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def day_key(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))


def splitmix64(x: np.ndarray) -> np.ndarray:
    """One step of the public splitmix64 generator, on unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        z = x + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def day_pick(day: Column, n: Column) -> Column:
    """The day's place in a list of n, by splitmix64. Spark has no unsigned arithmetic, so this is an Arrow function."""

    @F.pandas_udf("long")
    def pick(day: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series((splitmix64(day.to_numpy().astype(np.uint64)) % n.to_numpy().astype(np.uint64)).astype(np.int64))

    return pick(day, n)


_M = "18446744073709551616::UHUGEINT"


def mix_sql(rows: str, keep: str, out: str) -> str:
    """splitmix64 of the column day in DuckDB, as 128-bit arithmetic modulo 2 ** 64."""
    a = f"SELECT *, ((day::UHUGEINT + 11400714819323198485::UHUGEINT) % {_M})::UBIGINT AS z FROM {rows}"
    b = f"SELECT * EXCLUDE z, ((xor(z, z >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % {_M})::UBIGINT AS z FROM ({a})"
    c = f"SELECT * EXCLUDE z, ((xor(z, z >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % {_M})::UBIGINT AS z FROM ({b})"
    return f"SELECT {keep}, CAST(xor(z, z >> 31) % {out} AS BIGINT) AS pick FROM ({c})"


@query("srt16_day_pick", mix_sql("(SELECT o_orderkey AS day FROM orders)", "day", "97"))
def day_pick_query(spark, d):
    """A day's place in a cycle of 97, for the keys of orders as days."""
    days = table(spark, d, "orders").select(F.col("o_orderkey").alias("day"))
    return days.select("day", day_pick(F.col("day"), F.lit(97)).alias("pick"))


@query("fn05_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def sha256(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("fn06_rounded_mean", "SELECT p_type, round(avg(p_retailprice), 3) AS mean FROM part GROUP BY p_type")
def rounded_mean(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(F.round(F.avg("p_retailprice"), 3).alias("mean"))


@query("fn07_clamp", "SELECT p_partkey, least(greatest(p_size, 10), 30) AS size FROM part")
def clamp(spark, d):
    return table(spark, d, "part").select("p_partkey", F.least(F.greatest("p_size", F.lit(10)), F.lit(30)).alias("size"))


@query("fn08_json_field", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("fn10_array_ops", "SELECT item_id, array_to_string(list_sort(list_distinct(string_split(text, ' ')))[1:3], ' ') AS few, list_contains(string_split(text, ' '), 'the') AS has_the FROM benchmark")
def array_ops(spark, d):
    w = F.split("text", " ")
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.slice(F.sort_array(F.array_distinct(w)), 1, 3), " ").alias("few"), F.array_contains(w, "the").alias("has_the"))


@query("fn12_coalesce_case", "SELECT c_custkey, coalesce(CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN 'rich' END, c_mktsegment) AS tag FROM customer")
def coalesce_case(spark, d):
    b = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", F.coalesce(F.when(b < 0, "debt").when(b > 5000, "rich"), "c_mktsegment").alias("tag"))


@query("fn15_storage", "SELECT s_suppkey, round((abs(s_acctbal) * 2 - 100) * 1.1, 2) AS need FROM supplier")
def storage(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.round((F.abs("s_acctbal") * 2 - 100) * F.lit(1.1), 2).alias("need"))


@query("utl22_values_join", "WITH k(w, c) AS (VALUES ('ECONOMY', 1), ('PROMO', 2)) SELECT p.p_partkey, k.c FROM part p JOIN k ON k.w = p.p_type WHERE p.p_partkey % 7 = 3")
def values_join(spark, d):
    k = F.broadcast(spark.createDataFrame([("ECONOMY", 1), ("PROMO", 2)], "p_type string, c int"))  # two literal rows
    return table(spark, d, "part").filter("p_partkey % 7 = 3").join(k, "p_type").select("p_partkey", "c")

"""What a build writes: derived tables, digests, counts, manifests, and a commit by rename."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossarium.plans.registry import query
from glossarium.plans.tables import ENTRIES, FORMS, TERMS, entries, forms, gloss_terms, table

W = f"WITH {ENTRIES}"


def fan_out(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables that one table of entries makes."""
    return {"entries": entries(spark, sf_dir), "forms": forms(spark, sf_dir), "gloss_terms": gloss_terms(spark, sf_dir)}


def digest(df: DataFrame) -> DataFrame:
    """One row: how many rows, and a sum over rows that doesn't depend on their order."""
    cells = F.concat_ws("|", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("~")) for c in sorted(df.columns)))
    return df.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.md5(cells.cast("binary")), 1, 8), 16, 10).cast("long")).alias("digest"))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def commit(df: DataFrame, path: str, at_least: int = 0) -> int:
    """Write df beside path, check its rows, then put it in the place of what is there; the old table stays if the check fails.

    The old table is moved away first and deleted last, so that one of the two
    is always whole on the disk. Returns the number of rows.
    """
    spark = df.sparkSession
    fresh, old = f"{path}.new", f"{path}.old"
    fs, target, to = _fs(spark, path)
    if not fs.exists(target) and fs.exists(to(old)):  # an earlier commit stopped between its two renames
        fs.rename(to(old), target)
    df.write.mode("overwrite").parquet(fresh)
    n = spark.read.parquet(fresh).count()
    if n < at_least:
        fs.delete(to(fresh), True)
        raise ValueError(f"{path}: {n} rows, {at_least} wanted")
    fs.delete(to(old), True)
    if fs.exists(target) and not fs.rename(target, to(old)):
        raise OSError(f"can't move {path} away")
    if not fs.rename(to(fresh), target):
        raise OSError(f"can't put {fresh} in place")
    fs.delete(to(old), True)
    return n


def manifest(tables: dict[str, DataFrame]) -> str:
    """Rows and digest of each table, as JSON with sorted keys."""
    return json.dumps({name: digest(df).first().asDict() for name, df in tables.items()}, sort_keys=True)


def merge_by_key(old: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Old rows without those whose key is fresh, and the fresh ones; null keys of both stay."""
    return old.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


@query("snk01_fan_out", f"{W}, {FORMS}, {TERMS} SELECT 'entries' AS name, count(*) AS n FROM entries UNION ALL SELECT 'forms', count(*) FROM forms UNION ALL SELECT 'gloss_terms', count(*) FROM gloss_terms")
def fan_out_query(spark, d):
    counts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in fan_out(spark, d).items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("snk04_digest", f"{W} SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', coalesce(headword, '~'), coalesce(CAST(id AS VARCHAR), '~'))), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM entries")
def digest_query(spark, d):
    return digest(entries(spark, d).select("headword", "id"))


@query("snk07_merge_by_key", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier) UNION ALL SELECT s_nationkey, min(s_name) FROM supplier GROUP BY s_nationkey")
def merge_query(spark, d):
    fresh = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_name").alias("n_name"))
    return merge_by_key(table(spark, d, "nation").select("n_nationkey", "n_name"), fresh, "n_nationkey")


@query("src05_regroup", "SELECT l_orderkey, string_agg(l_partkey || ':' || l_linenumber, ',' ORDER BY l_linenumber, l_partkey) AS senses FROM lineitem GROUP BY l_orderkey")
def regroup(spark, d):
    """Items that hold one sense each, put together in the order of their numbers."""
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(parts.alias("a"))
    return rows.select("l_orderkey", F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["l_partkey"], x["l_linenumber"])), ",").alias("senses"))


@query("src08_prefilter", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE contains(props, '\"k\"')")
def prefilter(spark, d):
    """Lines are parsed only if they hold the bytes looked for."""
    return table(spark, d, "events").filter(F.col("props").contains('"k"')).select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("src28_line_dedupe", "WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) SELECT line, count(*) AS n FROM (SELECT DISTINCT line FROM l WHERE length(line) >= 12 UNION ALL SELECT line FROM l WHERE length(line) < 12) GROUP BY line")
def line_dedupe(spark, d):
    """Lines of twelve characters or more once, shorter ones as often as they stand."""
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("line").agg(F.count("*").alias("n")).select("line", F.when(F.length("line") >= 12, F.lit(1)).otherwise(F.col("n")).cast("long").alias("n"))

"""The dictionary model on top of the driver's tables: entries, forms, gloss terms, curriculum, sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hw_norm(c: Column) -> Column:
    """Lower case without the separators that lookups ignore."""
    return F.translate(F.lower(c), " -^", "")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as dictionary entries: one row per entry, with pack, source, kind, level, rank and gloss."""
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "word").when(F.col("p_size") % 3 == 1, "phrase").otherwise("idiom")
    level = F.when(F.col("p_size") % 7 == 0, F.lit(None)).otherwise(F.col("p_partkey") % 6 + 1)
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_type").alias("pack"),
        F.col("p_brand").alias("source"),
        F.col("p_name").alias("headword"),
        hw_norm(F.col("p_name")).alias("hw_norm"),
        kind.alias("kind"),
        level.cast("int").alias("level"),
        F.round(F.col("p_retailprice") * 100).cast("long").alias("rank"),
        F.concat("p_name", F.lit("; to "), F.lower("p_type"), F.lit(", "), F.lower("p_brand")).alias("gloss"),
    )


#: The same for DuckDB.
ENTRIES = """entries AS (SELECT p_partkey AS id, p_type AS pack, p_brand AS source, p_name AS headword,
  translate(lower(p_name), ' -^', '') AS hw_norm,
  CASE p_size % 3 WHEN 0 THEN 'word' WHEN 1 THEN 'phrase' ELSE 'idiom' END AS kind,
  CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_partkey % 6 + 1 AS INT) END AS level,
  CAST(round(p_retailprice * 100) AS BIGINT) AS rank,
  p_name || '; to ' || lower(p_type) || ', ' || lower(p_brand) AS gloss FROM part)"""


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(form, entry_id): the words of a headword, once each."""
    return entries(spark, sf_dir).select(F.explode(F.array_distinct(F.split("headword", " "))).alias("form"), F.col("id").alias("entry_id"))


FORMS = "forms AS (SELECT DISTINCT unnest(string_split(headword, ' ')) AS form, id AS entry_id FROM entries)"


def gloss_items(gloss: Column) -> Column:
    """Items of a gloss: split on ; and , then trimmed, lower-cased, without a leading "to "."""
    return F.transform(F.split(gloss, "[;,]"), lambda x: F.regexp_replace(F.trim(F.lower(x)), "^to ", ""))


def quality(source: Column) -> Column:
    return F.when(source == "Brand#1", 0).when(source == "Brand#2", 1).otherwise(2)


def gloss_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, tier, score, entry_id, pack): tier 0 is the first non-empty item; items over 40 characters are left out; the least score of a term and entry stays."""
    e = entries(spark, sf_dir).select("id", "pack", "rank", "source", F.filter(gloss_items(F.col("gloss")), lambda x: x != "").alias("items"))
    t = e.select("id", "pack", "rank", "source", F.posexplode("items").alias("n", "term")).filter(F.length("term") <= 40)
    tier = F.when(F.col("n") == 0, 0).otherwise(1)
    score = (tier + quality(F.col("source"))).cast("long") * 10_000_000 + F.least("rank", F.lit(9_999_999))
    t = t.select("term", tier.alias("tier"), score.alias("score"), F.col("id").alias("entry_id"), "pack")
    return t.groupBy("term", "entry_id", "pack").agg(F.min("score").alias("score"), F.min("tier").alias("tier"))


TERMS = """items AS (SELECT id, pack, rank, source, i.n, i.x AS term FROM entries,
  LATERAL (SELECT row_number() OVER (ORDER BY k) - 1 AS n, x FROM (
    SELECT k, regexp_replace(trim(lower(regexp_split_to_array(gloss, '[;,]')[k])), '^to ', '') AS x
    FROM (SELECT unnest(range(1, len(regexp_split_to_array(gloss, '[;,]')) + 1)) AS k)) WHERE x != '') i),
gloss_terms AS (SELECT term, id AS entry_id, pack,
  min((CASE WHEN n = 0 THEN 0 ELSE 1 END + CASE source WHEN 'Brand#1' THEN 0 WHEN 'Brand#2' THEN 1 ELSE 2 END) * 10000000 + least(rank, 9999999)) AS score,
  min(CASE WHEN n = 0 THEN 0 ELSE 1 END) AS tier FROM items WHERE length(term) <= 40 GROUP BY term, id, pack)"""

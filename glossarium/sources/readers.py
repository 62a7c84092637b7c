"""Readers of raw dictionary formats. Each takes a path that Spark can read and gives a table with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def cedict(lines: DataFrame) -> DataFrame:
    """``Trad Simp [pinyin] /g/g/`` lines (column value); comments and lines of another shape are left out."""
    shape = r"^(\S+) (\S+) \[([^\]]*)\] /(.*)/\s*$"
    part = lambda k: F.regexp_extract("value", shape, k)
    rows = lines.filter(~F.col("value").startswith("#") & F.col("value").rlike(shape))
    return rows.select(part(1).alias("traditional"), part(2).alias("simplified"), part(3).alias("pinyin"), F.split(part(4), "/").alias("glosses"))


def kengdic(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated rows with a header and no quoting."""
    schema = "id string, surface string, hanja string, gloss string, level string, created string, source string"
    return spark.read.schema(schema).csv(path, sep="\t", header=True, quote="", mode="PERMISSIVE")


def jsonl(spark: SparkSession, path: str, schema: str, lang_code: str | None = None) -> DataFrame:
    """JSON Lines with a declared schema; malformed lines are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").json(path, mode="PERMISSIVE").filter("_corrupt_record IS NULL").drop("_corrupt_record")
    return rows.filter(F.col("lang_code") == lang_code) if lang_code else rows


def tatoeba(sentences: DataFrame, links: DataFrame, others: DataFrame) -> DataFrame:
    """Sentences (id, text) with the translation that the lowest id links to, once per text."""
    hits = links.join(others.select(F.col("id").alias("other"), F.col("text").alias("en")), "other").groupBy("id").agg(F.min_by("en", "other").alias("en"))
    rows = sentences.join(hits, "id", "left")
    return rows.groupBy(F.col("text").alias("ko")).agg(F.min_by("en", F.struct(F.col("en").isNull(), "id")).alias("en"))


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """One row per element, with a declared schema."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)

"""Filters, predicates, and point and range lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glossarium.plans.registry import query
from glossarium.plans.tables import ENTRIES, FORMS, entries, forms, table

W = f"WITH {ENTRIES}"


def per_pack(rows, k: int, *order):
    """The first k rows of each pack."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("pack").orderBy(*order))).filter(F.col("_n") <= k).drop("_n")


@query("flt01_equality", f"{W} SELECT id, pack, hw_norm, rank FROM (SELECT *, row_number() OVER (PARTITION BY pack ORDER BY rank, id) AS n FROM entries WHERE hw_norm = 'coldwidget') WHERE n <= 50")
def equality(spark, d):
    return per_pack(entries(spark, d).filter(F.col("hw_norm") == "coldwidget"), 50, "rank", "id").select("id", "pack", "hw_norm", "rank")


@query("flt02_prefix", f"{W} SELECT id, hw_norm FROM entries WHERE starts_with(hw_norm, 'cold')")
def prefix(spark, d):
    return entries(spark, d).filter(F.col("hw_norm").startswith("cold")).select("id", "hw_norm")


@query("flt03_strict_extension", f"{W} SELECT id, hw_norm FROM entries WHERE starts_with(hw_norm, 'cold') AND hw_norm != 'coldwidget'")
def strict_extension(spark, d):
    return entries(spark, d).filter(F.col("hw_norm").startswith("cold") & (F.col("hw_norm") != "coldwidget")).select("id", "hw_norm")


KEYS = ["widget", "gadget", "gear", "bolt", "absent"]


@query("flt04_batched_keys", f"{W}, {FORMS} SELECT f.form AS matched, e.id, e.rank FROM forms f JOIN entries e ON e.id = f.entry_id WHERE f.form IN ('widget', 'gadget', 'gear', 'bolt', 'absent')")
def batched_keys(spark, d):
    keys = F.broadcast(spark.createDataFrame([(k,) for k in KEYS], "form string"))  # the keys of one call
    return forms(spark, d).join(keys, "form").join(entries(spark, d), F.col("entry_id") == F.col("id")).select(F.col("form").alias("matched"), "id", "rank")


@query("flt05_like_escape", "SELECT doc_id FROM documents WHERE text ILIKE '%50\\%%' ESCAPE '\\' OR text ILIKE '%THE a%'")
def like_escape(spark, d):
    low = F.lower("text")
    return table(spark, d, "documents").filter(F.contains(low, F.lit("50%")) | F.contains(low, F.lit("the a"))).select("doc_id")


@query("flt06_instr", "SELECT p_partkey, instr(p_name, 'dg') AS pos FROM part WHERE instr(p_name, 'dg') > 0")
def instr(spark, d):
    return table(spark, d, "part").filter(F.instr("p_name", "dg") > 0).select("p_partkey", F.instr("p_name", "dg").cast("long").alias("pos"))


@query("flt07_not_like", "SELECT p_partkey FROM part WHERE p_name NOT LIKE '%widget%'")
def not_like(spark, d):
    return table(spark, d, "part").filter(~F.col("p_name").contains("widget")).select("p_partkey")


@query("flt08_not_blank", "SELECT doc_id FROM documents WHERE lang IS NOT NULL AND trim(lang) != '' AND text IS NOT NULL")
def not_blank(spark, d):
    return table(spark, d, "documents").filter(F.col("lang").isNotNull() & (F.trim("lang") != "") & F.col("text").isNotNull()).select("doc_id")


@query("flt09_subtree", "SELECT o_orderkey FROM orders WHERE starts_with(o_orderpriority, '1-') OR o_orderpriority = '1'")
def subtree(spark, d):
    return table(spark, d, "orders").filter(F.col("o_orderpriority").startswith("1-") | (F.col("o_orderpriority") == "1")).select("o_orderkey")


@query("flt10_next_prefix", f"{W} SELECT id FROM entries WHERE hw_norm >= 'col' AND hw_norm < 'com'")
def next_prefix(spark, d):
    return entries(spark, d).filter(F.col("hw_norm").startswith("col")).select("id")


@query("flt12_attested_semi", f"{W}, {FORMS} SELECT e.id FROM entries e WHERE EXISTS (SELECT 1 FROM forms f JOIN (SELECT DISTINCT lower(p_type) AS t FROM part UNION SELECT 'widget') c ON f.form = c.t WHERE f.entry_id = e.id)")
def attested_semi(spark, d):
    canon = table(spark, d, "part").select(F.lower("p_type").alias("form")).unionByName(spark.createDataFrame([("widget",)], "form string")).distinct()
    hit = forms(spark, d).join(canon, "form", "left_semi").select(F.col("entry_id").alias("id"))
    return entries(spark, d).join(hit, "id", "left_semi").select("id")


@query("flt14_is_sentence", "SELECT item_id FROM benchmark WHERE NOT contains(text, chr(10)) AND len(string_split(trim(text), ' ')) >= 2")
def is_sentence(spark, d):
    return table(spark, d, "benchmark").filter(~F.contains("text", F.lit("\n")) & (F.size(F.split(F.trim("text"), " ")) >= 2)).select("item_id")


@query("flt18_forall", "SELECT o_orderkey FROM (SELECT l_orderkey AS o_orderkey, list(l_returnflag) AS f FROM lineitem GROUP BY l_orderkey) WHERE len(f) > 0 AND len(list_filter(f, lambda x: x = 'N')) = len(f)")
def forall(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.every(F.col("l_returnflag") == "N").alias("all_n"))
    return g.filter("all_n").select("o_orderkey")


@query("flt20_review_gate", "SELECT d.doc_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1 AND l.toxic = 0")
def review_gate(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").filter("quality = 1 AND toxic = 0"), "doc_id").select("doc_id")

"""Joins and record linkage. Equi-joins are left to the optimizer, which broadcasts a side only below its size threshold."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glossarium.plans.registry import query
from glossarium.plans.tables import ENTRIES, FORMS, entries, forms, table

W = f"WITH {ENTRIES}, {FORMS}"


@query("jn01_forms_inner", f"{W} SELECT e.id, e.headword, e.rank FROM forms f JOIN entries e ON e.id = f.entry_id WHERE f.form = 'widget'")
def forms_inner(spark, d):
    return forms(spark, d).filter("form = 'widget'").join(entries(spark, d), F.col("entry_id") == F.col("id")).select("id", "headword", "rank")


@query("jn06_left_coalesce", "SELECT l.l_orderkey, l.l_linenumber, coalesce(o.o_custkey, l.l_suppkey) AS key, c.c_name FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'F' LEFT JOIN customer c ON c.c_custkey = coalesce(o.o_custkey, l.l_suppkey)")
def left_coalesce(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    x = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").withColumn("key", F.coalesce("o_custkey", "l_suppkey"))
    return x.join(table(spark, d, "customer"), F.col("c_custkey") == F.col("key"), "left").select("l_orderkey", "l_linenumber", "key", "c_name")


@query("jn07_compound_on", "SELECT o.o_orderkey, c.c_name FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey AND o.o_orderpriority = '1-URGENT'")
def compound_on(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, (c.c_custkey == o.o_custkey) & (o.o_orderpriority == "1-URGENT"), "left").select("o_orderkey", "c_name")


@query("jn08_late_lookup", f"{W} SELECT e.id, coalesce(a.m, b.m) AS target FROM entries e LEFT JOIN (SELECT hw_norm, pack, min(id) AS m FROM entries WHERE source = 'Brand#1' GROUP BY ALL) a ON a.hw_norm = e.hw_norm AND a.pack = e.pack LEFT JOIN (SELECT hw_norm, min(id) AS m FROM entries GROUP BY ALL) b ON b.hw_norm = e.hw_norm")
def late_lookup(spark, d):
    e = entries(spark, d)
    a = e.filter("source = 'Brand#1'").groupBy("hw_norm", "pack").agg(F.min("id").alias("ma"))
    b = e.groupBy("hw_norm").agg(F.min("id").alias("mb"))
    return e.join(a, ["hw_norm", "pack"], "left").join(b, "hw_norm", "left").select("id", F.coalesce("ma", "mb").alias("target"))


@query("jn09_has_lesson_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def has_lesson(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").filter("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("jn10_semi_in", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.05)")
def semi_in(spark, d):
    return table(spark, d, "part").join(table(spark, d, "lineitem").filter("l_discount > 0.05"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query("jn11_duplicate_forms", "SELECT DISTINCT lower(p_name) AS form, p_size AS entry_id FROM part")
def duplicate_forms(spark, d):
    return table(spark, d, "part").select(F.lower("p_name").alias("form"), F.col("p_size").alias("entry_id")).dropDuplicates(["form", "entry_id"])


@query("jn12_unnest_words", "SELECT item_id, unnest(string_split(s, ' ')) AS word FROM (SELECT item_id, unnest(string_split(text, '. ')) AS s FROM benchmark)")
def unnest_words(spark, d):
    s = table(spark, d, "benchmark").select("item_id", F.explode(F.split("text", "\\. ")).alias("s"))
    return s.select("item_id", F.explode(F.split("s", " ")).alias("word"))


@query("jn13_correlated_min", "SELECT c_custkey, (SELECT min(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS first_order, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS top_order FROM customer")
def correlated_min(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order"), F.min_by("o_orderkey", F.struct(-F.col("o_totalprice"), "o_orderkey")).alias("top_order"))
    return table(spark, d, "customer").join(g, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "first_order", "top_order")


@query("jn14_anti_other_source", f"{W} SELECT id FROM entries WHERE source = 'Brand#3' AND hw_norm NOT IN (SELECT hw_norm FROM entries WHERE source IN ('Brand#1', 'Brand#2'))")
def anti_other_source(spark, d):
    e = entries(spark, d)
    return e.filter("source = 'Brand#3'").join(e.filter("source IN ('Brand#1', 'Brand#2')").select("hw_norm"), "hw_norm", "left_anti").select("id")


@query("jn15_anti_two_keys", f"{W} SELECT id FROM entries e WHERE source = 'Brand#4' AND NOT EXISTS (SELECT 1 FROM entries x WHERE x.source = 'Brand#5' AND x.hw_norm = e.hw_norm AND x.kind = e.kind)")
def anti_two_keys(spark, d):
    e = entries(spark, d)
    return e.filter("source = 'Brand#4'").join(e.filter("source = 'Brand#5'").select("hw_norm", "kind"), ["hw_norm", "kind"], "left_anti").select("id")


@query("jn16_equi_or_theta", f"{W} SELECT a.id AS pointer, b.id AS target FROM entries a JOIN entries b ON a.hw_norm = b.hw_norm AND a.pack = b.pack AND (a.level IS NULL OR a.level = b.level) WHERE a.kind = 'phrase' AND b.kind = 'word'")
def equi_or_theta(spark, d):
    e = entries(spark, d)
    a, b = e.filter("kind = 'phrase'").alias("a"), e.filter("kind = 'word'").alias("b")
    on = "a.hw_norm = b.hw_norm AND a.pack = b.pack AND (a.level IS NULL OR a.level = b.level)"
    return a.join(b, F.expr(on)).select(F.col("a.id").alias("pointer"), F.col("b.id").alias("target"))


@query("jn17_top3_per_key", f"{W} SELECT form, id FROM (SELECT f.form, e.id, row_number() OVER (PARTITION BY f.form ORDER BY e.source DESC, e.id) AS n FROM forms f JOIN entries e ON e.id = f.entry_id) WHERE n <= 3")
def top3_per_key(spark, d):
    x = forms(spark, d).join(entries(spark, d), F.col("entry_id") == F.col("id"))
    return x.withColumn("n", F.row_number().over(Window.partitionBy("form").orderBy(F.desc("source"), "id"))).filter("n <= 3").select("form", "id")


@query("jn19_three_way", "SELECT ko, min_by(en, l_linenumber) AS en FROM (SELECT c.c_name AS ko, l.l_linenumber + l.l_orderkey * 10 AS l_linenumber, s.s_name AS en FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier s ON s.s_suppkey = l.l_suppkey) GROUP BY ko")
def three_way(spark, d):
    """Of lines that tie the first in the table's files, as a reader of one thread finds it."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    x = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    key = F.col("l_linenumber") + F.col("l_orderkey") * 10
    return x.groupBy(F.col("c_name").alias("ko")).agg(F.min_by("s_name", F.when(key.isNotNull(), F.struct(key.alias("key"), "file", "row"))).alias("en"))


@query("jn20_lookup_ladder", f"{W} SELECT e.id, coalesce(a.g, b.g) AS english FROM entries e LEFT JOIN (SELECT hw_norm, kind, pack, min(gloss) AS g FROM entries WHERE source = 'Brand#2' GROUP BY ALL) a ON a.hw_norm = e.hw_norm AND a.kind = e.kind AND a.pack = e.pack LEFT JOIN (SELECT hw_norm, kind, min(gloss) AS g FROM entries WHERE source = 'Brand#2' GROUP BY ALL HAVING count(*) = 1) b ON b.hw_norm = e.hw_norm AND b.kind = e.kind")
def lookup_ladder(spark, d):
    e = entries(spark, d)
    s = e.filter("source = 'Brand#2'")
    a = s.groupBy("hw_norm", "kind", "pack").agg(F.min("gloss").alias("a"))
    b = s.groupBy("hw_norm", "kind").agg(F.min("gloss").alias("b"), F.count("*").alias("n")).filter("n = 1").drop("n")
    return e.join(a, ["hw_norm", "kind", "pack"], "left").join(b, ["hw_norm", "kind"], "left").select("id", F.coalesce("a", "b").alias("english"))


@query("jn21_positional_overlay", "SELECT c.conv_id, c.turn, CASE WHEN n.turn IS NOT NULL THEN upper(c.role) ELSE c.role END AS role FROM conversations c LEFT JOIN (SELECT conv_id, min(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id) n ON n.conv_id = c.conv_id AND n.turn = c.turn")
def positional_overlay(spark, d):
    c = table(spark, d, "conversations")
    n = c.filter("role = 'user'").groupBy("conv_id").agg(F.min("turn").alias("turn")).withColumn("fix", F.lit(True))
    return c.join(n, ["conv_id", "turn"], "left").select("conv_id", "turn", F.when(F.col("fix"), F.upper("role")).otherwise(F.col("role")).alias("role"))


@query("jn23_derived_fallback", f"{W} SELECT k.w, coalesce(a.m, b.m) AS id FROM (SELECT DISTINCT form AS w FROM forms) k LEFT JOIN (SELECT hw_norm, max(id) AS m FROM entries GROUP BY 1) a ON a.hw_norm = k.w LEFT JOIN (SELECT hw_norm, max(id) AS m FROM entries GROUP BY 1) b ON b.hw_norm = k.w || 'widget'")
def derived_fallback(spark, d):
    best = entries(spark, d).groupBy("hw_norm").agg(F.max("id").alias("m"))
    k = forms(spark, d).select(F.col("form").alias("w")).distinct()
    a, b = best.toDF("ka", "ma"), best.toDF("kb", "mb")
    return k.join(a, k.w == F.col("ka"), "left").join(b, F.concat(k.w, F.lit("widget")) == F.col("kb"), "left").select("w", F.coalesce("ma", "mb").alias("id"))


@query("jn28_attach_unique", "SELECT d.doc_id, u.item_id FROM documents d LEFT JOIN (SELECT t, min(item_id) AS item_id FROM (SELECT item_id, item_id % 100 AS t FROM benchmark) GROUP BY t HAVING count(*) = 1) u ON u.t = d.doc_id")
def attach_unique(spark, d):
    u = table(spark, d, "benchmark").groupBy((F.col("item_id") % 100).alias("t")).agg(F.min("item_id").alias("item_id"), F.count("*").alias("n")).filter("n = 1")
    return table(spark, d, "documents").join(u, F.col("doc_id") == F.col("t"), "left").select("doc_id", "item_id")


#: The ladder's rungs, from what must agree most to least; the last is the headword alone.
RUNGS = [["source", "kind", "level"], ["source", "kind"], ["source"], []]


@query("jn31_saved_ref_ladder", f"{W} SELECT want, id FROM (SELECT w.id AS want, e.id, row_number() OVER (PARTITION BY w.id ORDER BY CASE WHEN e.source = w.source AND e.kind = w.kind AND e.level IS NOT DISTINCT FROM w.level THEN 0 WHEN e.source = w.source AND e.kind = w.kind THEN 1 WHEN e.source = w.source THEN 2 ELSE 3 END, e.id) AS n FROM (SELECT id + 1 AS id, hw_norm, CASE WHEN id % 7 = 0 THEN 'gone' ELSE source END AS source, CASE WHEN id % 5 = 0 THEN 'gone' ELSE kind END AS kind, CASE WHEN id % 3 = 0 THEN 99 ELSE level END AS level FROM entries) w JOIN entries e ON e.hw_norm = w.hw_norm) WHERE n = 1")
def saved_ref_ladder(spark, d):
    """Where saved references lead today: to the entry of the headword that agrees on the highest rung.

    The saved references are all entries as they once were, some with a source, kind
    or level that no longer exists. Each rung's least entry is aggregated first,
    so that a headword with many entries isn't multiplied.
    """
    e = entries(spark, d)
    gone = lambda c, k, to: F.when(F.col("id") % k == 0, F.lit(to)).otherwise(F.col(c)).alias(c)
    w = e.select((F.col("id") + 1).alias("want"), "hw_norm", gone("source", 7, "gone"), gone("kind", 5, "gone"), gone("level", 3, 99))
    for n, keys in enumerate(RUNGS):
        best = e.groupBy("hw_norm", *keys).agg(F.min("id").alias(f"m{n}")).select(F.col("hw_norm").alias("_h"), f"m{n}", *(F.col(k).alias(f"_{k}") for k in keys))
        same = F.col("hw_norm") == F.col("_h")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        w = w.join(best, same, "left").drop("_h", *(f"_{k}" for k in keys))
    return w.select("want", F.coalesce("m0", "m1", "m2", "m3").alias("id"))

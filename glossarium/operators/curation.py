"""What turns raw entries into lists to learn from: scored linkage, folding, capped groups, levels, provenance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glossarium.plans.registry import query
from glossarium.plans.tables import ENTRIES, FORMS, TERMS, entries, forms, gloss_items, gloss_terms, table

W = f"WITH {ENTRIES}"


@query("jn02_contains", f"{W}, {FORMS} SELECT f.form, e.id FROM forms f JOIN entries e ON e.id = f.entry_id WHERE instr(e.pack, 'O') > 0")
def contains(spark, d):
    return forms(spark, d).join(entries(spark, d).filter(F.instr("pack", "O") > 0), F.col("entry_id") == F.col("id")).select("form", "id")


@query("jn22_scored_linkage", f"{W} SELECT want, arg_min(id, (-score, id)) AS id, max(score) AS score FROM (SELECT w.id AS want, e.id, CASE WHEN e.kind = w.kind THEN 4 ELSE 0 END + CASE WHEN e.pack = w.pack THEN 5 ELSE 0 END + CASE WHEN e.level = w.level THEN 8 ELSE 0 END AS score FROM entries w JOIN entries e ON e.hw_norm = w.hw_norm AND e.source <> w.source WHERE w.source = 'Brand#1') GROUP BY want")
def scored_linkage(spark, d):
    """The best candidate of each wanted row by fit of kind, pack and level; earlier claims on a candidate don't count.

    Rows that agree in what the score sees are one class, wanted ones and
    candidates alike, so a name that many rows have doesn't multiply them.
    """
    e = entries(spark, d)
    wanted = e.filter("source = 'Brand#1'").select(F.col("id").alias("want"), "hw_norm", F.col("kind").alias("wk"), F.col("pack").alias("wp"), F.col("level").alias("wl"))
    same = ["hw_norm", "wk", "wp", "wl"]
    w = wanted.select(same).distinct()
    e = e.filter("source <> 'Brand#1'").groupBy("hw_norm", "kind", "pack", "level").agg(F.min("id").alias("id"))
    part = lambda on, n: F.when(on, n).otherwise(0)
    score = part(F.col("kind") == F.col("wk"), 4) + part(F.col("pack") == F.col("wp"), 5) + part(F.col("level") == F.col("wl"), 8)
    best = w.join(e, "hw_norm").groupBy(same).agg(F.min(F.struct((-score).alias("s"), "id")).alias("b")).alias("best")
    on = [F.col(f"wanted.{c}").eqNullSafe(F.col(f"best.{c}")) for c in same]
    return wanted.alias("wanted").join(best, on).select("want", F.col("b.id").alias("id"), (-F.col("b.s")).alias("score"))


@query("jn25_resolution_ladder", f"{W}, {FORMS}, k AS (SELECT DISTINCT form AS w FROM forms UNION SELECT DISTINCT hw_norm FROM entries WHERE kind = 'idiom') SELECT k.w, coalesce(a.level, b.level) AS level, CASE WHEN a.w IS NOT NULL THEN 'headword' WHEN b.w IS NOT NULL THEN 'form' END AS via FROM k LEFT JOIN (SELECT hw_norm AS w, min(level) AS level FROM entries WHERE kind = 'word' GROUP BY 1) a ON a.w = k.w LEFT JOIN (SELECT f.form AS w, min(e.level) AS level FROM forms f JOIN entries e ON e.id = f.entry_id GROUP BY 1) b ON b.w = k.w")
def resolution_ladder(spark, d):
    e, f = entries(spark, d), forms(spark, d)
    k = f.select(F.col("form").alias("w")).union(e.filter("kind = 'idiom'").select("hw_norm")).distinct()
    a = e.filter("kind = 'word'").groupBy(F.col("hw_norm").alias("w")).agg(F.min("level").alias("la")).withColumn("ha", F.lit(True))
    b = f.join(e, F.col("entry_id") == F.col("id")).groupBy(F.col("form").alias("w")).agg(F.min("level").alias("lb")).withColumn("hb", F.lit(True))
    via = F.when(F.col("ha"), "headword").when(F.col("hb"), "form")
    return k.join(a, "w", "left").join(b, "w", "left").select("w", F.coalesce("la", "lb").alias("level"), via.alias("via"))


@query("jn26_synonym_bridge", f"{W}, {TERMS}, t AS (SELECT DISTINCT term, entry_id FROM gloss_terms WHERE tier = 0), m AS (SELECT entry_id, min(term) AS other FROM gloss_terms WHERE tier = 1 GROUP BY entry_id), s AS (SELECT t.term, m.other, count(*) AS score FROM t JOIN m ON m.entry_id = t.entry_id GROUP BY ALL HAVING count(*) >= 2) SELECT term, other, score FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, other) AS n FROM s) WHERE n <= 6")
def synonym_bridge(spark, d):
    g = gloss_terms(spark, d)
    m = g.filter("tier = 1").groupBy("entry_id").agg(F.min("term").alias("other"))
    s = g.filter("tier = 0").select("term", "entry_id").join(m, "entry_id").groupBy("term", "other").agg(F.count("*").alias("score")).filter("score >= 2")
    return s.withColumn("n", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "other"))).filter("n <= 6").drop("n")


@query("ag09_source_counts", f"{W} SELECT source, count(*) AS n FROM entries GROUP BY source")
def source_counts(spark, d):
    return entries(spark, d).groupBy("source").agg(F.count("*").alias("n"))


@query("ag11_best_tier", f"{W}, {TERMS} SELECT pack, entry_id, arg_min(term, (tier, score, term)) AS term FROM gloss_terms GROUP BY pack, entry_id")
def best_tier(spark, d):
    return gloss_terms(spark, d).groupBy("pack", "entry_id").agg(F.min(F.struct("tier", "score", "term")).alias("b")).select("pack", "entry_id", F.col("b.term").alias("term"))


@query("ag15_capped_groups", f"{W} SELECT pack, kind, id FROM (SELECT *, row_number() OVER (PARTITION BY pack, kind ORDER BY rank, id) AS n, row_number() OVER (PARTITION BY pack ORDER BY rank, id) AS m FROM entries) WHERE n <= 6 AND m <= 48")
def capped_groups(spark, d):
    n = F.row_number().over(Window.partitionBy("pack", "kind").orderBy("rank", "id"))
    m = F.row_number().over(Window.partitionBy("pack").orderBy("rank", "id"))
    return entries(spark, d).select("pack", "kind", "id", "rank").withColumn("m", m).filter("m <= 48").withColumn("n", n).filter("n <= 6").select("pack", "kind", "id")


@query("ag32_group_counts", f"{W} SELECT source, kind, count(*) AS n, count(level) AS levelled FROM entries GROUP BY source, kind")
def group_counts(spark, d):
    return entries(spark, d).groupBy("source", "kind").agg(F.count("*").alias("n"), F.count("level").alias("levelled"))


@query("flt13_junk_gloss", f"{W} SELECT id FROM entries WHERE NOT regexp_matches(gloss, '^(cold|hot) ') AND NOT regexp_matches(headword, '[0-9]') AND length(trim(gloss)) > 0")
def junk_gloss(spark, d):
    return entries(spark, d).filter(~F.col("gloss").rlike("^(cold|hot) ") & ~F.col("headword").rlike("[0-9]") & (F.length(F.trim("gloss")) > 0)).select("id")


@query("flt16_one_licence", "SELECT doc_id FROM documents WHERE len(list_distinct(regexp_extract_all(lower(text), '(?:mit|apache|gnu) (?:general public )?licen[sc]e'))) = 1")
def one_licence(spark, d):
    return table(spark, d, "documents").filter(F.size(F.array_distinct(F.expr("regexp_extract_all(lower(text), '(?:mit|apache|gnu) (?:general public )?licen[sc]e', 0)"))) == 1).select("doc_id")


@query("flt17_home_eligible", f"{W} SELECT id FROM entries e WHERE kind = 'word' AND level IS NOT NULL AND trim(gloss) <> '' AND EXISTS (SELECT 1 FROM benchmark b WHERE instr(b.text, 'e') > 0 AND b.item_id = e.id % 50)")
def home_eligible(spark, d):
    b = table(spark, d, "benchmark").filter(F.instr("text", "e") > 0).select("item_id")
    e = entries(spark, d).filter("kind = 'word' AND level IS NOT NULL AND trim(gloss) <> ''")
    return e.join(b, F.col("item_id") == F.col("id") % 50, "left_semi").select("id")


@query("prj07_score", f"{W} SELECT id, (CASE kind WHEN 'word' THEN 0 ELSE 1 END + CASE source WHEN 'Brand#1' THEN 0 ELSE 2 END) * 10000000 + least(rank, 9999999) AS score FROM entries")
def score(spark, d):
    tier = F.when(F.col("kind") == "word", 0).otherwise(1) + F.when(F.col("source") == "Brand#1", 0).otherwise(2)
    return entries(spark, d).select("id", (tier.cast("long") * 10_000_000 + F.least("rank", F.lit(9_999_999))).alias("score"))


@query("prj12_difficulty", "SELECT doc_id, CASE WHEN length(text) < 500 THEN 1 WHEN length(text) < 2000 AND lang = 'en' THEN 2 WHEN length(text) < 5000 THEN 3 ELSE 4 END AS level FROM documents")
def difficulty(spark, d):
    n = F.length("text")
    return table(spark, d, "documents").select("doc_id", F.when(n < 500, 1).when((n < 2000) & (F.col("lang") == "en"), 2).when(n < 5000, 3).otherwise(4).alias("level"))


@query("prj13_first_items", f"{W} SELECT id, array_to_string([y for y in [regexp_replace(trim(lower(x)), '^to ', '') for x in regexp_split_to_array(gloss, '[;,]')] if y <> ''][1:3], '; ') AS items FROM entries")
def first_items(spark, d):
    return entries(spark, d).select("id", F.array_join(F.slice(F.filter(gloss_items(F.col("gloss")), lambda x: x != ""), 1, 3), "; ").alias("items"))


@query("prj16_pos_bucket", f"{W} SELECT id, CASE WHEN kind = 'word' AND level <= 2 THEN 'basic' WHEN kind = 'word' THEN 'word' ELSE 'other' END AS bucket FROM entries")
def pos_bucket(spark, d):
    return entries(spark, d).select("id", F.when((F.col("kind") == "word") & (F.col("level") <= 2), "basic").when(F.col("kind") == "word", "word").otherwise("other").alias("bucket"))


@query("prj15_pending_status", "SELECT d.doc_id, CASE WHEN b.item_id IS NOT NULL THEN 'held' WHEN l.quality = 0 THEN 'repair' WHEN l.quality = 1 THEN 'preparing' ELSE 'source' END AS status FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id LEFT JOIN (SELECT DISTINCT item_id FROM benchmark) b ON b.item_id = d.doc_id")
def pending_status(spark, d):
    lab = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    held = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")).distinct().withColumn("held", F.lit(True))
    status = F.when(F.col("held"), "held").when(F.col("quality") == 0, "repair").when(F.col("quality") == 1, "preparing").otherwise("source")
    return table(spark, d, "documents").select("doc_id").join(lab, "doc_id", "left").join(held, "doc_id", "left").select("doc_id", status.alias("status"))


@query("srt09_natural_order", "SELECT c_name, row_number() OVER (ORDER BY lpad(regexp_extract(c_name, '[0-9]+'), 12, '0') DESC, c_name) AS n FROM customer ORDER BY n LIMIT 50")
def natural_order(spark, d):
    key = F.lpad(F.regexp_extract("c_name", "[0-9]+", 0), 12, "0")
    top = table(spark, d, "customer").select("c_name", key.alias("key")).orderBy(F.desc("key"), "c_name").limit(50)
    return top.select("c_name", F.row_number().over(Window.orderBy(F.desc("key"), "c_name")).alias("n"))


@query("srt22_source_order", f"{W} SELECT hw_norm, id, row_number() OVER (PARTITION BY hw_norm ORDER BY CASE source WHEN 'Brand#3' THEN 0 WHEN 'Brand#1' THEN 1 ELSE 2 END, rank, id) AS n FROM entries")
def source_order(spark, d):
    place = F.when(F.col("source") == "Brand#3", 0).when(F.col("source") == "Brand#1", 1).otherwise(2)
    return entries(spark, d).select("hw_norm", "id", F.row_number().over(Window.partitionBy("hw_norm").orderBy(place, "rank", "id")).alias("n"))


@query("qry19_translations", f"{W} SELECT hw_norm, kind, min(rank) AS rank, string_agg(DISTINCT source, '|' ORDER BY source) AS sources FROM entries GROUP BY hw_norm, kind")
def translations(spark, d):
    return entries(spark, d).groupBy("hw_norm", "kind").agg(F.min("rank").alias("rank"), F.array_join(F.sort_array(F.collect_set("source")), "|").alias("sources"))


@query("qry22_attach_facet", f"{W} SELECT hw_norm, coalesce(min(gloss) FILTER (source = 'Brand#1'), min(gloss) FILTER (source = 'Brand#2'), min(gloss)) AS facet FROM entries GROUP BY hw_norm")
def attach_facet(spark, d):
    of = lambda s: F.min(F.when(F.col("source") == s, F.col("gloss")))
    return entries(spark, d).groupBy("hw_norm").agg(F.coalesce(of("Brand#1"), of("Brand#2"), F.min("gloss")).alias("facet"))


@query("qry32_pool", f"{W} SELECT id, min(origin) AS origin FROM (SELECT id, 0 AS origin FROM entries WHERE rank % 7 = 0 UNION ALL SELECT id, 1 FROM entries WHERE level = 3 AND kind = 'word') GROUP BY id")
def pool(spark, d):
    """Due words first, then fresh ones of the level; one scan, as both conditions are on the same row."""
    origin = F.when(F.col("rank") % 7 == 0, 0).when((F.col("level") == 3) & (F.col("kind") == "word"), 1)
    return entries(spark, d).select("id", origin.alias("origin")).filter("origin IS NOT NULL")

"""Aggregation, distinct and dedupe. All sums are partial before they are shuffled."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossarium.plans.registry import query
from glossarium.plans.tables import ENTRIES, FORMS, TERMS, entries, forms, gloss_terms, table

W = f"WITH {ENTRIES}"


@query("ag01_table_counts", "SELECT 'part' AS name, count(*) AS n FROM part UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def table_counts(spark, d):
    out = [table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("part", "orders", "lineitem")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("ag02_count_distinct_level", f"{W} SELECT level, count(DISTINCT hw_norm) AS n FROM entries GROUP BY level")
def count_distinct_level(spark, d):
    return entries(spark, d).groupBy("level").agg(F.countDistinct("hw_norm").alias("n"))


@query("ag03_count_groups", f"{W} SELECT pack, kind, count(*) AS n FROM entries GROUP BY pack, kind")
def count_groups(spark, d):
    return entries(spark, d).groupBy("pack", "kind").agg(F.count("*").alias("n"))


@query("ag04_word_count", f"{W}, {FORMS} SELECT form, count(DISTINCT e.hw_norm) AS n FROM forms f JOIN entries e ON e.id = f.entry_id GROUP BY form")
def word_count(spark, d):
    return forms(spark, d).join(entries(spark, d), F.col("entry_id") == F.col("id")).groupBy("form").agg(F.countDistinct("hw_norm").alias("n"))


@query("ag05_group_min_order", f"{W} SELECT hw_norm, min(level) AS level, min(rank) AS rank FROM entries GROUP BY hw_norm")
def group_min_order(spark, d):
    return entries(spark, d).groupBy("hw_norm").agg(F.min("level").alias("level"), F.min("rank").alias("rank")).orderBy("level", "rank", "hw_norm")


@query("ag06_group_page_join", f"{W}, p AS (SELECT hw_norm, min(rank) AS r FROM entries GROUP BY hw_norm ORDER BY r, hw_norm LIMIT 10 OFFSET 5) SELECT p.hw_norm, p.r, e.id FROM p JOIN entries e ON e.hw_norm = p.hw_norm AND e.rank = p.r")
def group_page_join(spark, d):
    e = entries(spark, d)
    page = e.groupBy("hw_norm").agg(F.min("rank").alias("r")).orderBy("r", "hw_norm").offset(5).limit(10)
    return page.join(e, (page.hw_norm == e.hw_norm) & (page.r == e.rank)).select(page.hw_norm, "r", "id")


@query("ag07_count_and_min", "SELECT o_custkey, count(*) AS n, min(o_totalprice) AS least FROM orders GROUP BY o_custkey")
def count_and_min(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("least"))


@query("ag08_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("ag10_first_wins", f"{W}, {FORMS} SELECT form, id FROM (SELECT f.form, e.id, row_number() OVER (PARTITION BY f.form ORDER BY e.rank, e.id) AS n FROM forms f JOIN entries e ON e.id = f.entry_id) WHERE n = 1")
def first_wins(spark, d):
    x = forms(spark, d).join(entries(spark, d), F.col("entry_id") == F.col("id"))
    return x.groupBy("form").agg(F.min(F.struct("rank", "id")).alias("b")).select("form", F.col("b.id").alias("id"))


@query("ag13_group_concat_ci", "SELECT p_size, string_agg(lower_type, '; ' ORDER BY lower_type) AS glosses FROM (SELECT DISTINCT p_size, lower(p_type) AS lower_type FROM part) GROUP BY p_size")
def group_concat_ci(spark, d):
    return table(spark, d, "part").groupBy("p_size").agg(F.array_join(F.sort_array(F.collect_set(F.lower("p_type"))), "; ").alias("glosses"))


@query("ag17_term_dedupe", f"{W}, {TERMS} SELECT term, entry_id, score, tier FROM gloss_terms")
def term_dedupe(spark, d):
    return gloss_terms(spark, d).select("term", "entry_id", "score", "tier")


@query("ag18_priority_union", "SELECT name, arg_min(src, pri) AS src FROM (SELECT c_mktsegment AS name, 'c' AS src, 0 AS pri FROM customer UNION ALL SELECT p_type, 'p', 1 FROM part UNION ALL SELECT n_name, 'n', 2 FROM nation UNION ALL SELECT lower(p_type), 'q', 3 FROM part) GROUP BY name")
def priority_union(spark, d):
    parts = [
        table(spark, d, "customer").select(F.col("c_mktsegment").alias("name"), F.lit("c").alias("src"), F.lit(0).alias("pri")),
        table(spark, d, "part").select(F.col("p_type").alias("name"), F.lit("p").alias("src"), F.lit(1).alias("pri")),
        table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit("n").alias("src"), F.lit(2).alias("pri")),
        table(spark, d, "part").select(F.lower("p_type").alias("name"), F.lit("q").alias("src"), F.lit(3).alias("pri")),
    ]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return u.groupBy("name").agg(F.min_by("src", "pri").alias("src"))


@query("ag19_jaccard_pairs", "WITH w AS (SELECT DISTINCT p_name, unnest(string_split(p_name, ' ')) AS w FROM part), s AS (SELECT p_name, count(*) AS n FROM w GROUP BY 1) SELECT a.p_name AS a, b.p_name AS b, round(count(*) / (any_value(x.n) + any_value(y.n) - count(*)), 6) AS jaccard FROM w a JOIN w b ON a.w = b.w AND a.p_name < b.p_name JOIN s x ON x.p_name = a.p_name JOIN s y ON y.p_name = b.p_name GROUP BY a.p_name, b.p_name HAVING count(*) / (any_value(x.n) + any_value(y.n) - count(*)) >= 0.3")
def jaccard_pairs(spark, d):
    names = table(spark, d, "part").select("p_name").distinct().withColumn("s", F.array_distinct(F.split("p_name", " ")))
    w = names.select("p_name", F.size("s").alias("n"), F.explode("s").alias("w"))
    a, b = w.toDF("a", "na", "w"), w.toDF("b", "nb", "w")
    x = a.join(b, "w").filter("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k"))
    j = F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))
    return x.filter(j >= 0.3).select("a", "b", F.round(j, 6).alias("jaccard"))


@query("ag22_per_million", "WITH t AS (SELECT lang, sum(len(string_split(text, ' '))) AS total FROM documents GROUP BY lang), h AS (SELECT lang, sum(len(string_split(text, ' the ')) - 1) AS hits FROM documents GROUP BY lang) SELECT t.lang, round(h.hits * 1000000.0 / t.total, 3) AS per_million FROM t JOIN h ON h.lang = t.lang")
def per_million(spark, d):
    g = table(spark, d, "documents").groupBy("lang").agg(F.sum(F.size(F.split("text", " "))).alias("total"), F.sum(F.size(F.split("text", " the ")) - 1).alias("hits"))
    return g.select("lang", F.round(F.col("hits") * F.lit(1e6) / F.col("total"), 3).alias("per_million"))


@query("ag23_bucket_stats", "SELECT p_size // 10 AS bucket, min(p_retailprice) AS least, median(p_retailprice) AS middle, max(p_retailprice) AS most FROM part GROUP BY 1")
def bucket_stats(spark, d):
    g = table(spark, d, "part").groupBy(F.floor(F.col("p_size") / 10).cast("int").alias("bucket"))
    return g.agg(F.min("p_retailprice").alias("least"), F.percentile("p_retailprice", F.lit(0.5)).alias("middle"), F.max("p_retailprice").alias("most"))


@query("ag26_count_drop", "WITH a AS (SELECT l_returnflag || l_linestatus AS k, count(*) AS n FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY 1), b AS (SELECT l_returnflag || l_linestatus AS k, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01' GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after FROM a FULL JOIN b ON a.k = b.k WHERE coalesce(a.n, 0) >= 50 AND coalesce(b.n, 0) < 0.98 * a.n")
def count_drop(spark, d):
    x = table(spark, d, "lineitem").withColumn("k", F.concat("l_returnflag", "l_linestatus"))
    early = F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp")
    g = x.groupBy("k").agg(F.count(F.when(early, 1)).alias("before"), F.count(F.when(~early, 1)).alias("after"))
    return g.filter("before >= 50 AND after < 0.98 * before")


@query("ag27_source_diff", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'missing' WHEN a.n != b.n THEN 'changed' ELSE 'same' END AS state FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def source_diff(spark, d):
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("na"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("nb"))
    state = F.when(F.col("na").isNull(), "new").when(F.col("nb").isNull(), "missing").when(F.col("na") != F.col("nb"), "changed").otherwise("same")
    return a.join(b, "k", "full").select("k", state.alias("state"))


@query("ag28_quality_gate", "SELECT 'part' AS name, count(*) >= 100 AS ok FROM part UNION ALL SELECT 'orders', count(*) >= 1000000000 FROM orders")
def quality_gate(spark, d):
    gate = lambda t, least: table(spark, d, t).agg((F.count("*") >= least).alias("ok")).select(F.lit(t).alias("name"), "ok")
    return gate("part", 100).unionByName(gate("orders", 1_000_000_000))


@query("ag29_topic_rollup", "SELECT p_type AS top, p_brand AS sub, count(*) AS n FROM part GROUP BY ROLLUP (p_type, p_brand)")
def topic_rollup(spark, d):
    return table(spark, d, "part").rollup(F.col("p_type").alias("top"), F.col("p_brand").alias("sub")).agg(F.count("*").alias("n"))


@query("ag30_distinct_items", "SELECT count(DISTINCT w) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)")
def distinct_items(spark, d):
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).agg(F.countDistinct("w").alias("n"))


@query("ag31_text_stats", "SELECT lang, sum(length(text)) AS chars, sum(len(string_split(text, chr(10)))) AS paragraphs, count(*) AS texts FROM documents GROUP BY lang")
def text_stats(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), F.sum(F.size(F.split("text", "\n"))).alias("paragraphs"), F.count("*").alias("texts"))


@query("ag24_candidates", f"{W} SELECT hw_norm, kind, count(*) AS n, min(CASE source WHEN 'Brand#1' THEN id END) AS first_a, min(CASE source WHEN 'Brand#2' THEN id END) AS first_b FROM entries GROUP BY hw_norm, kind")
def candidates(spark, d):
    pick = lambda s: F.min(F.when(F.col("source") == s, F.col("id")))
    return entries(spark, d).groupBy("hw_norm", "kind").agg(F.count("*").alias("n"), pick("Brand#1").alias("first_a"), pick("Brand#2").alias("first_b"))


@query("ag14_merge_lines", "SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn, role) AS roles FROM conversations GROUP BY conv_id")
def merge_lines(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(rows, lambda r: r["role"]), ">").alias("roles"))

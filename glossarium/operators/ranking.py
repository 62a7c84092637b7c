"""Windows, order, limits, paging and choices. Global ordinals come from ranges of keys and counts by partition (numbering)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glossarium.operators.numbering import numbered
from glossarium.plans.registry import query
from glossarium.plans.tables import ENTRIES, FORMS, entries, forms, table

W = f"WITH {ENTRIES}"


@query("win01_wotd", f"{W} SELECT row_number() OVER (ORDER BY id) - 1 AS n, id FROM entries WHERE source = 'Brand#1' AND level = 3 AND kind = 'word' AND trim(gloss) != ''")
def wotd(spark, d):
    rows = entries(spark, d).filter("source = 'Brand#1' AND level = 3 AND kind = 'word' AND trim(gloss) != ''").select("id")
    return numbered(rows, ["id"]).select("n", "id")


@query("win02_sort_ordinal", "SELECT n_nationkey, row_number() OVER (ORDER BY n_regionkey, n_name) AS sort FROM nation")
def sort_ordinal(spark, d):
    return numbered(table(spark, d, "nation"), ["n_regionkey", "n_name"]).select("n_nationkey", (F.col("n") + 1).alias("sort"))


@query("win03_rank_in_term", f"{W}, {FORMS} SELECT f.form, e.id, row_number() OVER (PARTITION BY f.form ORDER BY e.rank, e.id) - 1 AS n FROM forms f JOIN entries e ON e.id = f.entry_id")
def rank_in_term(spark, d):
    x = forms(spark, d).join(entries(spark, d), F.col("entry_id") == F.col("id"))
    return x.select("form", "id", (F.row_number().over(Window.partitionBy("form").orderBy("rank", "id")) - 1).cast("long").alias("n"))


@query("win04_paragraphs", "SELECT item_id, n - 1 AS n, string_split(text, '. ')[n] AS paragraph FROM (SELECT item_id, text, unnest(range(1, len(string_split(text, '. ')) + 1)) AS n FROM benchmark)")
def paragraphs(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", "\\. ")).alias("n", "paragraph")).withColumn("n", F.col("n").cast("long"))


@query("win05_global_rank", "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN row_number() OVER (PARTITION BY s_acctbal > 0 ORDER BY s_acctbal DESC, s_suppkey) END AS rank FROM supplier")
def global_rank(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    good = F.coalesce(F.col("s_acctbal") > 0, F.lit(False))
    ranked = numbered(s.filter(good), [F.desc("s_acctbal"), "s_suppkey"]).select("s_suppkey", (F.col("n") + 1).alias("rank"))
    return ranked.unionByName(s.filter(~good).select("s_suppkey", F.lit(None).cast("long").alias("rank")))


@query("win06_topk_per_pack", f"{W} SELECT id, pack FROM (SELECT *, row_number() OVER (PARTITION BY pack ORDER BY rank, id) AS n FROM entries) WHERE n <= 50")
def topk_per_pack(spark, d):
    e = entries(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("pack").orderBy("rank", "id")))
    return e.filter("n <= 50").select("id", "pack")


@query("win07_section_of", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY ALL)")
def section_of(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return c.select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("section"))


@query("win09_prev_next", "SELECT event_id, lag(event_id) OVER w AS prev, lead(event_id) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def prev_next(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.lag("event_id").over(w).alias("prev"), F.lead("event_id").over(w).alias("next"))


@query("srt01_global_topk", f"{W} SELECT id, rank FROM entries ORDER BY rank DESC, pack, id LIMIT 50")
def global_topk(spark, d):
    return entries(spark, d).orderBy(F.desc("rank"), "pack", "id").limit(50).select("id", "rank")


@query("srt02_order_preserving", f"{W}, t AS (SELECT id, row_number() OVER (ORDER BY rank DESC, id) AS n FROM entries ORDER BY n LIMIT 20) SELECT t.n, e.id, e.headword FROM t JOIN entries e ON e.id = t.id")
def order_preserving(spark, d):
    e = entries(spark, d)
    top = e.orderBy(F.desc("rank"), "id").limit(20).select("id", F.row_number().over(Window.orderBy(F.desc("rank"), "id")).cast("long").alias("n"))
    return top.join(e, "id").select("n", "id", "headword")


@query("srt04_english_order", f"{W} SELECT id, round(rank * (1 - 0.15 * CASE source WHEN 'Brand#1' THEN 0 WHEN 'Brand#2' THEN 1 ELSE 2 END), 3) AS key FROM entries ORDER BY key, id LIMIT 100")
def english_order(spark, d):
    q = F.when(F.col("source") == "Brand#1", 0).when(F.col("source") == "Brand#2", 1).otherwise(2)
    return entries(spark, d).select("id", F.round(F.col("rank") * (1 - F.lit(0.15) * q), 3).alias("key")).orderBy("key", "id").limit(100)


@query("srt05_null_order", f"{W} SELECT id FROM entries ORDER BY level IS NULL, length(gloss), id LIMIT 30")
def null_order(spark, d):
    return entries(spark, d).orderBy(F.col("level").isNull(), F.length("gloss"), "id").limit(30).select("id")


@query("srt06_nulls_last", f"{W} SELECT id FROM entries ORDER BY level NULLS LAST, hw_norm, id LIMIT 30")
def nulls_last(spark, d):
    return entries(spark, d).orderBy(F.asc_nulls_last("level"), "hw_norm", "id").limit(30).select("id")


@query("srt07_page", f"{W} SELECT id FROM entries ORDER BY rank, id LIMIT 20 OFFSET 40")
def page(spark, d):
    return entries(spark, d).orderBy("rank", "id").offset(40).limit(20).select("id")


@query("srt10_examples", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'user' THEN 0 ELSE 1 END, length(text), turn, text) AS n FROM conversations) WHERE n <= 3")
def examples(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.when(F.col("role") == "user", 0).otherwise(1), F.length("text"), "turn", "text")
    return table(spark, d, "conversations").withColumn("n", F.row_number().over(w)).filter("n <= 3").select("conv_id", "turn")


@query("srt11_srs_round", "SELECT o_orderkey FROM orders ORDER BY CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 0 WHEN o_orderstatus = 'P' THEN 1 ELSE 2 END, o_orderdate, o_orderkey LIMIT 25")
def srs_round(spark, d):
    bucket = F.when(F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp"), 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return table(spark, d, "orders").orderBy(bucket, "o_orderdate", "o_orderkey").limit(25).select("o_orderkey")


@query("srt12_phrase_order", f"{W} SELECT DISTINCT gloss, NOT starts_with(gloss, 'cold') AS later, length(gloss) AS n FROM entries WHERE contains(gloss, 'cold') ORDER BY later, n, gloss LIMIT 30")
def phrase_order(spark, d):
    e = entries(spark, d).filter(F.contains("gloss", F.lit("cold"))).select("gloss", (~F.col("gloss").startswith("cold")).alias("later"), F.length("gloss").cast("long").alias("n")).distinct()
    return e.orderBy("later", "n", "gloss").limit(30)


@query("srt13_rarest", f"{W}, {FORMS}, c AS (SELECT form, count(*) AS n FROM forms GROUP BY form) SELECT f.entry_id, arg_min(f.form, c.n * 1000 + ascii(f.form)) AS rarest FROM forms f JOIN c ON c.form = f.form GROUP BY f.entry_id")
def rarest(spark, d):
    f = forms(spark, d)
    c = f.groupBy("form").agg(F.count("*").alias("n"))
    return f.join(c, "form").groupBy("entry_id").agg(F.min_by("form", F.col("n") * 1000 + F.ascii("form")).alias("rarest"))


@query("srt14_longest_match", "SELECT item_id, w FROM (SELECT item_id, w, row_number() OVER (PARTITION BY item_id ORDER BY length(w) DESC, w) AS n FROM (SELECT item_id, unnest(string_split(text, ' ')) AS w FROM benchmark)) WHERE n = 1")
def longest_match(spark, d):
    w = table(spark, d, "benchmark").select("item_id", F.explode(F.split("text", " ")).alias("w"))
    return w.groupBy("item_id").agg(F.min(F.struct(-F.length("w"), "w")).alias("b")).select("item_id", F.col("b.w").alias("w"))


@query("srt15_random")
def random(spark, d):
    return entries(spark, d).orderBy(F.rand(7)).limit(20).select("id")


@query("srt19_canonical_order", "SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey ORDER BY r_name, n_name")
def canonical_order(spark, d):
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_name", "r_name").orderBy("r_name", "n_name")


@query("srt20_history", "SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY ALL ORDER BY ts DESC, user_id, event_type LIMIT 100")
def history(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), "user_id", "event_type").limit(100)


@query("srt21_first_appearance", f"{W} SELECT kind, min(id) AS first FROM entries GROUP BY kind ORDER BY first")
def first_appearance(spark, d):
    return entries(spark, d).groupBy("kind").agg(F.min("id").alias("first")).orderBy("first")

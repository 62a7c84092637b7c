"""Ranked search over the dictionary model: staged lookups, gloss tiers, full text and phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossarium.plans.registry import query
from glossarium.plans.tables import ENTRIES, FORMS, TERMS, entries, forms, gloss_items, gloss_terms, quality, table

W = f"WITH {ENTRIES}"

#: Limits of the search; they decide which rows are found, not only how many are shown.
EXACT_PER_PACK, PREFIX_SCAN, PREFIX_PER_PACK, TIER_STEP = 60, 2000, 40, 10_000_000


def first_n(rows: DataFrame, by: list[str], n: int, *order) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def gloss_search(terms: DataFrame, q: str, limit: int = 100) -> DataFrame:
    """Entries whose gloss has the query as an item, then those with an item that begins with it."""
    exact = first_n(terms.filter(F.col("term") == q), ["pack"], EXACT_PER_PACK, "score", "entry_id")
    exact = exact.groupBy("pack", "entry_id").agg(F.min("score").alias("key"))
    if len(q) >= 3:
        scan = first_n(terms.filter(F.col("term").startswith(q) & (F.col("term") != q)), ["pack"], PREFIX_SCAN, "term", "score", "entry_id")
        near = scan.join(exact.select("pack", "entry_id"), ["pack", "entry_id"], "left_anti")
        near = near.groupBy("pack", "entry_id").agg(F.min(F.col("score") + (2 - F.col("tier")) * TIER_STEP).alias("key"))
        exact = exact.withColumn("stage", F.lit(0)).unionByName(first_n(near, ["pack"], PREFIX_PER_PACK, "key", "entry_id").withColumn("stage", F.lit(1)))
    else:
        exact = exact.withColumn("stage", F.lit(0))
    return exact.orderBy("stage", "key", "pack", "entry_id").limit(limit).select("stage", "key", "pack", "entry_id")


@query(
    "qry05_gloss_tiers",
    f"""{W}, {TERMS},
x AS (SELECT pack, entry_id, min(score) AS key FROM (SELECT *, row_number() OVER (PARTITION BY pack ORDER BY score, entry_id) AS n FROM gloss_terms WHERE term = 'economy') WHERE n <= 60 GROUP BY ALL),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pack ORDER BY term, score, entry_id) AS n FROM gloss_terms WHERE starts_with(term, 'economy') AND term != 'economy') WHERE n <= 2000),
y AS (SELECT pack, entry_id, min(score + (2 - tier) * 10000000) AS key FROM s WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.pack = s.pack AND x.entry_id = s.entry_id) GROUP BY ALL),
z AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pack ORDER BY key, entry_id) AS n FROM y) WHERE n <= 40)
SELECT stage, key, pack, entry_id FROM (SELECT 0 AS stage, key, pack, entry_id FROM x UNION ALL SELECT 1, key, pack, entry_id FROM z) ORDER BY stage, key, pack, entry_id LIMIT 100""",
)
def gloss_tiers(spark, d):
    return gloss_search(gloss_terms(spark, d), "economy")


@query(
    "qry04_staged_search",
    f"""{W}, {FORMS}, u AS (
SELECT 0 AS stage, id, pack, rank FROM entries WHERE hw_norm = 'coldgear' UNION ALL
SELECT 1, e.id, e.pack, e.rank FROM forms f JOIN entries e ON e.id = f.entry_id WHERE f.form = 'gear' UNION ALL
SELECT 2, id, pack, rank FROM entries WHERE starts_with(hw_norm, 'cold'))
SELECT min(stage) AS stage, id, pack, rank FROM u GROUP BY id, pack, rank ORDER BY 1, rank, pack, id LIMIT 100""",
)
def staged_search(spark, d):
    e = entries(spark, d).select("id", "pack", "rank", "hw_norm")
    exact = e.filter("hw_norm = 'coldgear'").withColumn("stage", F.lit(0))
    by_form = e.join(forms(spark, d).filter("form = 'gear'").select(F.col("entry_id").alias("id")), "id").withColumn("stage", F.lit(1))
    prefix = e.filter(F.col("hw_norm").startswith("cold")).withColumn("stage", F.lit(2))
    u = exact.unionByName(by_form).unionByName(prefix)
    return u.groupBy("id", "pack", "rank").agg(F.min("stage").alias("stage")).orderBy("stage", "rank", "pack", "id").limit(100).select("stage", "id", "pack", "rank")


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")


def bm25(docs: DataFrame, query_words: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of documents that have every query word; lower is better, as in the full-text index it stands for.

    Statistics of the corpus are one row, and so is what is broadcast.
    """
    words = docs.select("id", tokens(F.col("text")).alias("w"))
    stats = words.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("mean"))
    wanted = F.array(*map(F.lit, query_words))
    hits = words.select("id", F.size("w").alias("len"), F.explode(F.filter("w", lambda x: F.array_contains(wanted, x))).alias("word"))
    tf = hits.groupBy("id", "len", "word").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    x = tf.join(F.broadcast(df), "word").crossJoin(F.broadcast(stats))  # as many rows as query words, and one
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return x.groupBy("id").agg(F.count("*").alias("k"), (-F.sum(part)).alias("score")).filter(F.col("k") == len(query_words)).select("id", "score")


@query(
    "qry07_bm25",
    """WITH w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x != '') AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
tf AS (SELECT id, any_value(len) AS len, word, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(list_filter(w, lambda x: x IN ('this', 'was'))) AS word FROM w) GROUP BY id, word),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word)
SELECT id, round(-sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
FROM tf JOIN df USING (word), st GROUP BY id HAVING count(*) = 2""",
)
def bm25_query(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return bm25(docs, ["this", "was"]).select("id", F.round("score", 6).alias("score"))


@query("qry13_by_headword", f"{W} SELECT headword, arg_min(id, rank * 100000 + id) AS id FROM entries GROUP BY headword")
def by_headword(spark, d):
    return entries(spark, d).groupBy("headword").agg(F.min_by("id", F.col("rank") * 100000 + F.col("id")).alias("id"))


def similar_words(e: DataFrame, per_pack: int = 40, limit: int = 6) -> DataFrame:
    """(id, n, other): for each entry (id, pack, hw_norm, kind, gloss, score) words of other headwords that have its first gloss item as their own first, or else its second.

    Candidates are a pack's best per_pack entries of a term, so that a common
    term doesn't multiply; of a headword's candidates the best counts.
    """
    items = F.slice(F.filter(F.transform(gloss_items(F.col("gloss")), lambda x: F.regexp_replace(x, r"\s+", " ")), lambda x: (x != "") & (F.length(x) <= 40)), 1, 2)
    own = e.select("id", "hw_norm", F.posexplode(items).alias("k", "term"))
    best = e.select(F.get(F.filter(gloss_items(F.col("gloss")), lambda x: x != ""), F.lit(0)).alias("term"), "pack", "kind", F.col("hw_norm").alias("other"), "score", F.col("id").alias("other_id"))
    best = first_n(best.filter(F.length("term") <= 40), ["term", "pack"], per_pack, "score", "other_id").filter("kind = 'word'").groupBy("term", "other").agg(F.min("score").alias("score"))
    hits = own.join(best, "term").filter("other != hw_norm").select("id", "k", "score", "other")
    first = hits.withColumn("first", F.min("k").over(Window.partitionBy("id"))).filter("k = first")
    n = F.row_number().over(Window.partitionBy("id").orderBy("score", "other"))
    return first.select("id", n.alias("n"), "other").filter(F.col("n") <= limit)


@query(
    "qry14_similar",
    f"""{W}, g AS (SELECT id, pack, hw_norm, kind, [CASE WHEN id % 4 = 0 THEN headword ELSE lower(pack) END, lower(source)] AS items,
  CASE source WHEN 'Brand#1' THEN 0 WHEN 'Brand#2' THEN 1 ELSE 2 END * 10000000 + least(rank, 9999999) AS score FROM entries),
top AS (SELECT term, other, min(score) AS score FROM (SELECT items[1] AS term, hw_norm AS other, kind, score, row_number() OVER (PARTITION BY items[1], pack ORDER BY score, id) AS n FROM g) WHERE n <= 40 AND kind = 'word' GROUP BY ALL),
c AS (SELECT g.id, k.k, top.other, top.score FROM g, (VALUES (1), (2)) k(k) JOIN top ON top.term = g.items[k.k] WHERE top.other != g.hw_norm)
SELECT id, n, other FROM (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY score, other) AS n FROM (SELECT *, min(k) OVER (PARTITION BY id) AS first FROM c) WHERE k = first) WHERE n <= 6""",
)
def similar(spark, d):
    """Over entries whose gloss begins with the pack's name, or for every fourth with the headword, which no other entry shares."""
    e = entries(spark, d)
    gloss = F.concat(F.when(F.col("id") % 4 == 0, F.col("headword")).otherwise(F.lower("pack")), F.lit("; "), F.lower("source"))
    score = quality(F.col("source")).cast("long") * TIER_STEP + F.least("rank", F.lit(9_999_999))
    return similar_words(e.select("id", "pack", "hw_norm", "kind", gloss.alias("gloss"), score.alias("score")))


@query("qry16_grammar_list", "SELECT n_nationkey, n_name FROM nation ORDER BY n_regionkey, n_nationkey")
def grammar_list(spark, d):
    return table(spark, d, "nation").orderBy("n_regionkey", "n_nationkey").select("n_nationkey", "n_name")


@query("qry21_related", f"{W} SELECT pack, kind, array_to_string(list_sort(list(DISTINCT headword)), ',') AS words FROM entries WHERE source = 'Brand#1' GROUP BY pack, kind")
def related(spark, d):
    return entries(spark, d).filter("source = 'Brand#1'").groupBy("pack", "kind").agg(F.array_join(F.sort_array(F.collect_set("headword")), ",").alias("words"))


@query("qry23_longest_match", f"{W} SELECT q, arg_max(hw_norm, length(hw_norm)) AS hit FROM (VALUES ('coldgearbox'), ('hotring'), ('zzz'), ('redwidgets')) t(q) JOIN (SELECT DISTINCT hw_norm FROM entries) e ON starts_with(q, hw_norm) GROUP BY q")
def longest_match(spark, d):
    q = spark.createDataFrame([("coldgearbox",), ("hotring",), ("zzz",), ("redwidgets",)], "q string")
    spans = q.select("q", F.explode(F.expr("transform(sequence(1, length(q)), n -> left(q, n))")).alias("hw_norm"))
    hits = spans.join(entries(spark, d).select("hw_norm").distinct(), "hw_norm", "left_semi")
    return hits.groupBy("q").agg(F.max_by("hw_norm", F.length("hw_norm")).alias("hit"))


@query("qry25_overview", f"{W} SELECT level, count(DISTINCT hw_norm) AS words, count(*) AS entries FROM entries WHERE level IS NOT NULL GROUP BY level")
def overview(spark, d):
    return entries(spark, d).filter("level IS NOT NULL").groupBy("level").agg(F.countDistinct("hw_norm").alias("words"), F.count("*").alias("entries"))


@query("qry27_game_words", f"{W} SELECT headword, arg_min(id, CAST(coalesce(level, 9) AS BIGINT) * 1000000000 + rank * 1000 + id % 1000) AS id FROM entries WHERE kind = 'word' AND length(gloss) <= 60 GROUP BY headword")
def game_words(spark, d):
    """Of words that tie the least id, which is the first in the table."""
    key = F.coalesce("level", F.lit(9)).cast("long") * 1_000_000_000 + F.col("rank") * 1000 + F.col("id") % 1000
    key = F.when(key.isNotNull(), F.struct(key.alias("key"), "id"))
    return entries(spark, d).filter((F.col("kind") == "word") & (F.length("gloss") <= 60)).groupBy("headword").agg(F.min_by("id", key).alias("id"))


@query("qry28_chain", f"{W} SELECT DISTINCT headword FROM entries WHERE kind = 'word' AND left(hw_norm, 1) IN ('r', 'g') AND headword NOT IN ('red gear', 'green ring')")
def chain(spark, d):
    used = F.broadcast(spark.createDataFrame([("red gear",), ("green ring",)], "headword string"))  # what one game has used
    e = entries(spark, d).filter((F.col("kind") == "word") & F.left("hw_norm", F.lit(1)).isin("r", "g"))
    return e.join(used, "headword", "left_anti").select("headword").distinct()


@query("qry29_documents", "SELECT conv_id, count(*) AS turns, string_agg(text, chr(10) ORDER BY turn, text) AS body FROM conversations GROUP BY conv_id")
def documents(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("body"))

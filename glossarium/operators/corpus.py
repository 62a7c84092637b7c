"""The corpus study: components of variant links, counts of many patterns in one pass, cleaning of wikitext."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossarium.operators.longest import EVERY_PLACE, all_hits, chains, lower, matches
from glossarium.plans.registry import query
from glossarium.plans.tables import table
from glossarium.sources.shared import shared_dir


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): each node of the edges with the least node that links reach.

    Each round takes the least label among a node's neighbours, then that
    label's own label, so that labels travel twice as far each time. A round is
    checkpointed in the session's checkpoint folder, or where it has none in
    one of the warehouse; null ends link nothing.
    """
    context = edges.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(edges.sparkSession))
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).filter("node IS NOT NULL AND other IS NOT NULL")
    both = both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct().checkpoint()
    labels = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component"))
    labels = labels.checkpoint()
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("least"))
        jumped = labels.toDF("component", "further")
        step = labels.join(near, "node").withColumn("was", F.col("component")).withColumn("component", F.least("component", "least"))
        step = step.join(jumped, "component").select("node", F.least("component", "further").alias("component"), "was").checkpoint()
        labels = step.select("node", "component")
        if step.filter("component != was").isEmpty():
            return labels


@query("ag20_components", "WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey * 2 AS b FROM part WHERE p_size % 3 = 0 UNION SELECT p_partkey * 2, p_partkey FROM part WHERE p_size % 3 = 0), r AS (SELECT a AS node, a AS m FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.m) SELECT node, min(m) AS component FROM r GROUP BY node")
def components_query(spark, d):
    return connected_components(table(spark, d, "part").filter("p_size % 3 = 0").select("p_partkey", (F.col("p_partkey") * 2).alias("double")), "p_partkey", "double")


def pattern_counts(docs: DataFrame, patterns: DataFrame, by: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(by, pattern, n, n_docs): all hits of the patterns (key) in docs, overlapping ones too, by the longest-match join; ids are distinct."""
    own = docs.select(F.col(key).alias("id"), F.col(by).alias("by"), F.col(text).alias("text"))
    counted = all_hits(own, patterns).groupBy("id", "by", "key").agg(F.count("*").alias("k")).groupBy("by", "key").agg(F.sum("k").alias("n"), F.count("*").alias("n_docs"))
    return counted.select(F.col("by").alias(by), F.col("key").alias("pattern"), "n", "n_docs")


def study_counts(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(corpus, pid, whole, part) of texts (id, corpus, text) and patterns (pid, key, partial).

    whole counts the places where a key of a pattern stands, part those where
    only a partial key of it does: each place of a text counts once for a
    pattern. The longest key of a place tells all that stand there, so places
    are counted by it, and only those counts meet the patterns.
    """
    places = matches(texts, patterns, EVERY_PLACE).groupBy("corpus", "key").agg(F.count("*").alias("n"))
    begun = chains(patterns).select("key", F.explode("chain").alias("k")).select("key", F.left("key", F.col("k")).alias("begin"))
    shown = begun.join(patterns.withColumnRenamed("key", "begin"), "begin").groupBy("key", "pid").agg(F.max((~F.col("partial")).cast("int")).alias("whole"))
    x = places.join(shown, "key")
    return x.groupBy("corpus", "pid").agg(F.sum(F.col("n") * F.col("whole")).alias("whole"), F.sum(F.col("n") * (1 - F.col("whole"))).alias("part"))


def study_totals(texts: DataFrame) -> DataFrame:
    """(corpus, tokens, syllables, texts) of texts (corpus, text): tokens are runs without white space, syllables characters without it."""
    bare = F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    shown = F.length(F.replace(bare, F.lit(" "), F.lit("")))
    # between two tokens lies one space
    tokens = F.length(bare) - shown + (bare != "").cast("int")
    return texts.groupBy("corpus").agg(F.sum(tokens).alias("tokens"), F.sum(shown).alias("syllables"), F.count("*").alias("texts"))


def study(texts: DataFrame, patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both; neither runs the other."""
    return study_counts(texts, patterns), study_totals(texts)


#: Patterns for the query: some lie inside others, none overlaps itself.
PATTERNS = ["the", "then", "her", "en", "ation", "st"]


@query("ag21_pattern_counts", "SELECT lang, pattern, CAST(sum(k) AS BIGINT) AS n, count(*) AS n_docs FROM (SELECT lang, pattern, (length(text) - length(replace(text, pattern, ''))) // length(pattern) AS k FROM documents, (VALUES " + ", ".join(f"('{p}')" for p in PATTERNS) + ") p(pattern)) WHERE k > 0 GROUP BY lang, pattern")
def pattern_counts_query(spark, d):
    return pattern_counts(table(spark, d, "documents"), spark.createDataFrame([(p,) for p in PATTERNS], "key string"), "lang")


_STUDY = r"""WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z]+')) AS w FROM benchmark),
p AS MATERIALIZED (SELECT w AS pid, w AS key, length(w) AS n, false AS partial FROM w WHERE length(w) BETWEEN 5 AND 12 UNION ALL SELECT w, left(w, 4), 4, true FROM w WHERE length(w) BETWEEN 5 AND 12),
t AS (SELECT doc_id AS id, lang AS corpus, text FROM documents),
c AS (SELECT id, corpus, unnest(range(1, length(text) + 1)) AS k, text FROM t WHERE text IS NOT NULL),
s AS (SELECT id, corpus, k, substr(text, CAST(k AS INT), 12) AS win FROM c),
h AS (SELECT s.id, s.corpus, s.k, p.pid, max(CASE WHEN partial THEN 0 ELSE 1 END) AS whole FROM (SELECT s.*, l.n, left(win, l.n) AS key FROM s, (SELECT DISTINCT n FROM p) l) s JOIN p ON p.key = s.key AND p.n = s.n GROUP BY ALL)"""


@query("ag21_study", f"{_STUDY} SELECT corpus, pid, CAST(sum(whole) AS BIGINT) AS whole, CAST(sum(1 - whole) AS BIGINT) AS part FROM h GROUP BY corpus, pid")
def study_query(spark, d):
    """Words of the benchmark's items as patterns, their first four letters as partial ones, over all documents by language."""
    return study_counts(*_study(spark, d))


@query("ag21_totals", r"WITH t AS (SELECT lang, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents) SELECT lang AS corpus, CAST(sum(len(list_filter(string_split(t, ' '), lambda x: x <> ''))) AS BIGINT) AS tokens, CAST(sum(length(replace(t, ' ', ''))) AS BIGINT) AS syllables, count(*) AS texts FROM t GROUP BY lang")
def totals_query(spark, d):
    return study_totals(_study(spark, d)[0])


def _study(spark, d) -> tuple[DataFrame, DataFrame]:
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("corpus"), "text")
    words = table(spark, d, "benchmark").select(F.explode(F.split(lower(F.col("text")), "[^a-z]+")).alias("pid")).distinct().filter(F.length("pid").between(5, 12))
    return texts, words.select("pid", F.col("pid").alias("key"), F.lit(False).alias("partial")).unionByName(words.select("pid", F.left("pid", F.lit(4)).alias("key"), F.lit(True).alias("partial")))



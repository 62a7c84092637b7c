"""String functions and derived columns, all in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossarium.plans.registry import query
from glossarium.plans.tables import ENTRIES, entries, gloss_items, table

W = f"WITH {ENTRIES}"

#: Words of English glosses that say little about what a word means.
STOP_WORDS = (
    "a an the of to and or in on for with be by as at one s sth sb someone something somebody it its is are not no from into up out off about that this which who what etc e g i ie eg very much more most other "
    "get make do have take give go come put set let keep become being use used thing person people man state act action way kind sort type part form place time matter fact having making doing oneself certain "
    "general good bad great small large big new old"
).split()


def truncate(c: Column, n: int) -> Column:
    """At most n characters, the last an ellipsis where something was cut."""
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.left(c, F.lit(n - 1))), F.lit("…"))).otherwise(c)


def content_words(c: Column) -> Column:
    """Lower-case words of two letters or more without stop words and without a plural s, once each."""
    telling = lambda w: ~w.isin(STOP_WORDS)
    words = F.filter(F.split(F.lower(c), "[^a-z]+"), lambda w: (F.length(w) >= 2) & telling(w))
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.when((F.length(w) > 3) & w.endswith("s"), F.regexp_replace(w, "s$", "")).otherwise(w)), telling))


@query("str01_hw_norm", f"{W} SELECT id, hw_norm FROM entries")
def hw_norm_query(spark, d):
    return entries(spark, d).select("id", "hw_norm")


@query("str03_unescape", "SELECT page_id, replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&') AS text FROM pages")
def unescape(spark, d):
    c = F.regexp_replace("html", "<[^>]*>", "")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return table(spark, d, "pages").select("page_id", c.alias("text"))


@query("str04_truncate", "SELECT doc_id, CASE WHEN length(text) > 40 THEN rtrim(left(text, 39)) || '…' ELSE text END AS short FROM documents")
def truncate_query(spark, d):
    return table(spark, d, "documents").select("doc_id", truncate(F.col("text"), 40).alias("short"))


@query("str05_levenshtein", "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS dist FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def levenshtein(spark, d):
    n = table(spark, d, "nation")
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, F.expr("a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"), F.levenshtein("a.n_name", "b.n_name").cast("long").alias("dist"))


@query("str10_split_homonym", "SELECT p_partkey, regexp_extract(p_brand, '^(.*?)([0-9]{1,3})$', 1) AS base, CAST(regexp_extract(p_brand, '^(.*?)([0-9]{1,3})$', 2) AS INT) AS homonym FROM part")
def split_homonym(spark, d):
    part = lambda k: F.regexp_extract("p_brand", "^(.*?)([0-9]{1,3})$", k)
    return table(spark, d, "part").select("p_partkey", part(1).alias("base"), part(2).cast("int").alias("homonym"))


@query("str13_norm_term", "SELECT p_partkey, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS term FROM part")
def norm_term(spark, d):
    return table(spark, d, "part").select("p_partkey", F.trim(F.regexp_replace(F.lower("p_name"), "\\s+", " ")).alias("term"))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query("str14_content_words", f"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN length(w) > 3 AND ends_with(w, 's') THEN left(w, length(w) - 1) ELSE w END for w in regexp_split_to_array(lower(text), '[^a-z]+') if length(w) >= 2 AND w NOT IN ({_STOP})], lambda w: w NOT IN ({_STOP})))), ' ') AS words FROM benchmark")
def content_words_query(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.sort_array(content_words(F.col("text"))), " ").alias("words"))


@query("str19_def_key", "SELECT item_id, regexp_replace(text, '\\s+', '', 'g') AS key FROM benchmark")
def def_key(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.regexp_replace("text", "\\s+", "").alias("key"))


@query("prj05_quality", f"{W} SELECT id, CASE source WHEN 'Brand#1' THEN 0 WHEN 'Brand#2' THEN 1 ELSE 2 END AS quality FROM entries")
def quality_query(spark, d):
    return entries(spark, d).select("id", F.when(F.col("source") == "Brand#1", 0).when(F.col("source") == "Brand#2", 1).otherwise(2).alias("quality"))


@query("prj06_rank", f"{W} SELECT id, coalesce(least(rank, 100000), 40000) * 8 + coalesce(level, 7) + CASE kind WHEN 'phrase' THEN 20000 ELSE 0 END AS rank FROM entries")
def rank(spark, d):
    r = F.coalesce(F.least("rank", F.lit(100000)), F.lit(40000)) * 8 + F.coalesce("level", F.lit(7)) + F.when(F.col("kind") == "phrase", 20000).otherwise(0)
    return entries(spark, d).select("id", r.alias("rank"))


@query("prj08_category", "SELECT p_partkey, CASE WHEN contains(p_name, 'widget') THEN 'tool' WHEN contains(p_name, 'gear') THEN 'part' ELSE 'other' END AS category FROM part")
def category(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", F.when(n.contains("widget"), "tool").when(n.contains("gear"), "part").otherwise("other").alias("category"))


@query("prj10_vocab_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'unknown' END AS state FROM orders")
def vocab_map(spark, d):
    names = F.create_map(F.lit("F"), F.lit("finished"), F.lit("O"), F.lit("open"))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.try_element_at(names, F.col("o_orderstatus")), F.lit("unknown")).alias("state"))


@query("prj17_topic_split", "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS top, split_part(o_orderpriority, '-', 2) AS sub FROM orders")
def topic_split(spark, d):
    part = lambda k: F.split_part("o_orderpriority", F.lit("-"), F.lit(k))
    return table(spark, d, "orders").select("o_orderkey", part(1).alias("top"), part(2).alias("sub"))

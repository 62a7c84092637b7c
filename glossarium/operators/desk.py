"""What the dictionary's screens ask for: stages of results, prefixes, pages, lists, lessons, packs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossarium.functions.values import day_pick, mix_sql
from glossarium.operators.numbering import numbered
from glossarium.plans.registry import query
from glossarium.plans.tables import ENTRIES, FORMS, TERMS, entries, forms, gloss_terms, table

W = f"WITH {ENTRIES}"


def staged(parts: list[tuple[str, DataFrame]], limit: int) -> DataFrame:
    """Rows (pack, id, rank) of several stages; each (pack, id) stays in its first stage; by stage, rank, pack, id."""
    both = reduce(DataFrame.unionByName, (p.select("pack", "id", "rank", F.lit(k).alias("stage"), F.lit(via).alias("via")) for k, (via, p) in enumerate(parts)))
    first = both.groupBy("pack", "id").agg(F.min(F.struct("stage", "rank", "via")).alias("b")).select("pack", "id", "b.*")
    return first.orderBy("stage", "rank", "pack", "id").limit(limit)


def staged_sql(parts: list[tuple[str, str]], limit: int) -> str:
    union = " UNION ALL ".join(f"SELECT pack, id, rank, {k} AS stage, '{via}' AS via FROM ({q})" for k, (via, q) in enumerate(parts))
    return f"SELECT pack, id, rank, stage, via FROM (SELECT *, row_number() OVER (PARTITION BY pack, id ORDER BY stage, rank) AS n FROM ({union})) WHERE n = 1 ORDER BY stage, rank, pack, id LIMIT {limit}"


_BY_FORM = "SELECT e.* FROM entries e JOIN forms f ON f.entry_id = e.id WHERE f.form = 'cold'"


def of_form(spark, d, form: str) -> DataFrame:
    return forms(spark, d).filter(F.col("form") == form).join(entries(spark, d), F.col("entry_id") == F.col("id"))


@query("srt03_stage_concat", f"{W}, {FORMS} " + staged_sql([("exact", "SELECT * FROM entries WHERE hw_norm = 'coldwidget'"), ("form", _BY_FORM), ("prefix", "SELECT * FROM entries WHERE starts_with(hw_norm, 'co')")], 60))
def stage_concat(spark, d):
    e = entries(spark, d)
    return staged([("exact", e.filter("hw_norm = 'coldwidget'")), ("form", of_form(spark, d, "cold")), ("prefix", e.filter(F.col("hw_norm").startswith("co")))], 60)


@query("qry03_strict", f"{W}, {FORMS} " + staged_sql([("exact", "SELECT * FROM entries WHERE hw_norm = 'coldgear'"), ("form", _BY_FORM)], 1000))
def strict(spark, d):
    return staged([("exact", entries(spark, d).filter("hw_norm = 'coldgear'")), ("form", of_form(spark, d, "cold"))], 1000)


@query("qry10_contained", f"{W} " + staged_sql([("exact", "SELECT * FROM entries WHERE hw_norm = 'gear'"), ("prefix", "SELECT * FROM entries WHERE starts_with(hw_norm, 'ge')"), ("contained", "SELECT * FROM entries WHERE contains(hw_norm, 'ge')")], 50))
def contained(spark, d):
    e = entries(spark, d)
    return staged([("exact", e.filter("hw_norm = 'gear'")), ("prefix", e.filter(F.col("hw_norm").startswith("ge"))), ("contained", e.filter(F.col("hw_norm").contains("ge")))], 50)


@query("qry02_initials", f"{W} SELECT id, rank, 'prefix' AS via FROM entries WHERE array_to_string([left(x, 1) for x in string_split(headword, ' ')], '') = 'cw' ORDER BY rank, id LIMIT 50")
def by_initials(spark, d):
    cho = F.array_join(F.transform(F.split("headword", " "), lambda x: F.left(x, F.lit(1))), "")
    return entries(spark, d).filter(cho == "cw").select("id", "rank", F.lit("prefix").alias("via")).orderBy("rank", "id").limit(50)


@query("qry11_longest_prefix", f"{W}, q AS (SELECT p_partkey AS q_id, translate(lower(p_name), ' -^', '') || 'box' AS q FROM part) SELECT q_id, max(k) AS known FROM (SELECT q_id, q, unnest(range(1, length(q))) AS k FROM q) s WHERE EXISTS (SELECT 1 FROM entries e WHERE e.hw_norm = left(s.q, s.k)) GROUP BY q_id")
def longest_prefix(spark, d):
    """The longest proper prefix that is a headword, for a table of queries: prefixes meet headwords by equality."""
    e = entries(spark, d)
    q = e.select(F.col("id").alias("q_id"), F.concat("hw_norm", F.lit("box")).alias("q"))
    cut = q.select("q_id", "q", F.explode(F.sequence(F.lit(1), F.length("q") - 1)).alias("k")).select("q_id", "k", F.left("q", F.col("k")).alias("hw_norm"))
    return cut.join(e.select("hw_norm").distinct(), "hw_norm", "left_semi").groupBy("q_id").agg(F.max("k").cast("long").alias("known"))


@query("qry12_words_with", f"{W} SELECT rank, pack, id FROM entries WHERE instr(headword, 'g') > 0 ORDER BY rank, pack, id LIMIT 20 OFFSET 10")
def words_with(spark, d):
    return entries(spark, d).filter(F.instr("headword", "g") > 0).select("rank", "pack", "id").orderBy("rank", "pack", "id").offset(10).limit(20)


@query("fn04_splitmix", mix_sql("(SELECT l_orderkey * 10 + l_linenumber AS day FROM lineitem)", "day", "1009"))
def splitmix(spark, d):
    days = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("day"))
    return days.select("day", day_pick(F.col("day"), F.lit(1009)).alias("pick"))


_POOL = "pool AS (SELECT id, hw_norm, row_number() OVER (ORDER BY id) - 1 AS n FROM entries WHERE level = 3 AND kind = 'word')"


@query("qry17_word_of_day", f"{W}, {_POOL}, days AS ({mix_sql('(SELECT range AS day, (SELECT count(*) FROM pool) AS size FROM range(60))', 'day', 'size')}) SELECT day, id, hw_norm FROM days JOIN pool ON n = pick")
def word_of_day(spark, d):
    """Each day's word: a seeded cycle over the numbered pool."""
    pool = numbered(entries(spark, d).filter("level = 3 AND kind = 'word'").select("id", "hw_norm"), ["id"], name="pick")
    days = spark.range(0, 60).select(F.col("id").alias("day")).crossJoin(pool.agg(F.count("*").alias("size")))
    return days.filter("size > 0").select("day", day_pick(F.col("day"), F.col("size")).alias("pick")).join(pool, "pick").select("day", "id", "hw_norm")


@query("qry31_text_words", f"{W}, {FORMS}, w AS (SELECT DISTINCT item_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS form FROM benchmark) SELECT w.item_id, w.form FROM w WHERE length(w.form) >= 2 AND w.form IN (SELECT c_mktsegment FROM customer UNION SELECT 'the' UNION SELECT 'of')")
def text_words(spark, d):
    known = table(spark, d, "customer").select(F.col("c_mktsegment").alias("form")).union(spark.createDataFrame([("the",), ("of",)], "form string")).distinct()
    words = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("form")).filter("length(form) >= 2")
    return words.join(known, "form", "left_semi").select("item_id", "form")


@query("srt08_grammar_order", f"{W} SELECT id, row_number() OVER (PARTITION BY kind ORDER BY source, right(hw_norm, 1), coalesce(level, 4), rank, id) AS n FROM entries")
def grammar_order(spark, d):
    e = entries(spark, d).select("id", "kind", "source", F.right("hw_norm", F.lit(1)).alias("last"), F.coalesce("level", F.lit(4)).alias("level"), "rank")
    return numbered(e, ["source", "last", "level", "rank", "id"], by=["kind"]).select("id", (F.col("n") + 1).alias("n"))


@query("srt18_collated", f"{W} SELECT headword, min(id) AS id FROM entries GROUP BY headword ORDER BY headword")
def collated(spark, d):
    """By Korean collation, in which ASCII words keep their order."""
    return entries(spark, d).groupBy("headword").agg(F.min("id").alias("id")).orderBy(F.collate("headword", "ko"))


@query("prj01_narrow", f"{W} SELECT id, pack, headword, source, kind, level, rank, 'exact' AS via FROM entries WHERE kind = 'word' ORDER BY rank, id LIMIT 50")
def narrow(spark, d):
    return entries(spark, d).filter("kind = 'word'").select("id", "pack", "headword", "source", "kind", "level", "rank", F.lit("exact").alias("via")).orderBy("rank", "id").limit(50)


@query("prj09_priority", f"{W} SELECT id, min(k.pos) AS priority FROM entries JOIN (VALUES ('cold', 0), ('hot', 1), ('gear', 2)) k(w, pos) ON contains(headword, k.w) GROUP BY id")
def priority(spark, d):
    """The place of the first name of a hand list that a headword holds."""
    at = [F.when(F.col("headword").contains(w), k) for k, w in enumerate(("cold", "hot", "gear"))]
    return entries(spark, d).select("id", F.coalesce(*at).alias("priority")).filter("priority IS NOT NULL")


@query("prj14_provenance", "SELECT doc_id, '{\"source\":\"' || source || '\",\"lang\":\"' || lang || '\"}' AS meta FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def provenance(spark, d):
    return table(spark, d, "documents").filter("source IS NOT NULL AND lang IS NOT NULL").select("doc_id", F.to_json(F.struct("source", "lang")).alias("meta"))


@query("jn24_pattern_linkage", f"{W}, {FORMS}, k AS (SELECT id AS want, unnest([hw_norm, string_split(headword, ' ')[1]]) AS key, unnest([0, 1]) AS p FROM entries WHERE kind = 'idiom'), t AS (SELECT hw_norm AS key, min(id) AS id FROM entries WHERE kind = 'word' GROUP BY hw_norm UNION SELECT form, min(entry_id) FROM forms GROUP BY form) SELECT want, arg_min(t.id, (p, t.id)) AS id FROM k JOIN t ON t.key = k.key GROUP BY want")
def pattern_linkage(spark, d):
    """Each pattern's keys in order of preference; the first key that is known gives the entry."""
    e = entries(spark, d)
    keys = F.array(F.col("hw_norm"), F.get(F.split("headword", " "), F.lit(0)))
    k = e.filter("kind = 'idiom'").select(F.col("id").alias("want"), F.posexplode(keys).alias("p", "key"))
    t = e.filter("kind = 'word'").groupBy(F.col("hw_norm").alias("key")).agg(F.min("id").alias("id"))
    t = t.unionByName(forms(spark, d).groupBy(F.col("form").alias("key")).agg(F.min("entry_id").alias("id")))
    return k.join(t, "key").groupBy("want").agg(F.min(F.struct("p", "id")).alias("b")).select("want", F.col("b.id").alias("id"))


@query("jn30_evidence", f"{W}, {TERMS}, s AS (SELECT g.entry_id, f.pack AS side, sum(f.c) AS n FROM gloss_terms g JOIN (SELECT term, pack, count(*) AS c FROM gloss_terms WHERE tier = 0 GROUP BY ALL) f ON f.term = g.term AND f.pack <> g.pack GROUP BY ALL), r AS (SELECT entry_id, n, row_number() OVER (PARTITION BY entry_id ORDER BY n DESC, side) AS k, side FROM s) SELECT a.entry_id, a.side FROM r a LEFT JOIN r b ON b.entry_id = a.entry_id AND b.k = 2 WHERE a.k = 1 AND (b.n IS NULL OR a.n >= 2 * b.n)")
def evidence(spark, d):
    """The candidate whose entries share gloss terms with a row most often, if at least twice as often as the next."""
    g = gloss_terms(spark, d)
    f = g.filter("tier = 0").groupBy("term", F.col("pack").alias("side")).agg(F.count("*").alias("c"))
    s = g.join(f, "term").filter("side <> pack").groupBy("entry_id", "side").agg(F.sum("c").alias("n"))
    w = Window.partitionBy("entry_id").orderBy(F.desc("n"), "side")
    r = s.withColumn("k", F.row_number().over(w)).withColumn("next", F.lead("n").over(w)).filter("k = 1")
    return r.filter("next IS NULL OR n >= 2 * next").select("entry_id", "side")


@query("fn09_json_round", "SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS again FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_round(spark, d):
    parsed = F.from_json("props", "k long")
    return table(spark, d, "events").select("event_id", parsed.alias("p")).filter("p.k IS NOT NULL").select("event_id", F.to_json("p").alias("again"))


@query("fn13_group_concat", f"{W} SELECT pack, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, CAST(max(length(headword)) AS INT) AS longest FROM entries GROUP BY pack")
def group_concat(spark, d):
    return entries(spark, d).groupBy("pack").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"), F.max(F.length("headword")).alias("longest"))


@query("utl07_page_ranges", f"{W} SELECT id, unnest(range(level, level + least(level, 21) + 1)) AS page FROM entries WHERE level IS NOT NULL")
def page_ranges(spark, d):
    """A transclusion of pages, 21 more than the first at most, as one row for each page."""
    pages = F.sequence(F.col("level").cast("long"), F.col("level").cast("long") + F.least("level", F.lit(21)))
    return entries(spark, d).filter("level IS NOT NULL").select("id", F.explode(pages).alias("page"))


@query("utl12_list_state", "SELECT user_id, event_type AS item FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND value >= 50")
def list_state(spark, d):
    """Lists as a log of changes: an item is in a list if its last change added it."""
    last = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("item")).agg(F.max(F.struct("ts", "event_id", "value")).alias("b"))
    return last.filter("b.value >= 50").select("user_id", "item")


@query("utl16_hide_shown", f"{W}, {FORMS} SELECT DISTINCT e.id FROM entries e JOIN forms f ON f.entry_id = e.id WHERE f.form = 'cold' AND e.hw_norm NOT IN (SELECT hw_norm FROM entries WHERE pack = 'ECONOMY' AND level = 1)")
def hide_shown(spark, d):
    shown = entries(spark, d).filter("pack = 'ECONOMY' AND level = 1").select("hw_norm").distinct()
    return of_form(spark, d, "cold").join(shown, "hw_norm", "left_anti").select("id").distinct()


@query("utl18_collapse", f"{W}, n AS (SELECT *, row_number() OVER (PARTITION BY pack, kind ORDER BY rank, id) AS k, count(*) OVER (PARTITION BY pack, kind) AS size FROM entries) SELECT pack, kind, id FROM n WHERE size <= 7 OR k <= 5")
def collapse(spark, d):
    """Groups show five rows, or all of them if only two more would be hidden."""
    by = Window.partitionBy("pack", "kind")
    n = entries(spark, d).select("pack", "kind", "id", F.row_number().over(by.orderBy("rank", "id")).alias("k"), F.count("*").over(by).alias("size"))
    return n.filter("size <= 7 OR k <= 5").select("pack", "kind", "id")


@query("utl20_active_packs", f"{W} SELECT pack, CASE pack WHEN 'ECONOMY' THEN 0 ELSE row_number() OVER (PARTITION BY pack = 'ECONOMY' ORDER BY pack) END AS place FROM (SELECT DISTINCT pack FROM entries)")
def active_packs(spark, d):
    core = F.col("pack") == "ECONOMY"
    n = F.row_number().over(Window.partitionBy(core).orderBy("pack"))
    return entries(spark, d).select("pack").distinct().select("pack", F.when(core, 0).otherwise(n).alias("place"))


@query("utl21_batches", f"{W} SELECT id, (row_number() OVER (PARTITION BY pack ORDER BY id) - 1) // 20 AS batch FROM entries")
def batches(spark, d):
    return numbered(entries(spark, d).select("id", "pack"), ["id"], by=["pack"]).select("id", F.floor(F.col("n") / 20).alias("batch"))

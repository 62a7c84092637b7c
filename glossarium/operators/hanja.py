"""Hanja for entries that a dictionary records without them.

Dictionaries that do record hanja give, for a spelling, its readings in hanja,
and whether a native word is spelt so. What a hanja word means is what the
glosses of words that begin with it say. A row's English decides between the
readings by the words that it shares with each: the best must have at least
twice the next one's. A phrase is read part by part, and one part that is not
decided, or a compound whose beginning is read otherwise, leaves the row as it
is.

Every step is a join by spelling or by hanja and an aggregate of bounded lists:
readings of a spelling, forty glosses of a hanja in a pack, parts of a phrase.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from glossarium.functions.conjugation import candidates
from glossarium.functions.writing import LETTERS, SYLLABLES_OF, hangul_of
from glossarium.operators.capped import first_of
from glossarium.plans.registry import query
from glossarium.plans.tables import hw_norm, table
from glossarium.sources.shared import cut

#: Dictionaries that record hanja; glosses read of a hanja word and pack; dictionary forms that make a spelling doubtful.
RECORDING = ("krdict", "stdict", "opendict")
GLOSSES, SUSPECTS = 40, 6
#: English words that say nothing about a meaning.
STOP = (
    "a an the of to and or in on for with be by as at one s sth sb someone something somebody it its is are not no from into up out off about "
    "that this which who what etc e g i ie eg very much more most other get make do have take give go come put set let keep become being use used "
    "thing person people man state act action way kind sort type part form place time matter fact having making doing one's oneself certain general good bad great small large big new old"
).split()
_HAN = "[㐀-䶿一-鿿豈-﫿]"
#: Endings that make a verb stand before a noun.
_BEFORE_NOUNS = r"(^|, )-(ㄴ|은|는|을|ㄹ|던)$"


def english_words(gloss: Column) -> Column:
    """The distinct content words of a gloss, plurals without their s; none for a gloss in Korean."""
    stop = F.array(*map(F.lit, STOP))
    words = F.filter(F.split(F.lower(F.coalesce(gloss, F.lit(""))), "[^a-z]+"), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))
    single = F.transform(words, lambda w: F.when(w.endswith("s") & (F.length(w) > 3), F.left(w, F.length(w) - 1)).otherwise(w))
    return F.when(gloss.rlike("[가-힣]"), F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(single, lambda w: ~F.array_contains(stop, w))))


@F.pandas_udf(ArrayType(StructType().add("lemma", "string").add("verb", "boolean")))
def doubts(spellings: pd.Series) -> pd.Series:
    """The words of which a spelling may be a form that stands before a noun, or a noun with a particle."""

    def one(word: str) -> list[dict]:
        found = [(lemma, rule) for lemma, rule in candidates(word)[:SUSPECTS] if lemma != word and not word.endswith("다")]
        verbs = [{"lemma": k, "verb": True} for k, rule in found if k.endswith("다") and re.search(_BEFORE_NOUNS, rule)]
        return verbs + [{"lemma": k, "verb": False} for k, _ in found if not k.endswith("다") and word.startswith(k)]

    return spellings.map(one)


def _readings(asked: DataFrame, cands: DataFrame, native: DataFrame, meaning: DataFrame) -> DataFrame:
    """(row, p, alone, plain) for asked (row, p, words): alone is the only reading where nothing speaks against it, plain what the words decide: (kind, shown, bare, n, known)."""
    scored = asked.join(cands, "p").join(meaning, "bare", "left")
    n = F.coalesce(F.size(F.array_intersect("words", "means")), F.lit(0))
    each = scored.select("row", "p", "words", F.struct(F.when(n < 0, 0).otherwise(n).alias("n"), F.col("bare"), F.col("shown"), F.coalesce(F.greatest(F.size("means"), F.lit(0)), F.lit(0)).alias("known")).alias("c"))
    g = each.groupBy("row", "p").agg(F.first("words").alias("words"), F.sort_array(F.collect_list("c"), asc=False).alias("cs")).join(native, "p", "left")
    own = F.when(F.col("nat").isNotNull(), F.size(F.array_intersect("words", "nat")))
    first, second = F.get("cs", F.lit(0)), F.coalesce(F.get("cs", F.lit(1))["n"], F.lit(0))
    g = g.withColumn("own", own).withColumn("best", F.greatest(first["n"], F.coalesce("own", F.lit(0))))
    rest = F.when(F.coalesce(F.col("own") > first["n"], F.lit(False)), first["n"]).otherwise(F.greatest(second, F.coalesce("own", F.lit(0))))
    kind = F.when((F.col("best") == 0) | (F.col("best") < 2 * rest), "open").when(F.coalesce(F.col("own") > first["n"], F.lit(False)), "bare").otherwise("hanja")
    plain = F.struct(kind.alias("kind"), first["shown"].alias("shown"), first["bare"].alias("bare"), first["n"].alias("n"), first["known"].alias("known"))
    alone = (F.size("cs") == 1) & F.col("nat").isNull()
    return g.select("row", "p", alone.alias("alone"), plain.alias("plain"))


def infer_hanja(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """(row, hanja) of the rows (row, headword, gloss, source, hanja) without hanja that entries (hw_norm, hanja, gloss, source, pack, rank) decide."""
    wanting = rows.filter((F.coalesce("hanja", F.lit("")) == "") & ~F.coalesce(F.col("source").isin(*RECORDING), F.lit(False))).select("row", "headword", hw_norm(F.col("headword")).alias("whole"), english_words(F.col("gloss")).alias("words"))
    e = entries.withColumn("bare", F.regexp_replace(F.coalesce("hanja", F.lit("")), f"[^{_HAN[1:]}", ""))
    known = e.select(F.col("hw_norm").alias("p")).distinct()
    cands = cut(e.filter("bare <> ''").groupBy(F.col("hw_norm").alias("p"), "bare").agg(F.min(F.struct("rank", "hanja")).alias("b")).select("p", "bare", F.col("b.hanja").alias("shown")), "readings")
    native = e.filter((F.col("bare") == "") & F.col("source").isin(*RECORDING)).select(F.col("hw_norm").alias("p"), F.explode_outer(english_words(F.col("gloss"))).alias("w")).groupBy("p").agg(F.collect_set("w").alias("nat"))
    spelt = cands.select("p").distinct()

    # a phrase that is spelt in hanja as a whole, else its parts
    entire = wanting.join(spelt.withColumnRenamed("p", "whole"), "whole", "left_semi").select("row", "words", F.array(F.struct(F.col("whole").alias("p"), F.col("headword").alias("said"))).alias("ps"), F.lit(True).alias("one"))
    words = F.filter(F.split("headword", r"\s+"), lambda w: w != "")
    split = wanting.join(spelt.withColumnRenamed("p", "whole"), "whole", "left_anti").select("row", "words", F.transform(words, lambda w: F.struct(hw_norm(w).alias("p"), w.alias("said"))).alias("ps"), (F.size(words) == 1).alias("one"))
    entire = entire.join(wanting.select("row", (~F.trim("headword").rlike(r"\s")).alias("single")), "row").select("row", "words", "ps", F.col("single").alias("one"))
    each = entire.unionByName(split).select("row", "words", "one", F.size("ps").alias("parts"), F.posexplode("ps").alias("k", "x")).select("row", "words", "one", "parts", "k", "x.p", "x.said")
    each = each.join(known.withColumn("known", F.lit(True)), "p", "left").join(spelt.withColumn("spelt", F.lit(True)), "p", "left")
    whole = each.groupBy("row").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("a"), F.bool_or(F.coalesce("spelt", F.lit(False))).alias("b")).filter("a AND b").select("row")
    each = cut(each.join(whole, "row", "left_semi"), "parts")

    heads = each.filter("spelt AND length(p) >= 3").select("row", F.left("p", F.lit(2)).alias("p"), "words")
    asked = each.filter("spelt").select("row", "p", "words").unionByName(heads).dropDuplicates(["row", "p"])
    wanted = asked.join(cands, "p").select("bare").distinct()
    begun = e.filter("bare <> '' AND gloss IS NOT NULL").select("hanja", "gloss", "pack", "rank", F.explode(F.sequence(F.lit(1), F.length("hanja"))).alias("k"))
    begun = begun.select(F.left("hanja", F.col("k")).alias("bare"), "hanja", "gloss", "pack", "rank").join(wanted, "bare", "left_semi")
    used = first_of(begun, ["bare", "pack"], ["rank", "hanja", "gloss"], GLOSSES)
    meaning = used.select("bare", F.explode_outer(english_words(F.col("gloss"))).alias("w")).groupBy("bare").agg(F.collect_set("w").alias("means"))
    read = cut(_readings(asked, cands, native, meaning), "read")

    # a lone reading needs no evidence where the spelling can be nothing else
    full = cands.groupBy("p").agg(F.bool_and(F.length("bare") == F.length("p")).alias("full"))
    suspects = spelt.filter("length(p) >= 3").select("p", F.explode(doubts(F.col("p"))).alias("d")).select("p", "d.lemma", "d.verb")
    suspects = suspects.join(known.withColumnRenamed("p", "lemma"), "lemma", "left_semi").groupBy("p").agg(F.bool_or("verb").alias("verb"), F.bool_or(~F.col("verb")).alias("noun"))
    safe = full.join(suspects, "p", "left").select("p", "full", F.coalesce("verb", F.lit(False)).alias("verb"), F.coalesce("noun", F.lit(False)).alias("noun"))

    x = each.join(read.select("row", "p", "alone", "plain"), ["row", "p"], "left").join(safe, "p", "left")
    begin = read.select("row", F.col("p").alias("head"), F.col("plain").alias("begin"))
    x = x.withColumn("head", F.when(F.length("p") >= 3, F.left("p", F.lit(2)))).join(begin, ["row", "head"], "left")
    sure = F.col("alone") & (F.length("p") >= 3) & ~F.col("verb") & ((F.col("one") & F.col("full")) | ~F.col("noun"))
    kind = F.when(F.col("spelt").isNull(), "bare").when(sure, "hanja").otherwise(F.col("plain.kind"))
    elsewhere = (F.col("parts") > 1) & (F.col("plain.n") == 0) & (F.col("plain.known") > 0)
    implied = (F.length("plain.bare") == F.length("p")) & F.col("begin").isNotNull()
    apart = implied & F.when(F.col("begin.kind") == "hanja", F.col("begin.bare") != F.left("plain.bare", F.lit(2))).otherwise(F.col("begin.kind") == "bare")
    x = x.withColumn("kind", kind).withColumn("fails", (F.col("kind") == "open") | ((F.col("kind") == "hanja") & (F.coalesce(elsewhere, F.lit(False)) | F.coalesce(apart, F.lit(False)))))
    shown = F.when(F.col("kind") == "hanja", F.col("plain.shown")).otherwise(F.col("said"))
    done = x.groupBy("row").agg(F.bool_or("fails").alias("fails"), F.bool_or(F.col("kind") == "hanja").alias("filled"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", shown.alias("s")))), lambda v: v["s"]), " ").alias("hanja"))
    return done.filter("filled AND NOT fails").select("row", "hanja")


# Query: names of parts in Hangul; two sets of characters stand for the letters, so that a spelling has up to two readings.

_HANJA = ["力木水火土金人口山川日月目耳手足心雨田石竹米糸虫貝車", "馬鳥魚羊犬牛玉王立門音風食首香龍亀歯鼻黒白赤青黄文方"]


def _part_entries(spark, d) -> DataFrame:
    p = table(spark, d, "part").filter("p_partkey % 3 > 0")
    name = F.regexp_replace(F.lower("p_name"), " ", "")
    han = lambda letters: F.translate(name, LETTERS, letters)
    shown = F.when(F.col("p_size") % 5 == 0, "").when(F.col("p_size") % 5 < 3, han(_HANJA[0])).otherwise(han(_HANJA[1]))
    source = F.when(F.col("p_partkey") % 3 == 1, "krdict").otherwise("wikt")
    return p.select(hangul_of(name).alias("hw_norm"), shown.alias("hanja"), F.concat(F.lower("p_type"), F.lit(" of "), F.lower("p_brand"), F.lit(" goods")).alias("gloss"), source.alias("source"), source.alias("pack"), F.col("p_partkey").alias("rank"))


@query(
    "qry09_infer_hanja",
    f"""WITH n AS (SELECT *, replace(lower(p_name), ' ', '') AS name FROM part),
e AS (SELECT p_partkey AS rank, translate(name, '{LETTERS}', '{SYLLABLES_OF}') AS p, CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 5 < 3 THEN translate(name, '{LETTERS}', '{_HANJA[0]}') ELSE translate(name, '{LETTERS}', '{_HANJA[1]}') END AS han,
  list_distinct([w for w in regexp_split_to_array(lower(p_type) || ' of ' || lower(p_brand) || ' goods', '[^a-z]+') if length(w) > 1 and w NOT IN ('of', 'small', 'large', 'other')]) AS ws, CASE p_partkey % 3 WHEN 1 THEN 'krdict' ELSE 'wikt' END AS source FROM n WHERE p_partkey % 3 > 0),
w AS (SELECT rank, p, han, source, list_distinct([CASE WHEN ends_with(x, 's') AND length(x) > 3 THEN left(x, length(x) - 1) ELSE x END for x in ws]) AS ws FROM e),
c AS (SELECT DISTINCT p, han FROM w WHERE han <> ''), nat AS (SELECT p, list_distinct(flatten(list(ws))) AS ws FROM w WHERE han = '' AND source = 'krdict' GROUP BY p),
wanted AS (SELECT DISTINCT han FROM c),
u AS (SELECT x.han, w.source, w.ws, row_number() OVER (PARTITION BY x.han, w.source ORDER BY w.rank) AS k FROM wanted x JOIN w ON starts_with(w.han, x.han)),
m AS (SELECT han, list_distinct(flatten(list(ws))) AS ws FROM u WHERE k <= 40 GROUP BY han),
r AS (SELECT p_partkey AS row, translate(name, '{LETTERS}', '{SYLLABLES_OF}') AS p, list_distinct([CASE WHEN ends_with(x, 's') AND length(x) > 3 THEN left(x, length(x) - 1) ELSE x END for x in regexp_split_to_array(CASE WHEN p_size % 2 = 0 THEN lower(p_type) ELSE lower(p_brand) || ' piece' END, '[^a-z]+') if length(x) > 1 and x NOT IN ('of', 'small', 'large', 'other')]) AS ws FROM n WHERE p_partkey % 3 = 0),
s AS (SELECT r.row, r.p, c.han, coalesce(len(list_intersect(r.ws, m.ws)), 0) AS n FROM r JOIN c USING (p) LEFT JOIN m USING (han)),
g AS (SELECT s.row, s.p, count(*) AS cs, max(n) AS top, arg_max(han, (n, han)) AS han, coalesce(list_sort(list(n), 'DESC')[2], 0) AS second FROM s GROUP BY s.row, s.p),
b AS (SELECT g.*, r.ws, CASE WHEN nat.p IS NOT NULL THEN len(list_intersect(r.ws, nat.ws)) END AS own FROM g JOIN r USING (row) LEFT JOIN nat ON nat.p = g.p),
d AS (SELECT *, greatest(top, coalesce(own, 0)) AS best, CASE WHEN coalesce(own > top, false) THEN top ELSE greatest(second, coalesce(own, 0)) END AS rest FROM b)
SELECT row, han AS hanja FROM d WHERE (cs = 1 AND own IS NULL AND length(p) >= 3) OR (best > 0 AND best >= 2 * rest AND NOT coalesce(own > top, false))""",
)
def infer_hanja_query(spark, d):
    """Every third part lacks hanja; names are one word each, so that beginnings of two syllables are no words."""
    p = table(spark, d, "part").filter("p_partkey % 3 = 0")
    gloss = F.when(F.col("p_size") % 2 == 0, F.lower("p_type")).otherwise(F.concat(F.lower("p_brand"), F.lit(" piece")))
    rows = p.select(F.col("p_partkey").alias("row"), hangul_of(F.regexp_replace(F.lower("p_name"), " ", "")).alias("headword"), gloss.alias("gloss"), F.lit("kengdic").alias("source"), F.lit("").alias("hanja"))
    return infer_hanja(rows, _part_entries(spark, d))

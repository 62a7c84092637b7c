"""Queries over a whole dictionary made of the part table, written as the files that a lookup reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossarium.functions.english import _lemmas_sql
from glossarium.functions.writing import LETTERS, SYLLABLES_OF, hangul_of
from glossarium.plans.postings import indexed
from glossarium.plans.registry import query
from glossarium.plans.router import Lexicon, english_many, lexicon, lookup_in_text, search
from glossarium.plans.tables import table
from glossarium.sources.shared import own_dir


def part_rows(spark, d) -> DataFrame:
    """Parts as entries of three packs: name, gloss of name, type and brand, and a definition that repeats some of it."""
    p = table(spark, d, "part")
    pack = F.when(F.col("p_size") % 3 == 0, "krdict").when(F.col("p_size") % 3 == 1, "wikt").otherwise("stdict")
    none = F.lit(None).cast("string")
    return p.select(
        F.col("p_partkey").cast("long").alias("id"), pack.alias("pack"), F.col("p_name").alias("headword"), none.alias("hanja"), none.alias("pos"),
        F.concat("p_name", F.lit("; to "), F.lower("p_type"), F.lit(", "), F.lower("p_brand")).alias("gloss"),
        F.concat(F.lit("a thing of size "), F.col("p_size").cast("string"), F.lit(" that some call "), F.lower("p_brand")).alias("def"),
        F.round(F.col("p_retailprice") * 100).cast("long").alias("rank"), F.lit(None).cast("int").alias("level"), F.lit(False).alias("hist"), F.split("p_name", " ").alias("forms"),
    )


def stored_lexicon(spark, d, stemmed: bool) -> Lexicon:
    lex = lexicon(part_rows(spark, d))
    lex.postings = indexed(lex.entries.select("id", "pack", F.col("gloss").alias("head"), F.col("def").alias("en")), stemmed=stemmed)
    folder = f"{own_dir(spark)}/lexicon-{uuid.uuid4().hex}"
    lex.write(folder)
    return Lexicon.read(spark, folder)


def box_queries(spark, d) -> DataFrame:
    """What people might type: names, their last words in the plural, types with "to", beginnings of brands, a size with a brand."""
    p = table(spark, d, "part")
    typed = [
        F.col("p_name"),
        F.concat(F.element_at(F.split("p_name", " "), -1), F.lit("s")),
        F.concat(F.lit("to "), F.lower("p_type")),
        F.lower(F.left("p_brand", F.lit(6))),
        F.left("p_name", F.lit(2)),
        F.concat(F.lit("size "), F.col("p_size").cast("string"), F.lit(" "), F.left(F.lower("p_brand"), F.lit(4))),
    ]
    return p.select(F.explode(F.array(*typed)).alias("q")).distinct()


_RULE = f"""WITH e AS MATERIALIZED (SELECT CAST(p_partkey AS BIGINT) AS id, CASE p_size % 3 WHEN 0 THEN 'krdict' WHEN 1 THEN 'wikt' ELSE 'stdict' END AS pack, p_size % 3 AS quality,
  CAST(round(p_retailprice * 100) AS BIGINT) AS rank, p_name, lower(p_type) AS kind, lower(p_brand) AS brand, p_name || '; to ' || lower(p_type) || ', ' || lower(p_brand) AS gloss,
  'a thing of size ' || p_size || ' that some call ' || lower(p_brand) AS def FROM part),
i AS (SELECT id, pack, quality, rank, unnest([trim(lower(p_name)), kind, brand]) AS term, unnest([0, 1, 2]) AS n FROM e),
terms AS MATERIALIZED (SELECT term, id, pack, min(least(n, 1)) AS tier, min((least(n, 1) + quality) * 10000000 + least(rank, 9999999)) AS score FROM i WHERE length(term) <= 40 GROUP BY ALL),
typed AS (SELECT DISTINCT unnest([p_name, string_split(p_name, ' ')[-1] || 's', 'to ' || lower(p_type), lower(left(p_brand, 6)), left(p_name, 2), 'size ' || p_size || ' ' || lower(left(p_brand, 4))]) AS q FROM part),
words AS (SELECT q AS w FROM typed WHERE NOT contains(q, ' ') AND q NOT IN (SELECT term FROM terms)),
base AS (SELECT w AS q, arg_min(lemma, k) AS base FROM ({_lemmas_sql()}) WHERE lemma IN (SELECT term FROM terms) GROUP BY w),
a AS MATERIALIZED (SELECT q, coalesce(base, q) AS own, regexp_replace(coalesce(base, q), '^to (.)', '\\1') AS term FROM typed LEFT JOIN base USING (q)),
x AS (SELECT q, id, pack, min(score) AS key FROM (SELECT a.q, t.*, row_number() OVER (PARTITION BY a.q, pack ORDER BY score, id) AS n FROM a JOIN terms t ON t.term = a.term) WHERE n <= 60 GROUP BY ALL),
l AS (SELECT * FROM (SELECT a.q, t.*, row_number() OVER (PARTITION BY a.q, pack ORDER BY t.term, score, id) AS n FROM a JOIN terms t ON length(a.term) >= 3 AND starts_with(t.term, a.term) AND t.term <> a.term) WHERE n <= 2000),
y AS (SELECT q, id, pack, min(score + (2 - tier) * 10000000) AS key FROM l ANTI JOIN x USING (q, id, pack) GROUP BY ALL),
g AS MATERIALIZED (SELECT * FROM x UNION ALL SELECT q, id, pack, key FROM (SELECT *, row_number() OVER (PARTITION BY q, pack ORDER BY key, id) AS n FROM y) WHERE n <= 40),
few AS (SELECT a.q, own FROM a LEFT JOIN (SELECT q, count(*) AS c FROM g GROUP BY q) USING (q) WHERE CASE WHEN length(term) >= 3 THEN coalesce(c, 0) < 30 ELSE coalesce(c, 0) = 0 END),
f AS (SELECT q, list_filter(regexp_split_to_array(lower(own), '[^a-z0-9]+'), lambda z: z <> '')[1:8] AS w FROM few),
aw AS (SELECT q, len(w) AS words, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word, w FROM f),
ak AS (SELECT q, words, k, word, k = words AND length(word) >= 3 AS begins FROM aw),
dt AS (SELECT id, pack, list_filter(regexp_split_to_array(lower(gloss), '[^a-z0-9]+'), lambda z: z <> '') AS h, list_filter(regexp_split_to_array(lower(def), '[^a-z0-9]+'), lambda z: z <> '') AS e FROM e),
st AS (SELECT pack, count(*) AS n, avg(len(h) + len(e)) AS mean FROM dt GROUP BY pack),
t AS MATERIALIZED (SELECT id, pack, term, sum(weight) AS weight, any_value(len) AS len FROM (SELECT id, pack, unnest(h) AS term, 10.0::DOUBLE AS weight, len(h) + len(e) AS len FROM dt
  UNION ALL SELECT id, pack, unnest(e), 1.0::DOUBLE, len(h) + len(e) FROM dt) GROUP BY id, pack, term),
h AS MATERIALIZED (SELECT q, words, k, pack, id, any_value(len) AS len, sum(weight) AS f FROM ak JOIN t ON CASE WHEN begins THEN starts_with(term, word) ELSE term = word END GROUP BY ALL),
df AS (SELECT q, k, pack, count(*) AS df FROM h GROUP BY ALL),
sc AS (SELECT q, pack, id, -sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean))) AS score
  FROM h JOIN df USING (q, k, pack) JOIN st USING (pack) GROUP BY q, words, pack, id HAVING count(*) = words),
u AS (SELECT q, id, pack, 0 AS stage, CAST(key AS DOUBLE) AS key FROM g UNION ALL
  SELECT q, id, pack, 1, score * (1 - 0.15 * CASE pack WHEN 'krdict' THEN 0 WHEN 'wikt' THEN 1 ELSE 2 END) FROM (SELECT *, row_number() OVER (PARTITION BY q, pack ORDER BY round(score, 9), id) AS n FROM sc) WHERE n <= 40),
o AS (SELECT q, pack, id, min((stage, round(key, 9))) AS b FROM u GROUP BY ALL),
r AS (SELECT q, row_number() OVER (PARTITION BY q ORDER BY b, rank, pack, id) AS n, pack, id FROM o JOIN e USING (pack, id))
SELECT q, CAST(n AS INT) AS n, pack, id, 'fts' AS via FROM r WHERE n <= 100"""


@query("qry05_search_english", _RULE)
def search_english(spark, d):
    """search_english's whole rule for a table of queries, over a dictionary written as files; words aren't stemmed, so that SQL can say the same."""
    return english_many(stored_lexicon(spark, d, False), box_queries(spark, d), stemmed=False)


def korean_lexicon(spark, d) -> Lexicon:
    """Parts as entries whose headwords are their names in Hangul, some of them verbs, with English glosses; written as files."""
    p = table(spark, d, "part")
    rows = part_rows(spark, d).drop("headword", "forms").join(p.select(F.col("p_partkey").cast("long").alias("id"), hangul_of(F.col("p_name")).alias("headword"), "p_name"), "id")
    rows = rows.withColumn("headword", F.when(F.col("id") % 7 == 0, F.concat("headword", F.lit("다"))).otherwise(F.col("headword"))).withColumn("forms", F.split("headword", " "))
    folder = f"{own_dir(spark)}/lexicon-{uuid.uuid4().hex}"
    lexicon(rows.drop("p_name")).write(folder)
    return Lexicon.read(spark, folder)


#: Names, their beginnings, initials, mixed scripts and English, as typed; letters stand for syllables as in the lexicon.
TYPED = ["cold ring", "small", "re", "hot gearda"]
BESIDE = ["ring", "to economy", "brand#1", "Ｂｒａｎｄ", ""]


@query("qry01_search")
def search_query(spark, d):
    lex = korean_lexicon(spark, d)
    mapped = str.maketrans(LETTERS, SYLLABLES_OF)
    typed = [w.translate(mapped) for w in TYPED]
    out = None
    for q in [*typed, typed[1] + " ring", *BESIDE]:
        got = search(lex, q).select(F.lit(q).alias("q"), "n", "pack", "id", "via")
        out = got if out is None else out.unionByName(got)
    return out


@query("qry23_lookup_in_text")
def lookup_query(spark, d):
    """A tap into each part's name in Hangul, with a particle behind it, at a place that its key decides."""
    p = table(spark, d, "part")
    taps = p.select(F.col("p_partkey").alias("tap"), F.concat(hangul_of(F.col("p_name")), F.lit("는 "), F.lower("p_type")).alias("text"), (F.col("p_partkey") % 12).cast("int").alias("offset"))
    return lookup_in_text(korean_lexicon(spark, d), taps)

"""Words of another language reached through synonyms.

A lemma without an answer of its own is answered by the words that its synset's
other members lead to. A member leads to few words (its best gloss hits); a
word counts two points for each member whose first gloss it is, else one, and
needs two; a synset gives a lemma its first six words in the order in which the
members lead to them.

Members times members would be the square of a synset. Instead a synset's words
are added up once for all members; what a lemma itself has added is taken off
again, which touches as many words as one member leads to. Of a synset's words,
in order, the first six plus that many are therefore enough for any lemma.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossarium.operators.capped import first_of
from glossarium.plans.registry import query
from glossarium.plans.tables import table

#: Gloss hits read of a term, and used of a synonym; points a word needs; words of a synset, synsets of a lemma.
READ, USED, POINTS, WORDS, SENSES = 12, 4, 2, 6, 3


def led_to(hits: DataFrame) -> DataFrame:
    """(term, pos, word, points, k) of hits (term, pos, word, tier, score): the words of a term's best hits, once each, by place."""
    best = first_of(hits, ["term", "pos"], ["score", "word", "tier"], USED)  # the first of those that are read
    k = F.row_number().over(Window.partitionBy("term", "pos").orderBy("score", "word", "tier"))
    placed = best.withColumn("k", k).groupBy("term", "pos", "word").agg(F.min(F.struct("k", "tier")).alias("b"))
    return placed.select("term", "pos", "word", F.when(F.col("b.tier") == 0, 2).otherwise(1).alias("points"), F.col("b.k").alias("k"))


def bridged(members: DataFrame, similar: DataFrame, hits: DataFrame) -> DataFrame:
    """(lemma, pos, synset, n, word, via): what lemmas reach through their synsets.

    members is (synset, pos, n, lemma, place): place is the lemma's place in
    the synset, n the synset's among the lemma's senses; similar is (synset,
    other), whose members follow an adjective's own (pos ``a``); hits is (term,
    pos, word, tier, score). Lemmas with an answer of their own are left out.
    """
    own = members.select("synset", "pos", F.lower("lemma").alias("c"), "place")
    near = similar.select("synset", F.col("other").alias("o")).distinct().join(members.filter("pos = 'a'").select(F.col("synset").alias("o"), "pos", F.lower("lemma").alias("c"), "place"), "o")
    # own members come first, then those of similar synsets by the synset's name
    placed = own.withColumn("o", F.lit(None).cast("string")).unionByName(near.select("synset", "pos", "c", "place", F.col("o").cast("string").alias("o")))
    through = placed.filter(~F.col("c").contains(" ")).groupBy("synset", "pos", "c").agg(F.min(F.struct("o", "place")).alias("place"))
    leads = led_to(hits.select(F.lower("term").alias("term"), "pos", "word", "tier", "score"))
    added = through.join(leads.withColumnRenamed("term", "c"), ["c", "pos"]).select("synset", "pos", "c", "word", "points", F.struct("place", "k").alias("at"))
    total = added.groupBy("synset", "pos", "word").agg(F.sum("points").alias("points"), F.min(F.struct("at", "c")).alias("first"))
    # the first member that leads to a word, and the first besides it
    second = added.join(total.select("synset", "pos", "word", F.col("first.c").alias("lead")), ["synset", "pos", "word"]).filter("c <> lead").groupBy("synset", "pos", "word").agg(F.min(F.struct("at", "c")).alias("second"))
    words = first_of(total.filter(F.col("points") >= POINTS), ["synset", "pos"], ["first"], WORDS + USED).join(second, ["synset", "pos", "word"], "left")
    unanswered = members.withColumn("c", F.lower("lemma")).join(leads.select(F.col("term").alias("c"), "pos").distinct(), ["c", "pos"], "left_anti")
    # a lemma without hits of its own part of speech has added nothing: what is taken off comes from forms that do
    asked = unanswered.select("synset", "pos", "n", "lemma", "c").distinct()
    mine = added.select("synset", "pos", "c", "word", F.col("points").alias("less"))
    x = asked.join(words, ["synset", "pos"]).join(mine, ["synset", "pos", "c", "word"], "left")
    x = x.withColumn("points", F.col("points") - F.coalesce("less", F.lit(0))).filter(F.col("points") >= POINTS)
    x = x.withColumn("lead", F.when(F.col("first.c") == F.col("c"), F.col("second")).otherwise(F.col("first")))
    k = F.row_number().over(Window.partitionBy("lemma", "pos", "synset").orderBy("lead.at", "word"))
    x = x.withColumn("k", k).filter(F.col("k") <= WORDS)
    senses = x.select("lemma", "pos", "synset", "n").distinct()
    senses = senses.withColumn("sense", F.row_number().over(Window.partitionBy("lemma", "pos").orderBy("n", "synset"))).filter(F.col("sense") <= SENSES).drop("n")
    x = x.join(senses, ["lemma", "pos", "synset"])
    n = F.row_number().over(Window.partitionBy("lemma").orderBy("pos", "sense", "k")) - 1
    return x.select("lemma", "pos", "synset", n.alias("n"), "word", F.col("lead.c").alias("via"))


# Query: a part's type and size class is a synset, its name a member; glosses of every other name are known.

def _members(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    pos = F.when(F.col("p_size") % 2 == 0, "a").otherwise("n")
    return p.groupBy(F.concat("p_type", F.lit("-"), (F.col("p_size") % 5).cast("string"), F.lit("-"), pos).alias("synset"), pos.alias("pos"), F.regexp_replace("p_name", " ", "-").alias("lemma")).agg(F.min("p_partkey").cast("long").alias("place"))


def _hits(spark, d) -> DataFrame:
    p = table(spark, d, "part").filter("p_partkey % 4 > 0")
    return p.filter(F.length("p_name") % 2 == 0).select(
        F.regexp_replace("p_name", " ", "-").alias("term"), F.when(F.col("p_size") % 2 == 0, "a").otherwise("n").alias("pos"), F.concat(F.col("p_brand"), F.lit("/"), (F.col("p_partkey") % 3).cast("string")).alias("word"), (F.col("p_partkey") % 2).alias("tier"), (F.col("p_retailprice") * 100).cast("long").alias("score")
    )


def _similar(members: DataFrame) -> DataFrame:
    """Each synset of adjectives is similar to that of the same type and the next size class."""
    s = members.filter("pos = 'a'").select("synset").distinct()
    size = F.split("synset", "-")[1].cast("int")
    return s.select("synset", F.concat(F.split("synset", "-")[0], F.lit("-"), ((size + 1) % 5).cast("string"), F.lit("-a")).alias("other"))


@query(
    "jn26_bridge",
    """WITH m AS (SELECT p_type || '-' || (p_size % 5) || '-' || pos AS synset, pos, replace(p_name, ' ', '-') AS lemma, min(p_partkey) AS place FROM (SELECT *, CASE WHEN p_size % 2 = 0 THEN 'a' ELSE 'n' END AS pos FROM part) GROUP BY ALL),
h AS (SELECT DISTINCT replace(p_name, ' ', '-') AS term, CASE WHEN p_size % 2 = 0 THEN 'a' ELSE 'n' END AS pos, p_brand || '/' || (p_partkey % 3) AS word, p_partkey % 2 AS tier, CAST(p_retailprice * 100 AS BIGINT) AS score FROM part WHERE p_partkey % 4 > 0 AND length(p_name) % 2 = 0),
b AS (SELECT *, row_number() OVER (PARTITION BY term, pos ORDER BY score, word, tier) AS k FROM h),
l AS (SELECT term, pos, word, min(k) AS k, CASE WHEN arg_min(tier, k) = 0 THEN 2 ELSE 1 END AS points FROM b WHERE k <= 4 GROUP BY ALL),
c AS (SELECT synset, pos, c, min(part * 100000000 + place) AS place FROM (SELECT synset, pos, lemma AS c, 0 AS part, place FROM m
  UNION ALL SELECT s.synset, s.pos, o.lemma, 1, o.place FROM (SELECT DISTINCT synset, pos FROM m WHERE pos = 'a') s JOIN m o ON o.pos = 'a' AND o.synset = string_split(s.synset, '-')[1] || '-' || ((CAST(string_split(s.synset, '-')[2] AS INT) + 1) % 5) || '-a') GROUP BY ALL),
a AS (SELECT m.lemma, m.pos, m.synset, l.word, sum(l.points) AS points, min({'place': c.place, 'k': l.k}) AS seen, arg_min(c.c, {'place': c.place, 'k': l.k}) AS via
  FROM m JOIN c ON c.synset = m.synset AND c.pos = m.pos AND c.c <> m.lemma JOIN l ON l.term = c.c AND l.pos = c.pos WHERE NOT EXISTS (SELECT 1 FROM l x WHERE x.term = m.lemma AND x.pos = m.pos) GROUP BY ALL HAVING sum(l.points) >= 2),
k AS (SELECT *, row_number() OVER (PARTITION BY lemma, pos, synset ORDER BY seen, word) AS k FROM a), w AS (SELECT * FROM k WHERE k <= 6),
s AS (SELECT *, dense_rank() OVER (PARTITION BY lemma, pos ORDER BY synset) AS sense FROM w)
SELECT lemma, pos, synset, CAST(row_number() OVER (PARTITION BY lemma ORDER BY pos, sense, k) - 1 AS INT) AS n, word, via FROM s WHERE sense <= 3""",
)
def bridge_query(spark, d):
    members = _members(spark, d)
    senses = members.withColumn("n", F.lit(0))  # senses of a lemma go by the synset's name here
    return bridged(senses, _similar(members), _hits(spark, d).distinct())

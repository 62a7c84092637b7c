"""A stored full-text index, and ranked search of many queries in one plan.

Postings (term, pack, id, weight, len) are made once, ordered by term and
dealt by ranges of term and id, so that a common term lies in many files and a
query's terms in few. Counts of documents by term are a table of their own.

A word's documents are gathered once for all queries that have it, whatever
the number of terms that go on from it. A query's rarest word names its
candidates; only those meet the documents of its other words, by word and
document, so no step has a row for each document and query, or for each
candidate and term.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossarium.functions.stemming import porter, stems
from glossarium.plans.registry import query
from glossarium.plans.search import tokens
from glossarium.sources.shared import cut, own_dir

#: A query's words beyond these are left out.
MOST_WORDS = 8
#: The last word of a query may go on if it has so many characters.
LEAST_PREFIX = 3


@dataclass
class Postings:
    """postings (term, pack, id, weight, len), terms (term, pack, df), packs (pack, n, mean)."""

    postings: DataFrame
    terms: DataFrame
    packs: DataFrame

    def of(self, these: Column) -> Postings:
        """The part of some packs."""
        return Postings(*(t.filter(these) for t in (self.postings, self.terms, self.packs)))

    def write(self, folder: str) -> None:
        spark = self.postings.sparkSession
        self.postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{folder}/postings")
        kept = spark.read.parquet(f"{folder}/postings")
        counted = kept.groupBy("term", "pack").agg(F.count("*").alias("df"))
        counted.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/posting_terms")
        self.packs.write.mode("overwrite").parquet(f"{folder}/posting_packs")

    @staticmethod
    def read(spark: SparkSession, folder: str) -> Postings:
        return Postings(*(spark.read.parquet(f"{folder}/{name}") for name in ("postings", "posting_terms", "posting_packs")))


def indexed(rows: DataFrame, weights: tuple[float, float] = (10.0, 1.0), stemmed: bool = True) -> Postings:
    """The index of rows (id, pack, head, en), one for each id of a pack; a word counts by the weight of its column."""
    words = [tokens(F.coalesce(c, F.lit(""))) for c in ("head", "en")]
    size = F.size(words[0]) + F.size(words[1])  # stems are as many
    if stemmed:
        words = [stems(w) for w in words]
    t = rows.select("id", "pack", words[0].alias("h"), words[1].alias("e"), size.alias("len"))

    def heavy(c: str, weight: float) -> Column:
        return F.transform(c, lambda w: F.struct(w.alias("term"), F.lit(weight).alias("weight")))

    each = t.select("id", "pack", "len", F.explode(F.concat(heavy("h", weights[0]), heavy("e", weights[1]))).alias("t")).select("id", "pack", "len", "t.*")
    postings = each.groupBy("term", "pack", "id", "len").agg(F.sum("weight").alias("weight")).select("term", "pack", "id", "weight", "len")
    return Postings(postings, postings.groupBy("term", "pack").agg(F.count("*").alias("df")), t.groupBy("pack").agg(F.count("*").alias("n"), F.avg("len").alias("mean")))


def asked_words(queries: DataFrame, stemmed: bool = True, prefix: bool = True) -> DataFrame:
    """(q, k, word, begins) of queries (q, text): their first words, the last of which may go on where it is long enough."""
    w = queries.select("q", F.slice(tokens(F.col("text")), 1, MOST_WORDS).alias("w"))
    last = F.element_at("w", -1)
    w = w.filter(F.size("w") > 0).withColumn("open", (F.length(last) >= LEAST_PREFIX) & F.lit(prefix)).withColumn("size", F.size("w"))
    w = w.withColumn("w", stems(F.col("w")) if stemmed else F.col("w"))
    return w.select("q", "size", "open", F.posexplode("w").alias("k", "word")).select("q", "k", "word", (F.col("open") & (F.col("k") == F.col("size") - 1)).alias("begins"))


def search_postings(ix: Postings, asked: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(q, pack, id, score) of the documents that have every word of a query; lower is better.

    asked is (q, k, word, begins): word k of query q as the index has it, or
    with ``begins`` any term that begins so.
    """
    vocabulary = ix.terms.select("term").distinct()
    words = asked.select("word", "begins").distinct()

    def going_on(words: DataFrame, letters: int) -> DataFrame:
        """(word, begins, term) of terms that begin so; they meet by their first letters."""
        own = words.select("word", "begins", F.left("word", F.lit(letters)).alias("start"))
        return own.join(vocabulary.withColumn("start", F.left("term", F.lit(letters))), "start").filter(F.col("term").startswith(F.col("word"))).select("word", "begins", "term")

    # a stem may be shorter than what was typed
    opened = words.filter("begins")
    longer = going_on(opened.filter(F.length("word") >= LEAST_PREFIX), LEAST_PREFIX).unionByName(going_on(opened.filter(F.length("word") < LEAST_PREFIX), 1))
    wanted = cut(words.filter("NOT begins").withColumn("term", F.col("word")).unionByName(longer), "wanted")
    held = ix.postings.select("term", "pack", "id", "weight", "len").join(wanted, "term").groupBy("word", "begins", "pack", "id", "len").agg(F.sum("weight").alias("f"))
    held = cut(held, "held")
    counts = asked.join(held.groupBy("word", "begins", "pack").agg(F.count("*").alias("df")), ["word", "begins"]).select("q", "k", "pack", "df")
    counts = cut(counts, "counts")
    whole = asked.groupBy("q").agg(F.count("*").alias("words"))
    # a query with a word that nothing has is left out here
    rarest = counts.groupBy("q", "k").agg(F.sum("df").alias("df")).groupBy("q").agg(F.min_by("k", F.struct("df", "k")).alias("first"), F.count("*").alias("known")).join(whole, "q").filter("known = words").drop("known")
    own = cut(asked.join(rarest, "q"), "own")
    part_of = ["q", "k", "words", "pack", "id", "len", "f"]
    first = own.filter("k = first").join(held, ["word", "begins"]).select(*part_of)
    others = first.select("q", "pack", "id").join(own.filter("k <> first"), "q").join(held, ["word", "begins", "pack", "id"]).select(*part_of)
    x = first.unionByName(others).join(counts, ["q", "k", "pack"]).join(ix.packs, "pack")
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    scored = x.groupBy("q", "words", "pack", "id").agg(F.count("*").alias("have"), (-F.sum(part)).alias("score"))
    return scored.filter("have = words").select("q", "pack", "id", "score")


def weighted_bm25(ix: Postings, words: list[str], prefix: bool = False, stemmed: bool = True) -> DataFrame:
    """(id, pack, score) for one query; its terms are literals, which reach the scan of the postings."""
    wanted = [porter(w) if stemmed else w for w in words[:MOST_WORDS]]
    asked = ix.postings.sparkSession.createDataFrame([(0, k, w, prefix and k == len(wanted) - 1) for k, w in enumerate(wanted)], "q int, k int, word string, begins boolean")
    these = F.col("term").isin(*wanted)
    if prefix:
        these = these | F.col("term").startswith(wanted[-1])
    return search_postings(Postings(ix.postings.filter(these), ix.terms.filter(these), ix.packs), asked).select("id", "pack", "score")


# Queries: documents by source and text, asked with words of the benchmark's items.

_ASKED = 3


def _documents(spark, d, stemmed: bool) -> Postings:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return indexed(docs.select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("pack"), F.col("source").alias("head"), F.col("text").alias("en")), stemmed=stemmed)


def _asked(spark, d) -> DataFrame:
    """Each item's first three words of three letters or more, the third cut to three letters; an even item's last word may go on."""
    items = spark.read.parquet(f"{d}/benchmark.parquet")
    own = F.slice(F.filter(tokens(F.col("text")), lambda w: F.length(w) >= 3), 1, _ASKED)
    return items.select(F.col("item_id").alias("q"), F.transform(own, lambda w, k: F.when(k == _ASKED - 1, F.left(w, F.lit(3))).otherwise(w)).alias("w"))


def _stored(spark, d, stemmed: bool) -> Postings:
    folder = f"{own_dir(spark)}/postings-{uuid.uuid4().hex}"
    _documents(spark, d, stemmed).write(folder)
    return Postings.read(spark, folder)


def _batch(spark, d, stemmed: bool) -> DataFrame:
    asked = _asked(spark, d)
    even = asked_words(asked.filter("q % 2 = 0").select("q", F.array_join("w", " ").alias("text")), stemmed)
    odd = asked_words(asked.filter("q % 2 = 1").select("q", F.array_join("w", " ").alias("text")), stemmed, prefix=False)
    return search_postings(_stored(spark, d, stemmed), even.unionByName(odd)).select("q", "pack", "id", F.round("score", 6).alias("score"))


@query("qry07_weighted_bm25")
def weighted_bm25_query(spark, d):
    return _batch(spark, d, True)


@query(
    "qry07_stored_postings",
    """WITH docs AS (SELECT doc_id AS id, coalesce(lang, '') AS pack, list_filter(regexp_split_to_array(lower(coalesce(source, '')), '[^a-z0-9]+'), lambda x: x != '') AS h,
  list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x != '') AS e FROM documents),
st AS (SELECT pack, count(*) AS n, avg(len(h) + len(e)) AS mean FROM docs GROUP BY pack),
w AS (SELECT item_id AS q, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 3)[1:3] AS w FROM benchmark),
a AS (SELECT q, len(w) AS words, k - 1 AS k, CASE WHEN k = 3 THEN left(w[k], 3) ELSE w[k] END AS word, q % 2 = 0 AND k = len(w) AS begins FROM w, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS k)),
t AS MATERIALIZED (SELECT id, pack, term, sum(weight) AS weight, any_value(len) AS len FROM (
  SELECT id, pack, unnest(h) AS term, 10.0::DOUBLE AS weight, len(h) + len(e) AS len FROM docs UNION ALL SELECT id, pack, unnest(e), 1.0::DOUBLE, len(h) + len(e) FROM docs) GROUP BY id, pack, term),
h AS MATERIALIZED (SELECT q, words, k, pack, id, any_value(len) AS len, sum(weight) AS f FROM a JOIN t ON CASE WHEN begins THEN starts_with(term, word) ELSE term = word END GROUP BY ALL),
df AS (SELECT q, k, pack, count(*) AS df FROM h GROUP BY ALL)
SELECT q, pack, id, round(-sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
FROM h JOIN df USING (q, k, pack) JOIN st USING (pack) GROUP BY q, words, pack, id HAVING count(*) = words""",
)
def stored_postings_query(spark, d):
    return _batch(spark, d, False)

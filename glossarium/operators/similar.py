"""Pairs of similar sets, exactly, without meeting all sets that share an element.

Sets that are equal are one class. Elements are ordered by how many classes
have them, rarest first, and numbered. Two sets with Jaccard similarity t or
more share one of the first |s| - ceil(t * |s|) + 1 elements of each, so only
those make candidates, of sizes that can be that similar. Behind the last
element that two sets share there, they share no more than either has left.
Bits that only one of two sets has an element for show how many elements they
don't share at least. Both rule most candidates out before any set is moved;
the others are verified by all their elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossarium.operators.claims import choose
from glossarium.plans.registry import query
from glossarium.plans.tables import table
from glossarium.sources.shared import cut, uncut

#: Numbers of 64 bits that tell different sets apart before these meet.
WORDS = 16


def classes(sets: DataFrame) -> DataFrame:
    """(id, cls, items) of sets (id, items): cls is the least id with the same set; empty sets and null are left out."""
    own = sets.select("id", F.array_sort(F.array_distinct(F.filter("items", lambda x: x.isNotNull()))).alias("items")).filter(F.size("items") > 0)
    own = own.withColumn("_key", F.sha2(F.to_json(F.struct("items")), 256))
    least = own.groupBy("_key").agg(F.min("id").alias("cls"))
    return own.join(least, "_key").select("id", "cls", "items")


def reaches(shared: Column, na: Column, nb: Column, percent: int) -> Column:
    """Whether sets of na and nb elements, so many of which are shared at most, may be similar."""
    return 100 * shared >= percent * (na + nb - shared)


def bits(xs: Column) -> Column:
    """WORDS numbers of 64 bits, in which each element sets the bit that its hash names."""
    at = F.transform(xs, lambda x: F.pmod(F.xxhash64(x), F.lit(64 * WORDS)))
    own = lambda k: F.filter(at, lambda x: F.floor(x / 64) == k)
    return F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda k: F.aggregate(own(k), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (x % 64).cast("int")))))


def similar_sets(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """((id, cls) of every set, and (a, b, shared, na, nb) of classes with 100 * shared >= percent * union, a < b)."""
    members = cut(classes(sets), "classes")
    own = members.filter("id = cls").select(F.col("cls").alias("id"), "items").dropDuplicates(["id"])
    each = own.select("id", F.size("items").alias("n"), F.explode("items").alias("x"))
    often = cut(each.groupBy("x").agg(F.count("*").alias("often")).withColumn("no", F.monotonically_increasing_id()), "often")
    ordered = each.join(often, "x").groupBy("id", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("often", "no"))), lambda s: s["no"]).alias("xs"))
    ordered = cut(ordered.withColumn("bits", bits(F.col("xs"))), "ordered")
    uncut(often)
    # ceil(percent * n / 100) in integers
    need = lambda n: F.floor((percent * n + 99) / 100).cast("int")
    first = ordered.select("id", "n", F.posexplode(F.slice("xs", F.lit(1), F.col("n") - need(F.col("n")) + 1)).alias("at", "x"))
    a, b = first.toDF("a", "na", "ia", "x"), first.toDF("b", "nb", "ib", "x")
    near = a.join(b, "x").filter((F.col("a") != F.col("b")) & (F.col("na") <= F.col("nb")) & (100 * F.col("na") >= percent * F.col("nb")) & ((F.col("na") < F.col("nb")) | (F.col("a") < F.col("b"))))
    # of one element alone: what both have before it may be shared as well, and no more behind it than either has left
    near = near.filter(reaches(F.least("ia", "ib") + 1 + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) - 1, F.col("na"), F.col("nb"), percent))
    near = near.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k"), F.max("ia").alias("ia"), F.max("ib").alias("ib"))
    near = near.filter(reaches(F.col("k") + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) - 1, F.col("na"), F.col("nb"), percent))
    marked = ordered.select("id", "bits")
    near = near.select("a", "b", "na", "nb").join(marked.toDF("a", "ba"), "a").join(marked.toDF("b", "bb"), "b")
    apart = F.aggregate(F.zip_with("ba", "bb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    near = near.filter(reaches(F.floor((F.col("na") + F.col("nb") - apart) / 2), F.col("na"), F.col("nb"), percent))
    near = cut(near.select("a", "b"), "near")
    sets_of = ordered.select("id", "xs")
    met = near.join(sets_of.toDF("a", "xa"), "a").join(sets_of.toDF("b", "xb"), "b")
    met = met.select("a", "b", F.size(F.array_intersect("xa", "xb")).alias("shared"), F.size("xa").alias("na"), F.size("xb").alias("nb"))
    met = met.filter(100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared")))
    left = F.col("a") < F.col("b")
    pick = lambda x, y: F.when(left, F.col(x)).otherwise(F.col(y))
    pairs = met.select(pick("a", "b").alias("a"), pick("b", "a").alias("b"), "shared", pick("na", "nb").alias("na"), pick("nb", "na").alias("nb"))
    return members.select("id", "cls"), pairs


def word_set(c: Column) -> Column:
    """The distinct words of a text, lower-cased; runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def merged_pairs(rows: DataFrame, pairs: list[tuple[str, str]], percent: int = 40) -> DataFrame:
    """(id, twin) for rows (id, ord, category, pattern, summary): each row of a pair's first form takes the most similar row of its second form that no earlier one has taken.

    Rows meet by pair and category, and must share ``percent`` of their
    summaries' words; of equally similar ones the last in order is taken.
    Twins are found by choices in order (claims), in which an option that is
    taken is gone.
    """
    spark = rows.sparkSession
    both = F.broadcast(spark.createDataFrame(pairs, "one string, other string"))  # a list of pairs
    own = rows.select("id", "ord", "category", "pattern", word_set(F.col("summary")).alias("w")).filter(F.size("w") > 0)
    a = own.join(both, F.col("pattern") == F.col("one")).select(F.col("id").alias("row"), "ord", "category", "one", "other", "w", F.size("w").alias("na"))
    b = own.join(both, F.col("pattern") == F.col("other")).select(F.col("id").alias("b"), F.col("ord").alias("b_ord"), "category", "one", "other", F.col("w").alias("v"))
    x = a.select("row", "category", "one", "other", "na", F.explode("w").alias("x")).join(b.select("b", "b_ord", "category", "one", "other", F.size("v").alias("nb"), F.explode("v").alias("x")), ["category", "one", "other", "x"])
    x = x.groupBy("row", "b", "b_ord", "na", "nb").agg(F.count("*").alias("k")).filter(100 * F.col("k") >= percent * (F.col("na") + F.col("nb") - F.col("k")))
    # similarities are ratios of small numbers: a thousand million parts tell them apart
    score = F.floor(F.col("k") * 1_000_000_000 / (F.col("na") + F.col("nb") - F.col("k"))).cast("long")
    # the greatest order wins a tie, and choose() takes the least id
    options = x.select("row", F.lit(0).alias("alt"), (-F.col("b_ord")).cast("long").alias("id"), score.alias("score"), F.lit(None).cast("long").alias("loss"), F.lit(True).alias("fits"))
    chosen = choose(a.select("row", "ord").distinct(), options).filter("id IS NOT NULL")
    return chosen.select(F.col("row").alias("id"), (-F.col("id")).alias("b_ord")).join(rows.select(F.col("ord").alias("b_ord"), F.col("id").alias("twin")), "b_ord").select("id", "twin")


@query(
    "ag19_similar_texts",
    """WITH w AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM documents),
s AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY w) AS k FROM w GROUP BY doc_id), c AS (SELECT *, min(doc_id) OVER (PARTITION BY k) AS cls FROM s),
r AS (SELECT doc_id, n FROM c WHERE doc_id = cls),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM (SELECT w.* FROM w JOIN r USING (doc_id)) x JOIN (SELECT w.* FROM w JOIN r USING (doc_id)) y ON x.w = y.w AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b, shared FROM p JOIN r ra ON ra.doc_id = a JOIN r rb ON rb.doc_id = b WHERE 100 * shared >= 70 * (ra.n + rb.n - shared))
SELECT a, b, CAST(shared AS INT) AS shared FROM l UNION ALL SELECT cls, doc_id, CAST(n AS INT) FROM c WHERE doc_id <> cls""",
)
def similar_texts(spark, d):
    """Documents whose words are the same (to the first of them) or similar to 70 % (between classes)."""
    members, pairs = similar_sets(table(spark, d, "documents").select(F.col("doc_id").alias("id"), word_set(F.col("text")).alias("items")), 70)
    sizes = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.size(word_set(F.col("text"))).alias("shared"))
    same = members.filter("id <> cls").join(sizes, "id").select(F.col("cls").alias("a"), F.col("id").alias("b"), "shared")
    return pairs.select("a", "b", "shared").unionByName(same)

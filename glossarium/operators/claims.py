"""Choices in order, where an earlier choice makes an option worth less or takes it away.

Rows choose among options one after the other. Instead of a loop over rows,
each round lets every open row of every group propose its best option under
the claims known so far. Before the first row of a group whose proposal is a
new claim nothing can change any more, so those rows are settled. From that row
on, a block of the group's next rows is folded in order, which claims more; the
next round goes on behind it. Once a group's options are claimed, all its other
rows settle at once. No task has more of a group than a block of its rows and
the list of its claims.

Where many rows and many options are alike, choose_alike works on their kinds
and classes: of a class the least id that is left goes first, so a class is a
place in the list of its ids. Options that can't win whatever is claimed are
left out, which makes groups small, and a group's rows are read in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossarium.functions.korean import hint_score, pos_fit
from glossarium.operators.capped import first_of
from glossarium.operators.corpus import connected_components
from glossarium.operators.numbering import numbered
from glossarium.plans.registry import query
from glossarium.plans.tables import table
from glossarium.sources.shared import cut, uncut

#: Fixed values of the scores: by hint, level and homonym number, and what a claimed entry loses.
HINT, LEVEL, HOMONYM, CLAIMED = 5, 8, 3, 15
#: The fit of a part of speech, or else of the hint, that a choice needs.
FIT, HINT_FIT = 30, 3
DERIVED = ("하다", "되다")
#: Rows of a group that a round folds in order.
BLOCK = 256
#: Rows of a group that one task of choose_alike reads, and ids of a class that it has.
TURN = 1 << 16


def _choice(options: Column, claimed: Column) -> Column:
    """The id chosen: of the first alternative whose best option (score less its loss if claimed, then the least id) fits; null if none does."""
    lost = lambda o: F.when(F.array_contains(claimed, o["id"]), o["loss"]).otherwise(F.lit(0).cast("long"))
    worth = F.transform(options, lambda o: F.struct(o["alt"].alias("alt"), (lost(o) - o["score"]).alias("cost"), o["id"].alias("id"), (o["fits"] & (lost(o).isNotNull())).alias("fits")))
    # an option that is taken away (its loss is null) stands last in its alternative and doesn't fit
    worth = F.transform(worth, lambda o: F.struct(o["alt"].alias("alt"), o["cost"].isNull().alias("gone"), o["cost"].alias("cost"), o["id"].alias("id"), o["fits"].alias("fits")))
    order = F.array_sort(worth)
    first = F.filter(order, lambda o, k: (k == 0) | (F.get(order, k - 1)["alt"] != o["alt"]))
    return F.get(F.filter(first, lambda o: o["fits"]), F.lit(0))["id"]


def _fold(rows: Column, claimed: Column) -> Column:
    """(claimed, chosen) after a block of rows, one after the other."""
    start = F.struct(claimed.alias("claimed"), F.array().cast("array<struct<row:bigint,id:bigint>>").alias("chosen"))

    def step(acc: Column, x: Column) -> Column:
        # the choice is computed once: as the only element of an array
        picked = F.transform(F.array(_choice(x["options"], acc["claimed"])), lambda i: F.struct(F.when(i.isNull() | F.array_contains(acc["claimed"], i), acc["claimed"]).otherwise(F.concat(acc["claimed"], F.array(i))).alias("claimed"), F.concat(acc["chosen"], F.array(F.struct(x["row"].alias("row"), i.alias("id")))).alias("chosen")))
        return F.get(picked, F.lit(0))

    return F.aggregate(rows, start, step)


def choose(rows: DataFrame, options: DataFrame) -> DataFrame:
    """(row, id) for rows (row, ord): the id that each chooses in the order of ord, or null.

    options is (row, alt, id, score, loss, fits): alternatives are tried in
    order; loss is what an option's score loses once an earlier row has chosen
    its id, and null takes it away. Every ord is distinct; a row has a handful
    of options.
    """
    packed = options.groupBy("row").agg(F.collect_list(F.struct(F.col("alt").cast("int").alias("alt"), F.col("id").cast("long").alias("id"), F.col("score").cast("long").alias("score"), F.col("loss").cast("long").alias("loss"), "fits")).alias("options"))
    open_rows = rows.join(packed, "row", "left")
    nothing = open_rows.filter("options IS NULL").select("row", F.lit(None).cast("long").alias("id"))
    # rows that share an id, directly or by other rows, are a group: its name is its least id
    links = options.groupBy("row").agg(F.min("id").alias("least")).join(options.select("row", "id"), "row").select("least", "id").distinct()
    groups = connected_components(links, "least", "id")
    named = open_rows.filter("options IS NOT NULL").withColumn("least", F.array_min(F.transform("options", lambda o: o["id"])))
    left = cut(named.join(groups.select(F.col("node").alias("least"), F.col("component").alias("grp")), "least").select("row", "ord", "grp", "options"), "open")
    claims = rows.sparkSession.createDataFrame([], "grp long, claimed array<long>")
    settled = []
    while True:
        proposed = left.join(claims, "grp", "left").withColumn("claimed", F.coalesce("claimed", F.array().cast("array<long>")))
        proposed = cut(proposed.withColumn("id", _choice(F.col("options"), F.col("claimed"))), "proposed")
        fresh = proposed.filter(F.col("id").isNotNull() & ~F.array_contains("claimed", F.col("id")))
        both = proposed.join(fresh.groupBy("grp").agg(F.min("ord").alias("until")), "grp", "left")
        settled.append(cut(both.filter("until IS NULL OR ord < until").select("row", "id"), "settled"))
        open_rows = cut(both.filter("ord >= until").select("row", "ord", "grp", "options", "claimed"), "open")
        uncut(left)
        if open_rows.isEmpty():
            break
        block = first_of(open_rows, ["grp"], ["ord"], BLOCK)
        block = block.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("ord", "row", "options"))).alias("rows"), F.first("claimed").alias("claimed"))
        block = cut(block.select("grp", F.element_at("rows", -1)["ord"].alias("last"), _fold(F.col("rows"), F.col("claimed")).alias("f")), "block")
        settled.append(block.select(F.explode("f.chosen").alias("x")).select("x.row", "x.id"))
        claims = block.select("grp", F.col("f.claimed").alias("claimed"))
        left = cut(open_rows.join(block.select("grp", "last"), "grp").filter("ord > last").select("row", "ord", "grp", "options"), "open")
        uncut(proposed, open_rows)
    out = nothing
    for s in settled:
        out = out.unionByName(s)
    return out


def may_win(options: DataFrame) -> DataFrame:
    """Those of options (kind, alt, cls, score, loss, fits) that some state of the claims makes a kind's choice, or lets stand in the way of one.

    Of each alternative one option that can't be taken away has a worst cost;
    what costs more unclaimed never comes before it. An alternative of which
    nothing fits is none, and behind one that always fits no other is tried.
    """
    each = Window.partitionBy("kind", "alt")
    o = options.withColumn("_worst", F.min(F.col("loss") - F.col("score")).over(each)).filter("_worst IS NULL OR -score <= _worst")
    o = o.withColumn("_some", F.max("fits").over(each)).withColumn("_sure", F.min("fits").over(each) & F.max(F.col("loss").isNotNull()).over(each)).filter("_some")
    o = o.withColumn("_last", F.min(F.when(F.col("_sure"), F.col("alt"))).over(Window.partitionBy("kind")))
    return o.filter("_last IS NULL OR alt <= _last").drop("_worst", "_some", "_sure", "_last")


def _placed(df: DataFrame, by: str, order: str) -> DataFrame:
    """df with each row's place in its group, from 0; no task sorts a group of more than TURN rows."""
    most = df.groupBy(by).count().agg(F.max("count").alias("n")).first()["n"] or 0
    if most > TURN:
        return numbered(df, [order], [by], "place")
    return cut(df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1), "placed")


def _read_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, id, cls, fresh) of rows sorted by group, behind the group's classes (tag 0) and kinds (tag 1)."""
    grp, left, least, kinds = None, {}, {}, {}
    for batch in batches:
        out = []
        for g, tag, key, row, first, ids, options in zip(*(c.to_pylist() for c in batch.columns)):
            if g != grp:
                grp, left, least, kinds = g, {}, {}, {}
            if tag == 0:
                left[key], least[key] = (ids or [])[::-1], first
            elif tag == 1:
                alts = {}
                for o in sorted(options, key=lambda o: (o["alt"], -o["score"])):
                    alts.setdefault(o["alt"], []).append((-o["score"], o["loss"], o["cls"], o["fits"]))
                kinds[key] = list(alts.values())
            else:
                pick = None
                for own in kinds[key]:
                    best = None
                    for cost, loss, cls, fits in own:
                        if best and cost > best[0]:
                            break
                        if left[cls]:
                            here = cost, left[cls][-1], cls, fits, True
                        elif loss is not None:
                            here = cost + loss, least[cls], cls, fits, False
                        else:
                            continue
                        if best is None or here < best:
                            best = here
                    if best and best[3]:
                        pick = best
                        break
                if pick is None:
                    out.append((row, None, None, False))
                else:
                    out.append((row, pick[1], pick[2], pick[4]))
                    if pick[4]:
                        left[pick[2]].pop()
        columns = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["row", "id", "cls", "fresh"])


def choose_alike(rows: DataFrame, options: DataFrame, members: DataFrame) -> DataFrame:
    """(row, id) as choose gives it, for rows (row, ord, kind), options (kind, alt, cls, score, loss, fits) and members (cls, id).

    Rows of a kind have the same options, ids of a class the same score, loss
    and fit for every kind; kinds, classes, ids and ord are longs, an id is in
    one class, and a loss is above 0 or null. Kinds that share a class,
    directly or by others, are a group. A task reads TURN rows of a group at
    most, with as many ids of a class; the next round goes on behind them.
    """
    options = cut(may_win(options), "options")
    least = options.groupBy("kind").agg(F.min("cls").alias("least"))
    groups = connected_components(least.join(options.select("kind", "cls"), "kind").select("least", "cls").distinct(), "least", "cls").select(F.col("node").alias("cls"), F.col("component").alias("grp"))
    of_kind = least.join(groups, F.col("least") == F.col("cls")).select("kind", "grp")
    nothing = rows.join(of_kind, "kind", "left_anti").select("row", F.lit(None).cast("long").alias("id"))
    turns = _placed(rows.join(of_kind, "kind").select("row", "ord", "kind", "grp"), "grp", "ord").withColumn("turn", F.floor(F.col("place") / TURN))
    ids = _placed(members.join(groups, "cls").select("cls", "id", "grp"), "cls", "id")
    none = lambda kind: F.lit(None).cast(kind)
    fields = "array<struct<alt:int,cls:bigint,score:bigint,loss:bigint,fits:boolean>>"
    packed = options.groupBy("kind").agg(F.collect_list(F.struct("alt", "cls", "score", "loss", "fits")).cast(fields).alias("options")).join(of_kind, "kind")
    packed = packed.select("grp", F.lit(1).alias("tag"), F.col("kind").alias("key"), none("long").alias("row"), none("long").alias("first"), none("array<long>").alias("ids"), "options", F.lit(0).cast("long").alias("at"))
    out = nothing
    taken = rows.sparkSession.createDataFrame([], "cls long, taken long")
    for turn in range((turns.agg(F.max("turn")).first()[0] or 0) + 1):
        known = ids.join(taken, "cls", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
        free = F.when((F.col("place") >= F.col("taken")) & (F.col("place") < F.col("taken") + TURN), F.col("id"))
        classes = known.groupBy("grp", "cls").agg(F.min("id").alias("first"), F.sort_array(F.collect_list(free)).alias("ids"))
        classes = classes.select("grp", F.lit(0).alias("tag"), F.col("cls").alias("key"), none("long").alias("row"), "first", "ids", none(fields).alias("options"), F.lit(0).cast("long").alias("at"))
        mine = turns.filter(F.col("turn") == turn).select("grp", F.lit(2).alias("tag"), F.col("kind").alias("key"), "row", none("long").alias("first"), none("array<long>").alias("ids"), none(fields).alias("options"), F.col("ord").cast("long").alias("at"))
        sorted_rows = classes.unionByName(packed).unionByName(mine).repartition("grp").sortWithinPartitions("grp", "tag", "at").drop("at")
        chosen = cut(sorted_rows.mapInArrow(_read_in_order, "row long, id long, cls long, fresh boolean"), "chosen")
        out = out.unionByName(chosen.select("row", "id"))
        taken = cut(taken.unionByName(chosen.filter("fresh").groupBy("cls").agg(F.count("*").alias("taken"))).groupBy("cls").agg(F.sum("taken").alias("taken")), "taken")
    return out


def link_words(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """(row, id): the entry of each row of a list, in the list's order, or null.

    wanted is (row, ord, headwords, pos, hint, level, homonym), headwords its
    alternatives in order; entries is (id, headword, pos, level, homonym,
    text). An entry's score is its fit of part of speech, hint, level and
    homonym number, less what an earlier claim takes; it must fit by part of
    speech or hint, or be its headword's only entry. A noun, verb or adjective
    that no alternative answers is tried as a derived verb or adjective, first
    by the ending that its hint shows.
    """
    e = entries.select("id", "headword", F.col("pos").alias("epos"), F.col("level").alias("elevel"), F.col("homonym").alias("ehom"), F.coalesce("text", F.lit("")).alias("text"))
    alone = e.groupBy("headword").agg((F.count("*") == 1).alias("alone"))
    e = e.join(alone, "headword")
    asked = wanted.select("row", "pos", "hint", "level", "homonym", F.get("headwords", F.lit(0)).alias("main"), F.posexplode("headwords").alias("alt", "headword"))
    same_level = F.coalesce(F.floor((F.col("level") + 1) / 2) == F.col("elevel"), F.lit(False))
    part = lambda on, n: F.when(on, n).otherwise(0)
    found = asked.join(e, "headword").withColumn("fit", pos_fit(F.col("pos"), F.col("epos"))).withColumn("shown", hint_score(F.col("hint"), F.col("main"), F.col("text")))
    score = F.col("fit") + HINT * F.col("shown") + part(same_level, LEVEL) + part(F.coalesce(F.col("homonym") == F.col("ehom"), F.lit(False)), HOMONYM)
    direct = found.select("row", "alt", "id", score.alias("score"), F.lit(CLAIMED).alias("loss"), ((F.col("fit") >= FIT) | (F.col("shown") >= HINT_FIT) | F.col("alone")).alias("fits"))
    # derived words come behind all alternatives; a claim outweighs the level, and that the hint
    nominal = F.col("pos").rlike("(명사|동사|형용사)")
    derived = None
    for k, end in enumerate(DERIVED):
        word = F.concat(F.col("main"), F.lit(end))
        place = F.when(F.contains(F.coalesce("hint", F.lit("")), word), 1000 + k).otherwise(2000 + k)
        own = asked.filter((F.col("alt") == 0) & nominal).select("row", "hint", "level", place.alias("alt"), word.alias("headword")).join(e.filter(F.col("epos").isin("verb", "adjective")), "headword")
        worth = part(same_level, 100) + hint_score(F.col("hint"), F.col("headword"), F.col("text"))
        own = own.select("row", "alt", "id", worth.alias("score"), F.lit(1000).alias("loss"), F.lit(True).alias("fits"))
        derived = own if derived is None else derived.unionByName(own)
    return choose(wanted.select("row", "ord"), direct.unionByName(derived))


# Queries: parts of odd number as a list, those of even number as entries; many share a name.

def _kinds(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, options and members: of each wanted part, parts of its name, or else of its name's last word in another name; scored by type, brand and size."""
    p = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_name").alias("n"), F.col("p_type").alias("t"), F.col("p_brand").alias("b"), (F.col("p_size") % 3).alias("z"))
    # wanted parts and entries of one name, type, brand and remainder of the size are alike
    alike = p.groupBy("n", "t", "b", "z").agg(F.sum((F.col("id") % 2 == 0).cast("int")).alias("entries"), F.sum((F.col("id") % 2 == 1).cast("int")).alias("rows"))
    alike = cut(alike.withColumn("kind", F.monotonically_increasing_id()), "alike")
    named = p.join(alike, (p["n"].eqNullSafe(alike["n"])) & p["t"].eqNullSafe(alike["t"]) & p["b"].eqNullSafe(alike["b"]) & p["z"].eqNullSafe(alike["z"])).select("id", "kind")
    alone = alike.groupBy("n").agg((F.sum("entries") == 1).alias("alone"))
    e = alike.filter("entries > 0").join(alone, "n").select("n", "alone", F.col("kind").alias("cls"), F.col("t").alias("et"), F.col("b").alias("eb"), F.col("z").alias("ez"))
    keys = F.array(F.col("n"), F.concat(F.lit("old "), F.element_at(F.split("n", " "), -1)))
    w = alike.filter("rows > 0").select("kind", "t", "b", "z", F.posexplode(keys).alias("alt", "n"))
    part = lambda on, n: F.when(on, n).otherwise(0)
    x = w.join(e, "n").withColumn("fit", part(F.col("t") == F.col("et"), 40)).withColumn("shown", part(F.col("b") == F.col("eb"), 3))
    score = F.col("fit") + HINT * F.col("shown") + part(F.col("z") == F.col("ez"), LEVEL)
    options = x.select("kind", "alt", "cls", score.cast("long").alias("score"), F.lit(CLAIMED).cast("long").alias("loss"), ((F.col("fit") >= FIT) | (F.col("shown") >= HINT_FIT) | F.col("alone")).alias("fits"))
    rows = named.filter("id % 2 = 1").select(F.col("id").alias("row"), F.col("id").alias("ord"), "kind")
    return rows, options, named.filter("id % 2 = 0").select(F.col("kind").alias("cls"), "id")


@query(
    "jn22_claims",
    """WITH RECURSIVE w AS MATERIALIZED (SELECT CAST(p_partkey AS BIGINT) AS row, p_name, string_split(p_name, ' ')[-1] AS last, p_type, p_brand, p_size, row_number() OVER (ORDER BY p_partkey) AS k FROM part WHERE p_partkey % 2 = 1),
e AS (SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS n, p_type AS t, p_brand AS b, p_size % 3 AS z, count(*) OVER (PARTITION BY p_name) = 1 AS alone FROM part WHERE p_partkey % 2 = 0),
a AS (SELECT w.*, u.alt, u.n FROM w, LATERAL (SELECT unnest([0, 1]) AS alt, unnest([w.p_name, 'old ' || w.last]) AS n) u),
o AS MATERIALIZED (SELECT k, alt, id, CASE WHEN t = p_type THEN 40 ELSE 0 END + 5 * CASE WHEN b = p_brand THEN 3 ELSE 0 END + CASE WHEN p_size % 3 = z THEN 8 ELSE 0 END AS score,
  t = p_type OR b = p_brand OR alone AS fits FROM a JOIN e USING (n)),
l AS MATERIALIZED (SELECT k, list({'alt': alt, 'id': id, 'score': score, 'fits': fits}) AS os FROM o GROUP BY k),
r AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS claimed, CAST(NULL AS BIGINT) AS id
  UNION ALL SELECT k, CASE WHEN id IS NULL OR list_contains(claimed, id) THEN claimed ELSE list_append(claimed, id) END, id FROM (
    SELECT r.k + 1 AS k, r.claimed, (SELECT min({'alt': b.alt, 'id': b.id}) FROM (SELECT x.alt, arg_min({'id': x.id, 'fits': x.fits}, {'c': CASE WHEN list_contains(r.claimed, x.id) THEN 15 ELSE 0 END - x.score, 'id': x.id}) AS best
      FROM (SELECT unnest(l.os, recursive := true)) x GROUP BY x.alt) g, LATERAL (SELECT g.alt, g.best.id AS id, g.best.fits AS fits) b WHERE b.fits).id AS id
    FROM r LEFT JOIN l ON l.k = r.k + 1 WHERE r.k < (SELECT max(k) FROM w)))
SELECT w.row, r.id FROM r JOIN w USING (k)""",
)
def claims_query(spark, d):
    return choose_alike(*_kinds(spark, d))

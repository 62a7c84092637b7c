"""A Merkle tree over a dataset, with a proof for every row.

A row's leaf is the digest of its fields. The leaves of a group (a source) are
numbered in order by ranges of their keys, so no task holds a group; a level's
runs are its nodes with the same number divided by the fanout, and the digest
of a run's children, in order, is its parent, numbered by the run. The groups'
last nodes are the leaves of one more such tree. Proofs go the other way: each
run is joined to the siblings that its parent has collected from the root
down, and its children add their own. So long lists of siblings exist once for
each run of leaves, and no row of the table carries one through a shuffle.

Plans are DataFrame functions only. Levels are tables in the shared folder;
there are as many as the fanout's powers up to the largest group.

Defined results: a null field is ``-``. Rows without an id come first in their
source; ids that tie are ordered by their leaf, and rows that repeat every field
are leaves of their own with the same digest. A null source is the first group. A row
without an id has no decimal id and is not tampered with. A table without rows
gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossarium.llm.common import cut, uncut
from glossarium.operators.numbering import numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Tree:
    fanout: int = 16
    group: str = "source"
    order: str = "doc_id"
    fields: tuple[str, ...] = FIELDS


def digest(c: Column) -> Column:
    return F.sha2(c, 256)


def field(c: Column) -> Column:
    """- for null, else the number of bytes, a colon and the value."""
    value = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(values: dict[str, Column]) -> Column:
    return digest(F.concat(*(field(v) for v in values.values())))


def with_leaves(docs: DataFrame, how: Tree) -> DataFrame:
    """(id, g, leaf, tampered): g is the group as a string that sorts null first; tampered is null where the row is left as it is."""
    values = {c: F.col(f"`{c}`") for c in how.fields}
    low = values | ({"text": F.translate(values["text"], UPPER, LOWER)} if "text" in values else {})
    ident = values[how.order].cast("string")
    chosen = F.crc32(ident.cast("binary")) % 5 == 0  # null for a null id
    group = values[how.group].cast("string")
    g = F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), group))
    return docs.select(values[how.order].alias("id"), g.alias("g"), leaf(values).alias("h"), F.when(chosen, leaf(low)).alias("tampered"))


def levels_up(nodes: DataFrame, most: int, fanout: int, carry: tuple[str, ...] = ()) -> tuple[list[DataFrame], list[DataFrame]]:
    """The runs of each level, and each level's groups that have one node left, as (g, h).

    nodes is (g, idx, n, h): n is the number of nodes of the group, most the
    largest n. The first level's children keep the columns ``carry``.
    """
    levels, tops = [], [nodes.filter("n = 1").select("g", "h")]
    while most > 1:
        kids = F.sort_array(F.collect_list(F.struct("idx", "h", *carry)))
        runs = nodes.filter("n > 1").groupBy("g", (F.col("idx") / fanout).cast("long").alias("run")).agg(F.max("n").alias("n"), kids.alias("kids"))
        runs = cut(runs.withColumn("h", digest(F.array_join(F.col("kids.h"), ""))), f"runs{len(levels)}")
        levels.append(runs)
        nodes = runs.select("g", F.col("run").alias("idx"), F.ceil(F.col("n") / fanout).alias("n"), "h")
        tops.append(nodes.filter("n = 1").select("g", "h"))
        most, carry = -(-most // fanout), ()
    return levels, tops


def siblings(at: Column, kids: Column) -> Column:
    """The digests of the run's other nodes, left and right of the one at this place."""
    hs = kids.getField("h")
    left = F.array_join(F.slice(hs, F.lit(1), at), "")
    right = F.array_join(F.slice(hs, at + 2, F.greatest(F.size(hs) - at - 1, F.lit(0))), "")
    return F.struct(left.alias("left"), right.alias("right"))


def step_down(runs: DataFrame, paths: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(g, idx, path, top, and ``keep`` of each child): paths is (g, idx, path, top) of the runs' parents."""
    up = paths.select(F.col("g").alias("pg"), F.col("idx").alias("pi"), "path", "top")
    each = runs.join(up, (F.col("g") == F.col("pg")) & (F.col("run") == F.col("pi"))).select("g", "path", "top", "kids", F.posexplode("kids").alias("at", "kid"))
    path = F.concat(F.array(siblings(F.col("at"), F.col("kids"))), "path")
    return each.select("g", F.col("kid.idx").alias("idx"), path.alias("path"), "top", *(F.col(f"kid.{c}").alias(c) for c in keep))


def paths_down(levels: list[DataFrame], tops: list[DataFrame], above: DataFrame) -> DataFrame:
    """(g, idx, path, top) of the nodes of the second level, or of the last where that comes first; above is (g, path, top) of the groups."""

    def ends(k: int) -> DataFrame:
        return tops[k].select("g").join(above, "g").select("g", F.lit(0).cast("long").alias("idx"), "path", "top")

    paths = ends(len(levels))
    for k in range(len(levels) - 1, 0, -1):
        paths = cut(step_down(levels[k], paths).unionByName(ends(k)), f"paths{k}")
    return paths


def manifest(docs: DataFrame, how: Tree = Tree()) -> DataFrame:
    """One row for each row of docs: leaf, subroot of its group, root, digest of its siblings, and the root folded from its leaf, tampered with or not."""
    leaves = cut(with_leaves(docs, how), "leaves")
    at = numbered(leaves, ["id", "h", "tampered"], by=["g"], name="idx", total="n")
    nodes = cut(at, "nodes")
    most = nodes.agg(F.max("n").alias("n")).first()["n"] or 0
    levels, tops = levels_up(nodes, most, how.fanout, ("id", "tampered"))

    # the groups' last nodes are the leaves of the tree above
    subroots = None
    for t in tops:
        subroots = t if subroots is None else subroots.unionByName(t)
    groups = cut(numbered(subroots.select(F.col("g").alias("of"), F.lit("").alias("g"), "h"), ["of"], name="idx", total="n"), "groups")
    count = groups.count()
    over, last = levels_up(groups, count, how.fanout, ("of",))
    empty = F.array().cast("array<struct<left:string,right:string>>")
    root = last[-1].select("h").first()
    root = F.lit(root["h"] if root else None)
    here = groups.sparkSession.createDataFrame([("", 0)], "g string, idx long").select("g", "idx", empty.alias("path"), F.lit("").alias("top"))
    if over:
        for k in range(len(over) - 1, 0, -1):
            here = step_down(over[k], here)
        # the group's own last node travels with its path
        above = step_down(over[0], here, ("of", "h")).select(F.col("of").alias("g"), "path", F.col("h").alias("top"))
    else:
        above = groups.select(F.col("of").alias("g"), empty.alias("path"), F.col("h").alias("top"))
    above = cut(above, "above")

    alone = nodes.filter("n = 1").join(above, "g").select("g", "idx", "path", "top", "id", "h", "tampered")
    if levels:
        alone = alone.unionByName(step_down(levels[0], paths_down(levels, tops, above), ("id", "h", "tampered")))
    proof = digest(F.array_join(F.transform("path", lambda x: F.concat(x.left, x.right)), ""))
    folded = F.aggregate("path", F.coalesce("tampered", "h"), lambda acc, x: digest(F.concat(x.left, acc, x.right)))
    out = alone.select(F.col("id").alias(how.order), F.col("h").alias("leaf"), F.col("top").alias("subroot"), root.alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    uncut(leaves)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return manifest(docs.select(*(F.col(c) for c in FIELDS)))


def _oracle(levels: int = 7, above: int = 4) -> str:
    """SQL of the manifest for groups of up to 16 ** levels rows and 16 ** above groups."""
    text = """
tab AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
f AS (SELECT doc_id, source, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head, text,
  xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS INT), 1)) AS BIGINT))),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 5 = 0 AS chosen
  FROM documents, tab),
l AS (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '+' || source END AS g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h,
  CASE WHEN chosen THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS tampered FROM f),
a0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM l),
d0 AS (SELECT doc_id, g, h AS leaf, h AS same, coalesce(tampered, h) AS acc, '' AS proof, idx, n FROM a0)"""

    def tree(nodes: str, rows: str, steps: int, prefix: str) -> tuple[str, str, str]:
        out = ""
        for k in range(steps):
            out += f""",
{prefix}r{k} AS MATERIALIZED (SELECT g, idx // 16 AS run, max(n) AS n, list(h ORDER BY idx) AS hs FROM {nodes} GROUP BY g, idx // 16),
{prefix}n{k} AS MATERIALIZED (SELECT g, run AS idx, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {prefix}r{k}),
{prefix}d{k} AS MATERIALIZED (SELECT d.* EXCLUDE (acc, proof, idx, n),
  CASE WHEN d.n = 1 THEN acc ELSE sha256(array_to_string(hs[1:d.idx % 16], '') || acc || array_to_string(hs[d.idx % 16 + 2:], '')) END AS acc,
  CASE WHEN d.n = 1 THEN proof ELSE proof || array_to_string(hs[1:d.idx % 16], '') || array_to_string(hs[d.idx % 16 + 2:], '') END AS proof,
  d.idx // 16 AS idx, (d.n + 15) // 16 AS n FROM {rows} d JOIN {prefix}r{k} r ON r.g = d.g AND r.run = d.idx // 16)"""
            nodes, rows = f"{prefix}n{k}", f"{prefix}d{k}"
        return out, nodes, rows

    lower, nodes, rows = tree("a0", "d0", levels, "x")
    text += lower
    text += f""",
s0 AS MATERIALIZED (SELECT g AS grp, '' AS g, h, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM {nodes}),
e0 AS (SELECT d.doc_id, d.leaf, s.h AS subroot, d.acc, d.proof, '' AS g, s.idx, s.n FROM {rows} d JOIN s0 s ON s.grp = d.g)"""
    upper, nodes, rows = tree("s0", "e0", above, "y")
    return f"WITH {text.strip()}{upper}\nSELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = t.h AS verified FROM {rows} d, {nodes} t"


ORACLE_SQL = _oracle()

"""Jaccard join of word n-gram sets in metric space.

Jaccard distance is a metric, and sets within r of each other obey the
triangle inequality about any third set, the pivot. Equal sets are one point.

1. Candidates. Sets within r share k of their first n - ceil((1 - r) n) + k
   elements in any common order of elements; rarer elements come first in the
   order used (rarity from a bounded sample; the order affects speed only).
   With k = n - ceil((1 - r) n) + 1, a Bloom filter of the elements that occur
   twice tells which sets can't have a partner, as too few of those elements
   occur in any other set; the same is asked once more among the sets left. A
   set's partner may have those k elements further back, so each set puts as
   many of its own into the filter as its largest admissible partner may need.
2. Pivots. With k = 1, each element that several sets have names a pivot, the
   least set that has it. Sets with no such element are linked to nothing.
3. Regions. A set belongs to the region of every pivot that one of its
   elements names, so two sets within r meet in a region.
4. A region joins itself recursively: distances to its pivot link all sets
   within r to it, then split the region at the median into a near and a far
   part, each with the sets whose distance lies within r of the split. Small
   parts, and parts that do not split, are compared set by set, but only where
   distances to the pivot differ by r at most and no path links the two yet.
5. Regions too large for one task are dealt to buckets, each with the pivot.
   Only sets that no path links to their region's pivot then are compared
   with the other buckets.
6. Links make components.

No list of all pairs exists anywhere, and no group of unbounded size is in one
task. Distances are computed from whole sets of 64-bit hashes of n-grams.

Defined results: null, empty and blank texts have the empty set, are linked
with nothing and are their own component; rows that repeat a text share a
component; a component's id ignores null ids, and is null where it has no
other; a null doc_id keeps its row; a table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossarium.llm.common import cut, id_and_text, join_hot, per_row, slices, uncut, with_key
from glossarium.llm.components import components
from glossarium.llm.two_bloom import key_filter, repeated_alone


@dataclass(frozen=True)
class Join:
    words: int = 4
    #: Linked when 100 * intersection >= percent * union.
    percent: int = 85
    #: The order of elements is learnt from about so many documents, and knows so many frequent elements at most.
    sample_docs: int = 4000
    frequent: int = 200_000
    #: A task gets regions of at most so many sets, and elements in them; larger ones are dealt to buckets.
    region_sets: int = 1000
    region_elements: int = 2_000_000
    #: Most positions of the Bloom filters.
    bits: int = 1 << 27
    #: Most positions of the filters of rows that stay and that go.
    row_bits: int = 1 << 26


_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def shingles(text: str | None, words: int) -> np.ndarray:
    """The set of hashed word n-grams, sorted; with fewer words, one element for all of them."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    if n < words:
        return np.array([digest(b"\x00".join(found), n)], np.uint64)
    h = np.fromiter(map(digest, found), np.uint64, n)
    out = np.zeros(n - words + 1, np.uint64)
    for k in range(words):
        out = (out ^ h[k : n - words + 1 + k]) * _M[k % 4]
        out ^= out >> np.uint64(31)
    return np.unique(out)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def partner_length(n: int, percent: int) -> int:
    """How many first elements are looked at for a partner; a partner shares shared_length of them."""
    return min(n, 2 * prefix_length(n, percent) - 1)


def shared_length(n: int, percent: int) -> int:
    """How many of its looked-at elements a set shares with a partner at least; all that they must share where that is fewer."""
    return min(prefix_length(n, percent), -(-percent * n // 100))


def offered_length(n: int, percent: int) -> int:
    """How many first elements go into the filters: those that a partner of any admissible size may look for.

    The k-th shared element is at most k + prefix_length(n) - 1 elements from
    the start, and k is the prefix_length of the partner, which grows with it.
    """
    return min(n, prefix_length(n, percent) + prefix_length(100 * n // percent, percent) - 1)


def in_order(elements: np.ndarray, frequent: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Elements by rising frequency, then by hash. frequent is sorted; times belong to it."""
    if not len(frequent):
        return elements
    at = np.minimum(np.searchsorted(frequent, elements), len(frequent) - 1)
    return elements[np.argsort(np.where(frequent[at] == elements, times[at], 0), kind="stable")]


class Region:
    """Sets as one ragged array of numbered elements, with a label of its component for each."""

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray, percent: int):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.percent, self.r = percent, 1 - percent / 100 + 1e-9
        values, self.numbers = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(values), bool)
        self.labels = labels.copy()
        self.links: list[tuple[int, int]] = []

    def shared(self, x: int, rows: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set x with the sets rows."""
        own = self.numbers[self.starts[x] : self.starts[x] + self.sizes[x]]
        self.mark[own] = True
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1]) + np.repeat(self.starts[rows] - ends + sizes, sizes)
        out = np.add.reduceat(self.mark[self.numbers[place]].astype(np.int32), ends - sizes)
        self.mark[own] = False
        return out

    def link(self, x: int, rows: np.ndarray) -> None:
        for y in rows:
            a, b = self.labels[x], self.labels[y]
            if a != b:
                self.links.append((x, int(y)))
                self.labels[self.labels == b] = a

    def compare(self, x: int, rows: np.ndarray) -> np.ndarray:
        """Distances from x to the sets rows; those that count as linked are linked."""
        both = self.shared(x, rows)
        union = self.sizes[x] + self.sizes[rows] - both
        self.link(x, rows[100 * both >= self.percent * union])
        return 1 - both / union

    def one_by_one(self, rows: np.ndarray, far: np.ndarray, others: np.ndarray | None = None) -> None:
        """Compare the sets rows with each other, or with the sets others; far holds distances to one pivot."""
        for k, x in enumerate(rows):
            them = rows[k + 1 :] if others is None else others
            near = np.abs(far[them] - far[x]) <= self.r
            like = 100 * np.minimum(self.sizes[them], self.sizes[x]) >= self.percent * np.maximum(self.sizes[them], self.sizes[x])
            them = them[near & like & (self.labels[them] != self.labels[x])]
            if len(them):
                self.compare(x, them)

    def join(self, rows: np.ndarray, pivot: int, leaf: int = 64) -> None:
        far = np.zeros(len(self.sizes))
        far[rows] = self.compare(pivot, rows)
        if len(np.unique(self.labels[rows])) == 1:
            return
        split = np.median(far[rows])
        near, rest = rows[far[rows] <= split + self.r], rows[far[rows] >= split - self.r]
        if len(rows) <= leaf or max(len(near), len(rest)) > 0.9 * len(rows):
            self.one_by_one(rows, far)
            return
        self.join(near, int(near[np.argmin(far[near])]), leaf)
        self.join(rest, int(rest[np.argmax(far[rest])]), leaf)


def shingle_table(docs: DataFrame, how: Join, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The columns of docs but for the text, with n_shingles, digest of the set, and its first elements in order."""
    held = docs.sparkSession.sparkContext.broadcast(order)  # how.frequent elements at most

    def task():
        frequent, times = held.value

        def make(texts: list) -> Iterator[tuple]:
            for text in texts:
                x = shingles(text, how.words)
                first = in_order(x, frequent, times)[: offered_length(len(x), how.percent)] if len(x) else x
                yield len(x), xxhash.xxh3_128_digest(x.tobytes()), first.view(np.int64)

        return make

    return per_row(docs, task, "n_shingles long, digest binary, first array<long>", keep=[c for c in docs.columns if c != "text"])


def element_order(docs: DataFrame, how: Join) -> tuple[np.ndarray, np.ndarray]:
    """Elements that several documents of a bounded sample have, sorted, and how many have them."""
    step = max(1, docs.count() // how.sample_docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"e": np.concatenate([np.zeros(0, np.uint64), *(shingles(t, how.words) for t in pdf["text"])]).view(np.int64)})

    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).select("text")
    counted = sample.mapInPandas(run, "e long").groupBy("e").count().filter("count >= 4")
    rows = counted.orderBy(F.desc("count"), "e").limit(how.frequent).collect()
    e = np.array([r["e"] for r in rows], np.int64).view(np.uint64)
    by = np.argsort(e)
    return e[by], np.array([r["count"] for r in rows], np.int64)[by]


def mixed(first: pd.Series) -> np.ndarray:
    """All the elements of these arrays, hashed once more for a filter."""
    x = np.concatenate([np.zeros(0, np.int64), *first]).astype(np.int64).view(np.uint64)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)


def with_partner(points: DataFrame, how: Join) -> DataFrame:
    """The rows (n, first, and more) that may have a partner among them, copies of one set included."""
    size = points.agg(F.sum(F.size("first")).alias("n")).first()["n"] or 0
    known = repeated_alone(points.select("first"), lambda pdf: mixed(pdf["first"]), size, how.bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                sizes = pdf["first"].map(len).to_numpy()
                starts = np.cumsum(sizes) - sizes
                looked = np.arange(sizes.sum()) - np.repeat(starts, sizes) < np.repeat([partner_length(n, how.percent) for n in pdf["n"]], sizes)
                found = np.add.reduceat((known.has(mixed(pdf["first"])) & looked).astype(np.int64), starts)
                yield pdf[found >= [shared_length(n, how.percent) for n in pdf["n"]]]

    out = cut(points.mapInPandas(run, points.schema), "partners")
    known.destroy()
    return out


def region_links(members: DataFrame, how: Join) -> DataFrame:
    """Links (a, b) inside each group (pivot, bucket) of members (pivot, bucket, node, elements)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node")
        nodes = pdf["node"].to_numpy()
        region = Region([np.frombuffer(x, np.uint64) for x in pdf["elements"]], np.arange(len(nodes)), how.percent)
        pivot = int(np.nonzero(nodes == pdf["pivot"].iloc[0])[0][0])
        region.join(np.arange(len(nodes)), pivot)
        return pd.DataFrame([(nodes[x], nodes[y]) for x, y in region.links], columns=["a", "b"], dtype=np.int64)

    return members.groupBy("pivot", "bucket").applyInPandas(run, "a long, b long")


def cross_links(groups: DataFrame, how: Join) -> DataFrame:
    """Links between open sets and the others of each group (pivot, bucket, chunk); label says what is linked already."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["node", "open"]).reset_index(drop=True)
        nodes = pdf["node"].to_numpy()
        region = Region([np.frombuffer(x, np.uint64) for x in pdf["elements"]], pdf["label"].to_numpy(), how.percent)
        mine = np.nonzero(pdf["open"].to_numpy())[0]
        region.one_by_one(mine, np.zeros(len(nodes)), np.nonzero(~pdf["open"].to_numpy())[0])
        return pd.DataFrame([(nodes[x], nodes[y]) for x, y in region.links], columns=["a", "b"], dtype=np.int64)

    return groups.groupBy("pivot", "bucket", "chunk").applyInPandas(run, "a long, b long")


def placed_nodes(regions: DataFrame, parts: DataFrame) -> DataFrame:
    """The nodes of regions that have more than one member."""
    return join_hot(regions.select("node", "pivot"), parts, "pivot", "members").select("node").distinct()


def sets_of(docs: DataFrame, wanted: DataFrame, how: Join) -> DataFrame:
    """(node, elements) for wanted (node, rep, digest). A filter of the wanted ids spares the other texts; no text is moved."""
    known = key_filter(wanted.select(F.xxhash64("rep").alias("k")), "k", how.bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                part = part.filter(pa.array(known.has(part.column("k").to_numpy().view(np.uint64))))
                sets = [shingles(t, how.words).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(xxhash.xxh3_128_digest, sets), pa.binary()), pa.array(sets, pa.binary())], names=["doc_id", "digest", "elements"])

    made = docs.select("doc_id", F.xxhash64("doc_id").alias("k"), "text").mapInArrow(run, "doc_id long, digest binary, elements binary")
    same = made["doc_id"].eqNullSafe(wanted["rep"]) & (made["digest"] == wanted["digest"])  # a doc_id may have several texts
    return made.join(wanted, same).select("node", "elements").dropDuplicates(["node"])


def row_components(docs: DataFrame, how: Join) -> DataFrame:
    """For docs (doc_id, text, and more): all but the text, n_shingles, component_id, and component, a number that is null without words."""
    table = cut(shingle_table(docs, how, element_order(docs, how)), "shingles")
    points = table.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"))
    points = cut(points.withColumn("node", F.monotonically_increasing_id()), "points")

    # first elements of one row of each set, and of the few more that the filter lets pass, are looked at where they lie
    one = key_filter(points.select(F.xxhash64("digest", "rep").alias("k")), "k", how.row_bits)
    rows = table.filter("n_shingles > 0").filter(one.maybe(F.xxhash64("digest", "doc_id"))).select("digest", F.col("n_shingles").alias("n"), "first")
    some = with_partner(rows, how)
    one.destroy()
    wide, table = table, cut(table.drop("first"), "rows")
    uncut(wide)
    found = with_partner(some, how)
    uncut(some)
    least_first = F.slice("first", 1, (F.col("n") + F.floor(F.lit(-how.percent) * F.col("n") / 100) + 1).cast("int"))
    chosen = found.select("digest", "n", least_first.alias("first")).dropDuplicates(["digest"])
    chosen = cut(chosen.join(points.select("digest", "node", "rep"), "digest"), "chosen")
    uncut(found)
    elements = chosen.select("node", F.explode("first").alias("e"))
    named = cut(elements.groupBy("e").agg(F.count("*").alias("sets"), F.min("node").alias("pivot")).filter("sets > 1"), "named")
    regions = cut(join_hot(elements, named, "e", "sets").select("node", "pivot").distinct().join(chosen.select("node", "n"), "node"), "regions")
    parts = regions.groupBy("pivot").agg(F.greatest(F.ceil(F.count("*") / how.region_sets), F.ceil(F.sum("n") / how.region_elements), F.lit(1)).cast("int").alias("buckets"), F.count("*").alias("members"))
    parts = cut(parts.filter("members > 1"), "parts")

    wanted = cut(placed_nodes(regions, parts).join(chosen.select("node", "rep", "digest"), "node"), "wanted")
    sets = cut(sets_of(docs, wanted, how), "sets")

    placed = join_hot(regions.select("node", "pivot"), parts, "pivot", "members")
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("node"), F.col("buckets")).cast("int"))
    pivots = parts.select(F.col("pivot").alias("node"), "pivot", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"))
    dealt = placed.filter("node != pivot").select("node", "pivot", "bucket").unionByName(pivots)
    links = cut(region_links(dealt.join(sets, "node"), how), "links")
    labels = components(links)

    large = placed.filter("buckets > 1").select("node", "pivot", "bucket", "buckets")
    if large.limit(1).count():
        own = large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        of_pivot = parts.filter("buckets > 1").select("pivot").join(labels.select(F.col("node").alias("pivot"), F.col("label").alias("_main")), "pivot", "left")
        of_pivot = of_pivot.select("pivot", F.coalesce("_main", "pivot").alias("_main"))
        own = cut(own.join(of_pivot, "pivot").withColumn("open", F.col("label") != F.col("_main")), "large")
        # open sets of a region, dealt to chunks of bounded size, meet every bucket of it
        chunks = own.filter("open").groupBy("pivot").agg(F.ceil(F.count("*") / how.region_sets).cast("int").alias("chunks"))
        fresh = own.filter("open").join(chunks, "pivot").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int"))
        fresh = fresh.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
        rest = own.join(chunks, "pivot").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("open", F.lit(False))
        names = ["node", "pivot", "bucket", "chunk", "label", "open"]
        more = cross_links(fresh.select(*names).unionByName(rest.select(*names)).join(sets, "node"), how)
        more = cut(more, "more")
        if more.limit(1).count():
            old, labels = labels, components(links.unionByName(more))
            uncut(old)
        uncut(own, more)

    named_points = points.select("node", "digest", "rep", "copies").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = labels.join(points.select("node", "rep"), "node").groupBy("label").agg(F.min("rep").alias("least"))
    ids = cut(named_points.join(least, "label", "left").select("digest", "copies", F.coalesce("least", "rep").alias("component_id"), F.col("label").alias("component")), "ids")
    uncut(points, chosen, named, regions, parts, wanted, sets, links, labels)
    more = [c for c in docs.columns if c != "text"]
    full = join_hot(table.filter("n_shingles > 0").select(*more, "n_shingles", "digest"), ids, "digest", "copies")
    empty = table.filter("n_shingles = 0").select(*more, "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    return full.select(*more, "n_shingles", "component_id", "component").unionByName(empty)


def jaccard_components(docs: DataFrame, how: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: the size of its set, and its component."""
    return row_components(id_and_text(docs, id_col, text_col), how).drop("component")


def one_of_each(docs: DataFrame, how: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (null comes last), then of the least SHA-256 of the text.

    Of rows that repeat doc_id and text, one stays; rows without words are in
    no component, and all of them stay. Rows stay or go by two filters, of
    the rows that stay and of those that go; only rows that both filters
    claim are moved, to be told apart for certain.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]  # further columns can't clash with those needed here
    plain = docs.toDF(*names)
    doc, text = (names[docs.columns.index(c)] for c in (id_col, text_col))
    rows = with_key(plain.select("*", F.col(doc).cast("long").alias("doc_id")), "doc_id", text)
    found = cut(row_components(rows.select("doc_id", "th", "key", F.col(text).alias("text")), how).select("doc_id", "th", "key", "component"), "members")
    best = found.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nul"), "doc_id", "th", "key")).alias("b"))
    stay = best.select("b.doc_id", "b.th", "b.key", F.lit(True).alias("one")).unionByName(found.filter("component IS NULL").select("doc_id", "th", "key", F.lit(False).alias("one")).distinct())
    stay = cut(stay, "stay")
    each = found.filter("component IS NOT NULL").groupBy("doc_id", "th", "key").agg(F.count("*").alias("n"))
    same = (each["key"] == stay["key"]) & (each["th"] == stay["th"]) & each["doc_id"].eqNullSafe(stay["doc_id"])
    again = each.join(stay.filter("one"), same, "left").filter(stay["key"].isNull() | (each["n"] > 1)).select(each["key"])
    go = cut(again, "go")  # rows that go, and those that stay once of several
    uncut(found)
    in_stay, in_go = (key_filter(x, "key", how.row_bits).maybe(F.col("key")) for x in (stay, go))
    sure = rows.filter(in_stay & ~in_go)
    other = stay.select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th"), F.col("key").alias("_key"), "one")
    match = (F.col("key") == F.col("_key")) & (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
    asked = rows.filter(in_stay & in_go).join(other, match)
    once = asked.filter("one").dropDuplicates(["doc_id", "th"])
    return sure.select(*names).unionByName(once.select(*names)).unionByName(asked.filter("NOT one").select(*names)).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute_force(rows: list[tuple[int | None, str | None]], words: int, percent: int) -> list[int | None]:
    """The component of each row by comparing every pair, for tests and small inputs."""
    import re

    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(k)] = min(doc, least.get(find(k), doc))
    return [least.get(find(k)) for k in range(len(rows))]

"""Resharding by minimum-cost flow.

The old shards and their bytes, and the capacities of the new shards, make a
network: each byte of an old shard flows to some new shard, for nothing where
the two are the same shard and at the price of one otherwise. A flow of least
cost moves the fewest bytes that any plan must move. The flow is then carried
out on blocks of rows: an old shard's rows stand in a fixed order, and its
flow cuts that order into runs, one for each new shard that takes from it.
Only shards that gain or lose rows need to be written again.

Only sums per block reach the driver: BLOCK_ROWS rows or so of one old shard
make a block, so a table of 10^10 rows in 10^4 shards has some 6 * 10^4 of
them. A row's block is a hash of the row's place too, so rows that repeat
spread over the blocks.

Defined results: a null text has no bytes, and every row counts one byte more
than its text; rows that repeat, and those with a null id, are placed one by
one; a table without rows gives a plan without moves. The law is ``bytes``:
with equal capacities the new shards' sizes differ from each other by at most
the largest row for each run that a shard takes.
"""

from __future__ import annotations

import re
import uuid
from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossarium.llm.common import cut, uncut

#: The scheme and slashes that a path begins with; they differ between what lists files and what reads them.
F_PATH = re.compile("^[a-z0-9]+:/*")
#: About so many rows make a block of an old shard.
BLOCK_ROWS = 200_000
#: Tables of the plan with more rows than this are joined by shuffle; a row has some hundred bytes at most.
BROADCAST_ROWS = 200_000


class Flow:
    """Successive shortest paths with small integer costs (Bellman-Ford by queue)."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        n = len(self.out)
        while True:
            far, via, waiting = [None] * n, [-1] * n, [False] * n
            far[source] = 0
            todo = deque([source])
            while todo:
                x = todo.popleft()
                waiting[x] = False
                for e in self.out[x]:
                    y = self.to[e]
                    if self.room[e] > 0 and (far[y] is None or far[x] + self.cost[e] < far[y]):
                        far[y], via[y] = far[x] + self.cost[e], e
                        if not waiting[y]:
                            waiting[y] = True
                            todo.append(y)
            if far[sink] is None:
                return
            push, y = None, sink
            while y != source:
                e = via[y]
                push = self.room[e] if push is None else min(push, self.room[e])
                y = self.to[e ^ 1]
            y = sink
            while y != source:
                e = via[y]
                self.room[e] -= push
                self.room[e ^ 1] += push
                y = self.to[e ^ 1]


def plan(old: list[int], capacities: list[int]) -> list[list[tuple[int, int]]]:
    """For each old shard, how many bytes go to which new shard: its own first, then by number.

    Shard k of old and of new are the same; the capacities must hold all
    bytes. Where an old shard has a new one of its own, that edge is free.
    Old shards beyond the new ones have no free edge, so those are joined to
    the new shards through one middle node, which keeps the network sparse.
    """
    if sum(capacities) < sum(old):
        raise ValueError("the new shards are too small")
    n, m = len(old), len(capacities)
    source, sink, middle = n + m, n + m + 1, n + m + 2
    net = Flow(n + m + 3)
    stay, leave, come = {}, {}, {}
    for i, size in enumerate(old):
        net.edge(source, i, size, 0)
        if i < m:
            stay[i] = net.edge(i, n + i, size, 0)
        leave[i] = net.edge(i, middle, size, 1)
    for j, size in enumerate(capacities):
        come[j] = net.edge(middle, n + j, size, 0)
        net.edge(n + j, sink, size, 0)
    net.run(source, sink)
    used = lambda e: net.room[e ^ 1]
    takes = deque([j, used(come[j])] for j in range(m) if used(come[j]))
    out: list[list[tuple[int, int]]] = []
    for i in range(n):
        own = [(i, used(stay[i]))] if i in stay and used(stay[i]) else []
        rest = used(leave[i])
        while rest:
            got = min(rest, takes[0][1])
            own.append((takes[0][0], got))
            rest -= got
            takes[0][1] -= got
            if not takes[0][1]:
                takes.popleft()
        out.append(own)
    return out


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def reshard(rows: DataFrame, shards: int, old_col: str = "old", capacities: list[int] | None = None) -> tuple[DataFrame, list[list[tuple[int, int]]]]:
    """Rows (doc_id, size, text_crc32 and old_col, the shard they are in; file and row, where they lie) with their new shard and slot; and the plan.

    A row belongs to the run that its first byte falls in. Slots of a shard
    number the rows that come from old shard 0, then 1, and so on.
    """
    spark = rows.sparkSession
    more = [c for c in ("file", "row") if c in rows.columns]
    rows = rows.select("doc_id", "size", "text_crc32", F.col(old_col).cast("int").alias("old"), *more).withColumn("_n", F.monotonically_increasing_id())
    counts = rows.groupBy("old").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.lit(1)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("doc_id", "text_crc32", "_n"), F.col("blocks")).cast("int")
    rows = cut(rows.join(counts, "old").withColumn("block", block).drop("_n", "blocks"), "sizes")
    sums = rows.groupBy("old", "block").agg(F.sum("size").alias("bytes")).orderBy("old", "block").collect()
    n_old = max((r["old"] for r in sums), default=-1) + 1
    sizes = [0] * n_old
    begins = []
    for r in sums:
        begins.append((r["old"], r["block"], sizes[r["old"]]))
        sizes[r["old"]] += r["bytes"]
    moves = plan(sizes, capacities or equal_capacities(sum(sizes), shards))
    runs, at = [], 0
    for i, own in enumerate(moves):
        at = 0
        for j, size in own:
            runs.append((i, at, at + size, j))
            at += size
    starts = small(spark, begins, "old int, block int, begin long")  # a row for each block
    runs_df = small(spark, runs, "old int, lo long, hi long, shard int")  # fewer rows than old and new shards together
    order = Window.partitionBy("old", "block").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("_sum", F.sum("size").over(order)).join(starts, ["old", "block"])
    placed = placed.withColumn("_at", F.col("begin") + F.col("_sum") - F.col("size"))
    placed = placed.join(runs_df, "old").filter("_at >= lo AND _at < hi").select("doc_id", "size", "text_crc32", "old", "block", "shard", "_at", *more)
    placed = cut(placed, "placed")
    uncut(rows)
    parts = placed.groupBy("shard", "old", "block").agg(F.count("*").alias("n")).orderBy("shard", "old", "block").collect()
    before: dict[int, int] = {}
    firsts = []
    for r in parts:
        firsts.append((r["shard"], r["old"], r["block"], before.get(r["shard"], 0)))
        before[r["shard"]] = before.get(r["shard"], 0) + r["n"]
    first_df = small(spark, firsts, "shard int, old int, block int, first long")  # a row for each block and run
    within = Window.partitionBy("old", "block", "shard").orderBy("_at")
    out = placed.withColumn("_k", F.row_number().over(within) - 1).join(first_df, ["shard", "old", "block"])
    return out.select("doc_id", "size", "text_crc32", "old", *more, "shard", (F.col("first") + F.col("_k")).alias("slot")), moves


def affected(moves: list[list[tuple[int, int]]]) -> set[int]:
    """Shards that gain or lose rows; the others' files stay as they are."""
    touched = set()
    for i, own in enumerate(moves):
        for j, _ in own:
            if i != j:
                touched |= {i, j}
    return touched


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows that the driver holds as a table, broadcast up to BROADCAST_ROWS of them."""
    out = spark.createDataFrame(rows, schema)
    return F.broadcast(out) if len(rows) <= BROADCAST_ROWS else out


def files_of(docs: DataFrame) -> DataFrame:
    """(path, file): the files of a table, numbered in order of their paths."""
    files = sorted(F_PATH.sub("/", f) for f in docs.inputFiles())
    return small(docs.sparkSession, list(zip(files, range(len(files)))), "path string, file int")


def placed_in_files(docs: DataFrame, columns: list) -> DataFrame:
    """These columns of docs with file and row, the file's number and the row's in it, which name a row for good."""
    if not docs.inputFiles():
        return docs.select(*columns, F.lit(0).alias("file"), F.monotonically_increasing_id().alias("row"))
    rows = docs.select(*columns, F.regexp_replace(F.input_file_name(), F_PATH.pattern, "/").alias("path"), F.col("_metadata.row_index").alias("row"))
    return rows.join(files_of(docs), "path").drop("path")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", old_col: str | None = None) -> DataFrame:
    """Id, size and checksum of each row, where it lies, and its old shard: old_col, or else the number in order of its file."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    old = [F.col(f"`{old_col}`").cast("int").alias("old")] if old_col else []
    rows = placed_in_files(docs, [F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *old])
    return rows if old else rows.withColumn("old", F.col("file"))


def rewrite(spark: SparkSession, root: str, placed: DataFrame, moves: list[list[tuple[int, int]]], shard_rows: int = 100_000) -> None:
    """Carry a plan out on a table of folders root/shard=k: write the shards that it touches anew, and leave the others' files alone.

    placed is what reshard() made of measured(docs, old_col="shard"). The new
    files are written beside the table first; then each touched folder is
    renamed away and its new one takes its name, so that rows are in one of
    the two at any time, whatever fails. The table's readers must wait for it.
    """
    touched = sorted(affected(moves))
    if not touched:
        return
    docs = spark.read.parquet(root)
    new = placed.filter(F.col("shard").isin(touched)).select("file", "row", F.col("shard").alias("_shard"), "slot")
    rows = placed_in_files(docs, [F.col(f"`{c}`") for c in docs.columns]).filter(F.col("shard").isin(touched)).drop("shard").join(new, ["file", "row"]).drop("file", "row")
    rows = rows.withColumnRenamed("_shard", "shard").withColumn("_part", F.floor(F.col("slot") / shard_rows))
    stem = uuid.uuid4().hex
    staged, aside = f"{root}/_next-{stem}", f"{root}/_old-{stem}"
    rows.repartition("shard", "_part").sortWithinPartitions("shard", "slot").drop("_part", "slot").write.partitionBy("shard").parquet(staged)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(aside))
    for k in touched:
        for source, target in ((f"{root}/shard={k}", f"{aside}/shard={k}"), (f"{staged}/shard={k}", f"{root}/shard={k}")):
            if fs.exists(path(source)) and not fs.rename(path(source), path(target)):
                raise OSError(f"{source} could not become {target}")
    fs.delete(path(staged), True)
    fs.delete(path(aside), True)


def query(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out, _ = reshard(measured(docs), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

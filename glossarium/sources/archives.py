"""Lines of archives, and stored replies that continue one another, as data sources.

A zip archive is planned as one partition for each member and range of members,
from its directory alone; a tar archive, which has none, as one partition that
streams. Patterns for the archive and the member are options, so members that
they leave out are never opened. (Filters are not pushed: two scans of one
DataFrame with different filters in one plan get the rows of one of them in
Spark 4.1.) Lines come as Arrow batches, so a task holds a batch and no member. Bytes that are no UTF-8 are replaced, and control
characters that no text format allows are dropped.

Paths are whatever pyarrow's file systems reach (local, HDFS, S3, ...), on the
driver for the plan and on the executors for the lines.
"""

from __future__ import annotations

import io
import json
import re
import tarfile
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from glossarium.plans.registry import query
from glossarium.plans.tables import ENTRIES, entries, table
from glossarium.sources.shared import own_dir

W = f"WITH {ENTRIES}"
LINES = "archive string, member string, n long, value string"
BATCH_LINES = 8192
#: Small members of a zip archive share a partition of about so many unpacked bytes.
PARTITION_BYTES = 32 << 20
_ZIP, _TAR = (".zip",), (".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tbz2", ".tar.xz")
#: Control characters but tab and the ends of lines.
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def clean(text: str) -> str:
    return _CONTROL.sub("", text)


def without_control(c: Column) -> Column:
    """A column of text without the control characters that no XML may hold."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def located(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub("^file:/+", "/", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def files_at(path: str, endings: tuple[str, ...]) -> list[str]:
    """The archive itself, or those of a folder by name."""
    system, name = located(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(name, recursive=True, allow_not_found=True))
    prefix = path.rstrip("/")
    return sorted(prefix + "/" + x.path[len(name.rstrip("/")) + 1 :] for x in found if x.is_file and x.path.lower().endswith(endings))


@dataclass
class Members(InputPartition):
    """Members of a zip archive by name, or with None all of a tar archive."""

    archive: str
    members: list[str] | None


class LinesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.archive, self.member = options["path"], options.get("archive", "*"), options.get("member", "*")

    def partitions(self) -> list[Members]:
        out: list[Members] = []
        for name in files_at(self.path, _ZIP + _TAR):
            if not fnmatchcase(name.rsplit("/", 1)[-1], self.archive):
                continue
            if not name.lower().endswith(_ZIP):
                out.append(Members(name, None))
                continue
            system, place = located(name)
            part, size = [], 0
            with zipfile.ZipFile(system.open_input_file(place)) as z:
                for info in z.infolist():
                    if not info.is_dir() and fnmatchcase(info.filename, self.member):
                        part.append(info.filename)
                        size += info.file_size
                        if size >= PARTITION_BYTES:
                            out.append(Members(name, part))
                            part, size = [], 0
            if part:
                out.append(Members(name, part))
        return out or [Members("", [])]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        system, place = located(partition.archive)
        name = partition.archive.rsplit("/", 1)[-1]
        if partition.members is not None:
            with zipfile.ZipFile(system.open_input_file(place)) as z:
                for member in partition.members:
                    with z.open(member) as f:
                        yield from batches(name, member, f)
            return
        with system.open_input_stream(place, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|*") as tar:
            for entry in tar:
                if entry.isfile() and fnmatchcase(entry.name, self.member):
                    yield from batches(name, entry.name, tar.extractfile(entry))


def batches(archive: str, member: str, raw: io.BufferedIOBase) -> Iterator[pa.RecordBatch]:
    """The member's lines, numbered from 1, some thousands at a time."""
    lines, first = [], 1

    def made() -> pa.RecordBatch:
        k = len(lines)
        return pa.RecordBatch.from_arrays([pa.array([archive] * k, pa.string()), pa.array([member] * k, pa.string()), pa.array(range(first, first + k), pa.int64()), pa.array(lines, pa.string())], names=["archive", "member", "n", "value"])

    for line in raw:
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        lines.append(clean(text.removeprefix("\ufeff") if first == 1 and not lines else text))
        if len(lines) == BATCH_LINES:
            yield made()
            first, lines = first + len(lines), []
    if lines:
        yield made()


class ArchiveLines(DataSource):
    """Lines of members of an archive or of a folder of archives; options path, and patterns archive and member."""

    @classmethod
    def name(cls) -> str:
        return "archive_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> LinesReader:
        return LinesReader(self.options)


def archive_lines(spark: SparkSession, path: str, member: str = "*", archive: str = "*") -> DataFrame:
    """(archive, member, n, value) of an archive or a folder of them, of names that the patterns fit."""
    spark.dataSource.register(ArchiveLines)
    return spark.read.format("archive_lines").options(path=path, member=member, archive=archive).load()


def write_zips(lines: DataFrame, folder: str) -> None:
    """Lines (member, n, value) as members of zip archives in a folder, one archive a task; a task that runs again writes the same file again."""

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, place = located(folder)
        system.create_dir(place, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}.zip"
        current, out, z = None, None, None
        with system.open_output_stream(f"{place}/{name}") as raw:
            buffer = io.BufferedWriter(_Stream(raw))
            z = zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED)
            for batch in rows:
                for member, value in zip(batch.column("member").to_pylist(), batch.column("value").to_pylist()):
                    if member != current:
                        if out:
                            out.close()
                        out, current = z.open(member, "w", force_zip64=True), member
                    out.write(((value or "") + "\n").encode("utf-8", "replace"))
            if out:
                out.close()
            z.close()
            buffer.flush()
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    lines.repartition("member").sortWithinPartitions("member", "n").select("member", "value").mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()


class _Stream(io.RawIOBase):
    """An output stream of pyarrow that can't be read or sought."""

    def __init__(self, raw):
        self.raw = raw

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.raw.write(bytes(data))
        return len(data)


# Formats in archives, with the rules of their widths

def kengdic_rows(lines: DataFrame) -> DataFrame:
    """(id, surface, hanja, gloss, level) of tab-separated lines (n, value): the header and rows of fewer than four columns are left out; empty cells and \\N are null."""
    cells = F.split("value", "\t")
    cell = lambda k: F.nullif(F.nullif(F.trim(F.get(cells, F.lit(k))), F.lit("")), F.lit("\\N"))
    rows = lines.filter((F.size(cells) >= 4) & (F.col("n") > 1))
    return rows.select(cell(0).try_cast("long").alias("id"), cell(1).alias("surface"), cell(2).alias("hanja"), cell(3).alias("gloss"), cell(4).alias("level")).filter("surface IS NOT NULL AND gloss IS NOT NULL")


def sentence_rows(lines: DataFrame, lang: str) -> DataFrame:
    """(id, text) of lines ``id lang text``, of one language; rows without an id or a text are left out."""
    cells = F.split("value", "\t", 3)
    rows = lines.select(F.get(cells, F.lit(0)).try_cast("long").alias("id"), F.get(cells, F.lit(1)).alias("lang"), F.trim(F.get(cells, F.lit(2))).alias("text"))
    return rows.filter((F.col("lang") == lang) & F.col("id").isNotNull() & (F.col("text") != "")).select("id", "text")


def link_rows(lines: DataFrame) -> DataFrame:
    """(id, other) of lines ``id other``."""
    cells = F.split("value", "\t")
    return lines.select(F.get(cells, F.lit(0)).try_cast("long").alias("id"), F.get(cells, F.lit(1)).try_cast("long").alias("other")).filter("id IS NOT NULL AND other IS NOT NULL")


# Stored replies of a wiki's interface

@dataclass
class Chain(InputPartition):
    """Replies that answer one question, a file for each, in the order of their names."""

    question: str
    files: list[str]


class RepliesReader(DataSourceReader):
    """A folder has a folder for each question; its replies follow one another by their continuation, and end with the one that has none."""

    def __init__(self, options: dict):
        self.path, self.list, self.question = options["path"], options.get("list", "allpages"), options.get("question", "*")

    def partitions(self) -> list[Chain]:
        chains: dict[str, list[str]] = {}
        for name in files_at(self.path, (".json",)):
            question = name.rsplit("/", 2)[-2]
            if fnmatchcase(question, self.question):
                chains.setdefault(question, []).append(name)
        return [Chain(q, names) for q, names in sorted(chains.items())] or [Chain("", [])]

    def read(self, partition: Chain) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, dict] = {}
        for name in partition.files:
            system, place = located(name)
            with system.open_input_stream(place) as f:
                try:
                    reply = json.loads(f.read())
                except ValueError:
                    continue
            asked = (reply.get("asked") or {}).get("continue") or ""
            waiting.setdefault(asked, reply)  # a reply that was fetched twice counts once
        key, n, complete = "", 0, False
        while key in waiting:
            reply = waiting.pop(key)
            found = [x.get("title") for x in (reply.get("query") or {}).get(self.list) or []]
            key = next(iter((reply.get("continue") or {}).values()), None)
            complete = key is None
            k = len(found)
            if k:
                yield pa.RecordBatch.from_arrays([pa.array([partition.question] * k, pa.string()), pa.array(range(n, n + k), pa.int64()), pa.array(found, pa.string()), pa.array([complete] * k, pa.bool_())], names=["question", "n", "title", "last"])
                n += k
            if complete:
                return


class StoredReplies(DataSource):
    """Titles that stored replies list (option list: allpages or search), question by question; options path and the pattern question."""

    @classmethod
    def name(cls) -> str:
        return "stored_replies"

    def schema(self) -> str:
        return "question string, n long, title string, last boolean"

    def reader(self, schema) -> RepliesReader:
        return RepliesReader(self.options)


def stored_replies(spark: SparkSession, path: str, listed: str = "allpages", question: str = "*") -> DataFrame:
    """(question, n, title, last): what the replies list, in order; last marks the titles of a chain's end, so that a question without one broke off."""
    spark.dataSource.register(StoredReplies)
    return spark.read.format("stored_replies").options(path=path, list=listed, question=question).load()


# Queries: tables written as archives and read again

def _written(spark, rows: DataFrame) -> str:
    folder = f"{own_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_zips(rows, folder)
    return folder


@query("src10_kengdic_archive", f"{W} SELECT id, headword AS surface, CASE WHEN id % 3 = 0 THEN kind END AS hanja, gloss, CASE WHEN id % 2 = 0 THEN CAST(level AS VARCHAR) END AS level FROM entries WHERE id % 7 > 0")
def kengdic_archive(spark, d):
    """Entries as tab-separated members of zip archives, a member a pack: with a control character, rows that are too short and a header."""
    e = entries(spark, d)
    row = F.concat_ws("\t", F.col("id").cast("string"), F.concat("headword", F.lit("\x07")), F.when(F.col("id") % 3 == 0, F.col("kind")).otherwise(""), "gloss", F.when(F.col("id") % 2 == 0, F.coalesce(F.col("level").cast("string"), F.lit("\\N"))).otherwise(""))
    rows = e.select(F.concat("pack", F.lit(".tsv")).alias("member"), F.col("id").alias("n"), F.when(F.col("id") % 7 == 0, F.concat_ws("\t", F.col("id").cast("string"), "headword")).otherwise(row).alias("value"))
    heads = e.select(F.concat("pack", F.lit(".tsv")).alias("member")).distinct().select("member", F.lit(-1).cast("long").alias("n"), F.lit("id\tsurface\thanja\tgloss\tlevel").alias("value"))
    return kengdic_rows(archive_lines(spark, _written(spark, rows.unionByName(heads)), "*.tsv"))


@query("src12_sentence_archive", "SELECT c.conv_id * 100 + c.turn AS id, c.conv_id * 100 + c.turn + 1 AS other, c.role FROM conversations c WHERE c.role = 'user' AND trim(regexp_replace(c.text, '\\s+', ' ', 'g')) <> ''")
def sentence_archive(spark, d):
    """Turns as sentences of two languages by role and links from each to the next, in one archive; members of links are never read for sentences."""
    c = table(spark, d, "conversations")
    key = F.col("conv_id") * 100 + F.col("turn")
    said = c.select(F.lit("sentences.csv").alias("member"), key.alias("n"), F.concat_ws("\t", key.cast("string"), "role", F.trim(F.regexp_replace("text", r"\s+", " "))).alias("value"))
    links = c.select(F.lit("links.csv").alias("member"), key.alias("n"), F.concat_ws("\t", key.cast("string"), (key + 1).cast("string")).alias("value"))
    folder = _written(spark, said.unionByName(links))
    own = sentence_rows(archive_lines(spark, folder, "sentences.csv"), "user").select("id").distinct()
    return own.join(link_rows(archive_lines(spark, folder, "links.csv")).distinct(), "id").select("id", "other", F.lit("user").alias("role"))

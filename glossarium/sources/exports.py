"""What leaves and enters a build as files: chunks with checksums, statistics, reports, tab-separated counts, catalogues, workbooks."""

from __future__ import annotations

import tomllib
import zipfile
from xml.etree import ElementTree

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossarium.plans.registry import query
from glossarium.plans.tables import ENTRIES, entries, table
from glossarium.sources.sinks import commit

W = f"WITH {ENTRIES}"


def finish(df: DataFrame, name: str, path: str, key: str) -> dict[str, int]:
    """Write a table ordered by its lookup key and let Spark measure it; rows and bytes of it, and an error where it is empty."""
    spark = df.sparkSession
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").option("path", path).saveAsTable(name)
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
    said = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}["Statistics"]
    size, rows = (int(x.split()[0]) for x in said.split(","))
    if not rows:
        raise ValueError(f"{name} has no rows")
    return {"rows": rows, "bytes": size}


# Chunks and their manifest

CHUNK_BYTES = 20 * 1000 * 1000


def export_chunks(df: DataFrame, path: str, rows_a_chunk: int) -> None:
    """df as gzipped JSON Lines of at most rows_a_chunk rows a file."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_a_chunk).option("compression", "gzip").json(path)


def chunk_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256, rows) of each chunk; one that is larger than a chunk may be is an error."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json.gz").load(path)
    small = F.when(F.col("length") <= CHUNK_BYTES, F.col("length")).otherwise(F.raise_error(F.concat(F.lit("chunk too large: "), F.col("path"))).cast("long"))
    files = files.select(name(F.col("path")).alias("file"), small.alias("bytes"), F.sha2("content", 256).alias("sha256"))
    counts = spark.read.text(path, pathGlobFilter="*.json.gz").groupBy(name(F.input_file_name()).alias("file")).agg(F.count("*").alias("rows"))
    return files.join(counts, "file", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def import_chunks(spark: SparkSession, path: str, manifest: DataFrame, schema: str, target: str) -> int:
    """Read chunks that are what their manifest says, and put them in the place of target by renaming; an error leaves target as it is."""
    have = chunk_manifest(spark, path)
    both = manifest.alias("m").join(have.alias("h"), "file", "full")
    wrong = both.filter(~(F.col("m.sha256").eqNullSafe(F.col("h.sha256")) & F.col("m.bytes").eqNullSafe(F.col("h.bytes")) & F.col("m.rows").eqNullSafe(F.col("h.rows"))))
    bad = [r["file"] for r in wrong.select("file").limit(5).collect()]
    if bad:
        raise ValueError(f"chunks that differ from the manifest: {bad}")
    n = manifest.agg(F.sum("rows").alias("n")).first()["n"] or 0
    return commit(spark.read.schema(schema).json(path), target, at_least=n)


# Digests

def strong_digest(df: DataFrame) -> DataFrame:
    """One row: how many rows, and two sums over them that don't depend on their order, of two parts of the SHA-256 of a row's cells.

    A cell is its type, the number of its bytes and its text, or its type alone
    for null, so that no other cells or types give the same row.
    """
    kinds = dict(df.dtypes)

    def cell(c: str) -> Column:
        text = F.col(f"`{c}`").cast("string")
        return F.concat(F.lit(f"{kinds[c]}:"), F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))

    h = F.sha2(F.concat(*(cell(c) for c in sorted(df.columns))), 256)
    part = lambda k: F.sum(F.conv(F.substring(h, k, 15), 16, 10).cast("decimal(38,0)"))
    both = df.agg(F.count("*").alias("n"), part(1).alias("a"), part(16).alias("b"))
    return both.select("n", F.concat_ws("-", F.coalesce("a", F.lit(0)).cast("string"), F.coalesce("b", F.lit(0)).cast("string")).alias("digest"))


_CELL = lambda kind, c: f"'{kind}:' || coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


@query("snk04_strong_digest", f"{W}, h AS (SELECT sha256(" + " || ".join(_CELL(kind, c) for c, kind in sorted({"id": "bigint", "pack": "string", "source": "string", "headword": "string", "hw_norm": "string", "kind": "string", "level": "int", "rank": "bigint", "gloss": "string"}.items())) + ") AS h FROM entries) SELECT count(*) AS n, CAST(sum(CAST('0x' || h[1:15] AS HUGEINT)) AS VARCHAR) || '-' || CAST(sum(CAST('0x' || h[16:30] AS HUGEINT)) AS VARCHAR) AS digest FROM h")
def strong_digest_query(spark, d):
    return strong_digest(entries(spark, d))


#: Fixed values of the hash: its start, in halves of 32 bits, and what is left of its factor, 2 ** 40 + 435.
_FNV_HIGH, _FNV_LOW, _FNV_FACTOR = 0x14650FB0, 0x739D0383, 435
_HALF = 0xFFFFFFFF
_FNV = (_FNV_HIGH << 32 | _FNV_LOW, (1 << 40) + _FNV_FACTOR)


def fnv1a(text: Column) -> Column:
    """The 64-bit FNV-1a hash of a text's UTF-8 bytes, unsigned, as text; in halves, for a long has no room for the product."""
    raw = F.hex(text.cast("binary"))
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.octet_length(text), F.lit(1))), lambda k: k <= F.octet_length(text))
    half = lambda c: c.bitwiseAND(F.lit(_HALF).cast("long"))

    def step(acc: Column, k: Column) -> Column:
        low = acc["low"].bitwiseXOR(F.conv(F.substr(raw, 2 * k - 1, F.lit(2)), 16, 10).cast("long"))
        product = low * _FNV_FACTOR
        return F.struct(half(acc["high"] * _FNV_FACTOR + F.shiftright(product, 32) + F.shiftleft(low, 8)).alias("high"), half(product).alias("low"))

    start = F.struct(F.lit(_FNV_HIGH).cast("long").alias("high"), F.lit(_FNV_LOW).cast("long").alias("low"))
    h = F.aggregate(places, start, step)
    return F.when(text.isNotNull(), (h["high"].cast("decimal(20,0)") * F.lit(1 << 32) + h["low"]).cast("decimal(20,0)").cast("string"))


@query("fn04_fnv1a", f"{W} SELECT headword, CAST(list_reduce(list_prepend({_FNV[0]}::UHUGEINT, [unicode(c)::UHUGEINT for c in string_split(headword, '')]), lambda h, b: (xor(h::UBIGINT, b::UBIGINT)::UHUGEINT * {_FNV[1]}::UHUGEINT) % 18446744073709551616::UHUGEINT) AS VARCHAR) AS h FROM (SELECT DISTINCT headword FROM entries)")
def fnv1a_query(spark, d):
    return entries(spark, d).select("headword").distinct().select("headword", fnv1a(F.col("headword")).alias("h"))


# Reports

def change_report(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: a Markdown table of what changed between two tables of counts (name, n), by name."""
    both = old.select("name", F.col("n").alias("a")).join(new.select("name", F.col("n").alias("b")), "name", "full")
    what = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "missing").when(F.col("a") != F.col("b"), "changed")
    rows = both.withColumn("what", what).filter("what IS NOT NULL")
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    line = F.concat(F.lit("| "), "name", F.lit(" | "), "what", F.lit(" | "), cell("a"), F.lit(" | "), cell("b"), F.lit(" |"))
    lines = rows.agg(F.array_sort(F.collect_list(F.struct("name", line.alias("line")))).alias("l"))  # a line for each source
    return lines.select(F.array_join(F.concat(F.array(F.lit("| name | what | before | now |"), F.lit("|-|-|-|-|")), F.transform("l", lambda x: x["line"])), "\n").alias("report"))


@query("snk06_change_report", f"{W}, a AS (SELECT source AS name, count(*) AS n FROM entries WHERE id % 5 > 0 AND source <> 'Brand#1' GROUP BY 1), b AS (SELECT source AS name, count(*) AS n FROM entries WHERE source <> 'Brand#2' GROUP BY 1), c AS (SELECT name, a.n AS x, b.n AS y, CASE WHEN a.n IS NULL THEN 'new' WHEN b.n IS NULL THEN 'missing' WHEN a.n <> b.n THEN 'changed' END AS what FROM a FULL JOIN b USING (name)) SELECT '| name | what | before | now |' || chr(10) || '|-|-|-|-|' || coalesce(chr(10) || string_agg('| ' || name || ' | ' || what || ' | ' || coalesce(CAST(x AS VARCHAR), '-') || ' | ' || coalesce(CAST(y AS VARCHAR), '-') || ' |', chr(10) ORDER BY name) FILTER (what IS NOT NULL), '') AS report FROM c")
def change_report_query(spark, d):
    count = lambda rows: rows.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n"))
    e = entries(spark, d)
    return change_report(count(e.filter("id % 5 > 0 AND source <> 'Brand#1'")), count(e.filter("source <> 'Brand#2'")))


def raw_paragraphs(texts: DataFrame) -> DataFrame:
    """(id, n, paragraphs): each text's paragraphs, for those who enrich it by hand."""
    own = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return texts.select("id", F.size(own).alias("n"), own.alias("paragraphs"))


@query("snk08_raw_paragraphs", "SELECT id, CAST(len(p) AS INT) AS n, array_to_string(p, '|') AS paragraphs FROM (SELECT doc_id AS id, list_filter([trim(x) for x in string_split(text, chr(10))], lambda x: x <> '') AS p FROM documents)")
def raw_paragraphs_query(spark, d):
    got = raw_paragraphs(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    return got.select("id", "n", F.array_join("paragraphs", "|").alias("paragraphs"))


def write_counts(counts: DataFrame, path: str) -> None:
    """Counts as tab-separated text with a header, most frequent first within each file."""
    counts.write.mode("overwrite").csv(path, sep="\t", header=True, quote="")


@query("snk09_counts_report", "WITH c AS (SELECT lang, count(*) AS docs, sum(n_chars) AS chars FROM documents GROUP BY lang) SELECT string_agg(lang || chr(9) || docs || chr(9) || CAST(chars AS BIGINT), chr(10) ORDER BY docs DESC, lang) AS tsv, '{\"docs\":' || sum(docs) || ',\"chars\":' || CAST(sum(chars) AS BIGINT) || '}' AS stats FROM c")
def counts_report(spark, d):
    """The summary beside the counts: their lines, and their sums as JSON."""
    c = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    lines = F.array_sort(F.collect_list(F.struct((-F.col("docs")).alias("o"), "lang", F.concat_ws("\t", "lang", "docs", "chars").alias("line"))))
    return c.agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("tsv"), F.to_json(F.struct(F.sum("docs").alias("docs"), F.sum("chars").alias("chars"))).alias("stats"))


# Catalogues and workbooks, read on the driver: they are written by hand

CATALOGUE = "id string, title string, source string, page string, year int, genre string, licence string"


def catalogue(spark: SparkSession, text: str) -> DataFrame:
    """The [[text]] entries of a TOML catalogue."""
    names = [x.split()[0] for x in CATALOGUE.split(", ")]
    return spark.createDataFrame([tuple(e.get(n) for n in names) for e in tomllib.loads(text).get("text", [])], CATALOGUE)


def catalogue_problems(rows: DataFrame, sources: list[str]) -> DataFrame:
    """(id, problem) of a catalogue's entries."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    rules = [(blank(F.col("title")), "no title"), (~F.coalesce(F.col("source").isin(sources), F.lit(False)), "unknown source"), (blank(F.col("page")), "no page"), (F.col("year").isNull(), "no year"), (~F.coalesce(F.col("id").rlike("^[a-z0-9-]+$"), F.lit(False)), "id must be lower-case letters, digits and hyphens")]
    faults = F.filter(F.array(*(F.when(bad, m) for bad, m in rules)), lambda m: m.isNotNull())
    twice = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit("id stands twice").alias("problem"))
    return rows.select("id", F.explode(faults).alias("problem")).unionByName(twice)


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def workbook(path: str) -> list[list[str]]:
    """The cells of a workbook's first sheet, as text, row by row; a missing cell is empty."""
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_SHEET}si")]
        rows = []
        for row in ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml")).iter(f"{_SHEET}row"):
            cells: list[str] = []
            for c in row.findall(f"{_SHEET}c"):
                letters = "".join(x for x in c.get("r", "") if x.isalpha())
                at = int(np.dot([ord(x) - 64 for x in letters], [26**k for k in reversed(range(len(letters)))])) - 1 if letters else len(cells)
                cells += [""] * (at - len(cells))
                v = c.find(f"{_SHEET}v")
                text = "".join(t.text or "" for t in c.iter(f"{_SHEET}t")) if v is None else v.text or ""
                cells.append(shared[int(text)] if c.get("t") == "s" else text)
            rows.append(cells)
    return rows


def curriculum_lines(spark: SparkSession, path: str) -> DataFrame:
    """A curriculum's workbook (rank, level, form, part of speech, hint behind a header) as the lines that sources.dictionaries.curriculum_words reads."""
    rows = [(r + [""] * 5)[:5] for r in workbook(path)[1:] if any(x.strip() for x in r)]
    t = spark.createDataFrame(rows or [], "rank string, level string, form string, pos string, hint string")
    form = F.trim("form")
    number = F.regexp_extract(form, "([0-9]{1,2})$", 1)
    head = F.trim(F.regexp_replace(F.regexp_replace(form, "[0-9]{1,2}$", ""), r"\([^()]*\)", ""))
    level = F.regexp_extract("level", "([1-6])", 1)
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return t.select(F.concat_ws("\t", F.regexp_replace(F.trim("rank"), r"\.0$", ""), level, form, head, F.regexp_replace(number, "^0+", ""), tidy(F.col("pos")), tidy(F.col("hint"))).alias("value"))

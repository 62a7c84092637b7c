"""Scripts, readings, markup and notations of dictionary text, all in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossarium.plans.registry import query
from glossarium.plans.tables import ENTRIES, entries, table

W = f"WITH {ENTRIES}"


#: The test tables hold no Hangul: letters of names stand for syllables, one for one.
LETTERS, SYLLABLES_OF = "abcdefghijklmnopqrstuvwxyz", "가나다라마바사아자차카타파하거너더러머버서어저처커터"


def hangul_of(c: Column) -> Column:
    return F.translate(F.lower(c), LETTERS, SYLLABLES_OF)


def listed(spark, d: str, words: list[str]) -> DataFrame:
    """(n, word) for each part: one of the words by its key, alone, behind the part's name in Hangul or before it."""
    p, n = table(spark, d, "part"), F.col("p_partkey")
    word = F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))
    name, kind = hangul_of(F.col("p_name")), F.floor(n / len(words)) % 3
    return p.select(n.alias("n"), F.when(kind == 1, F.concat(name, word)).when(kind == 2, F.concat(word, name)).otherwise(word).alias("word"))


def values(words: list[str]) -> str:
    """The same for DuckDB."""
    quoted = ", ".join("'" + w.replace("'", "''") + "'" for w in words)
    name = f"translate(lower(p_name), '{LETTERS}', '{SYLLABLES_OF}')"
    return f"(SELECT n, CASE kind WHEN 1 THEN name || w WHEN 2 THEN w || name ELSE w END AS word FROM (SELECT p_partkey AS n, [{quoted}][p_partkey % {len(words)} + 1] AS w, {name} AS name, p_partkey // {len(words)} % 3 AS kind FROM part)) t"


POINTERS = ["(가고, 가니)→ 가다 1", "→ 나다", "no pointer", "→춥다2", ""]


@query("str11_parse_pointer", f"SELECT n, regexp_extract(word, '^(?:\\(([^)]*)\\))?\\s*→\\s*([^0-9 ]+)\\s*([0-9]*)$', 1) AS forms, regexp_extract(word, '^(?:\\(([^)]*)\\))?\\s*→\\s*([^0-9 ]+)\\s*([0-9]*)$', 2) AS lemma, TRY_CAST(regexp_extract(word, '^(?:\\(([^)]*)\\))?\\s*→\\s*([^0-9 ]+)\\s*([0-9]*)$', 3) AS INT) AS homonym FROM {values(POINTERS)}")
def parse_pointer(spark, d):
    """Inflected forms, lemma and homonym number of a cross-reference; empty where there is none."""
    part = lambda k: F.regexp_extract("word", r"^(?:\(([^)]*)\))?\s*→\s*([^0-9 ]+)\s*([0-9]*)$", k)
    return listed(spark, d, POINTERS).select("n", part(1).alias("forms"), part(2).alias("lemma"), F.nullif(part(3), F.lit("")).cast("int").alias("homonym"))


BRACKETED = ["학교(學校)", "가다 [동사]", "school", "나무", "(x)", "물고기(fish)들"]


@query("str12_clean_word", f"SELECT n, CASE WHEN regexp_full_match(w, '[가-힣]+( [가-힣]+)*') THEN w END AS word FROM (SELECT n, trim(regexp_replace(word, '\\([^()]*\\)|\\[[^\\[\\]]*\\]', '', 'g')) AS w FROM {values(BRACKETED)})")
def clean_word(spark, d):
    """A word without bracketed parts; null unless Hangul alone is left."""
    w = F.trim(F.regexp_replace("word", r"\([^()]*\)|\[[^\[\]]*\]", ""))
    return listed(spark, d, BRACKETED).select("n", F.when(w.rlike("^[가-힣]+( [가-힣]+)*$"), w).alias("word"))


#: Vowels of pinyin, and each with the four tone marks in turn.
PINYIN_VOWELS = "aeiouüAEIOUÜ"
TONE_MARKS = "āáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜĀÁǍÀĒÉĚÈĪÍǏÌŌÓǑÒŪÚǓÙǕǗǙǛ"


def tone_mark(syllable: Column) -> Column:
    """Numbered pinyin with the mark over its vowel: a or e, else the o of ou, else the last vowel. Tone 5 has no mark; without a tone number only u: becomes ü."""
    s = F.replace(F.replace(syllable, F.lit("u:"), F.lit("ü")), F.lit("U:"), F.lit("Ü"))
    base, tone = F.regexp_replace(s, "[1-5]$", ""), F.regexp_extract(s, "([1-4])$", 1)
    plain = F.lower(base)
    last = F.length(F.regexp_extract(plain, "^(.*[aeiouü])", 1))
    at = F.coalesce(*(F.nullif(F.instr(plain, v), F.lit(0)) for v in ("a", "e", "ou")), last)
    mark = F.substring(F.lit(TONE_MARKS), (F.instr(F.lit(PINYIN_VOWELS), F.substring(base, at, F.lit(1))) - 1) * 4 + tone.cast("int"), F.lit(1))
    return F.when((tone == "") | (at == 0), base).otherwise(F.concat(F.left(base, at - 1), mark, F.substr(base, at + 1)))


SYLLABLES = ["xue2", "xiao4", "lu:4", "gou3", "gui4", "de5", "r5", "liu2", "an1", "m2", "Zhong1", "A1", "lu:e4", "LU:3", "hao", "Ou1", "E4"]


@query(
    "str15_tone_marks",
    f"""SELECT n, CASE WHEN tone = '' OR k = 0 THEN base ELSE left(base, k - 1) || substr('{TONE_MARKS}', CAST((instr('{PINYIN_VOWELS}', base[k]) - 1) * 4 + TRY_CAST(tone AS INT) AS INT), 1) || substr(base, k + 1) END AS marked
FROM (SELECT *, CAST(CASE WHEN instr(lower(base), 'a') > 0 THEN instr(lower(base), 'a') WHEN instr(lower(base), 'e') > 0 THEN instr(lower(base), 'e') WHEN instr(lower(base), 'ou') > 0 THEN instr(lower(base), 'ou') ELSE length(regexp_extract(lower(base), '^(.*[aeiouü])', 1)) END AS INT) AS k
FROM (SELECT n, regexp_replace(replace(replace(word, 'u:', 'ü'), 'U:', 'Ü'), '[1-5]$', '') AS base, regexp_extract(word, '([1-4])$', 1) AS tone FROM {values(SYLLABLES)}))""",
)
def tone_marks(spark, d):
    return listed(spark, d, SYLLABLES).select("n", tone_mark(F.col("word")).alias("marked"))


@query("str21_html_parts", "SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[\\s]+', ' ', 'g')) AS body FROM pages")
def html_parts(spark, d):
    """Title and visible text of raw pages."""
    bare = F.regexp_replace(F.regexp_replace("html", "(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.trim(F.regexp_replace(bare, r"[\s]+", " ")).alias("body"))


@query("str22_paragraphs", "SELECT doc_id, k - 1 AS n, trim(parts[k]) AS paragraph FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)) WHERE trim(parts[k]) <> ''")
def paragraphs(spark, d):
    """Paragraphs with their positions; empty ones are left out but counted."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "p"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n"), F.trim("p").alias("paragraph")).filter("paragraph <> ''")


@query("str23_norm_ws", "SELECT doc_id, sha256(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))) AS digest FROM documents")
def norm_ws(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " ")).cast("binary"), 256).alias("digest"))


DATES = ["2024년 3월 5일", "2024-03-05 10:00", "게시 2023.12.1.", "no date", "2024/13/45", ""]
_DATE = "([0-9]{4})[^0-9]{1,3}([0-9]{1,2})[^0-9]{1,3}([0-9]{1,2})"


@query("str24_dates", f"SELECT n, TRY_CAST(regexp_extract(word, '{_DATE}', 1) || '-' || lpad(regexp_extract(word, '{_DATE}', 2), 2, '0') || '-' || lpad(regexp_extract(word, '{_DATE}', 3), 2, '0') AS DATE) AS day FROM {values(DATES)}")
def dates(spark, d):
    """The first date of a free text; null where there is none or no such day."""
    part = lambda k: F.regexp_extract("word", _DATE, k)
    day = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    return listed(spark, d, DATES).select("n", day.try_cast("date").alias("day"))


VIEWS = ["학교에, 간다!", "a 학교 b", "", "가  나"]


@query("str27_views", f"SELECT n, regexp_replace(word, '[^가-힣]', '', 'g') AS compact, trim(regexp_replace(word, '[^가-힣]+', ' ', 'g')) AS spaced FROM {values(VIEWS)}")
def views(spark, d):
    """Text for matching without and with word boundaries."""
    return listed(spark, d, VIEWS).select("n", F.regexp_replace("word", "[^가-힣]", "").alias("compact"), F.trim(F.regexp_replace("word", "[^가-힣]+", " ")).alias("spaced"))


@query("str29_gap", f"{W} SELECT id, replace(gloss, headword, '____') AS question, headword AS answer FROM entries WHERE contains(gloss, headword)")
def gap(spark, d):
    return entries(spark, d).filter(F.col("gloss").contains(F.col("headword"))).select("id", F.replace("gloss", F.col("headword"), F.lit("____")).alias("question"), F.col("headword").alias("answer"))


STEMS = ["가다", "학교", "춥다", "다", ""]


@query("str30_stem_of", f"SELECT n, CASE WHEN length(word) > 1 THEN regexp_replace(word, '다$', '') ELSE word END AS stem FROM {values(STEMS)}")
def stem_of(spark, d):
    return listed(spark, d, STEMS).select("n", F.when(F.length("word") > 1, F.regexp_replace("word", "다$", "")).otherwise(F.col("word")).alias("stem"))


@query("str31_url_encode", f"{W} SELECT id, url_encode(headword) AS encoded FROM entries")
def url_encode(spark, d):
    return entries(spark, d).select("id", F.replace(F.url_encode("headword"), F.lit("+"), F.lit("%20")).alias("encoded"))


@query("str32_utf16_length", "SELECT doc_id, CAST(length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) AS BIGINT) AS units FROM documents")
def utf16_length(spark, d):
    """Length in UTF-16 units, where Spark counts code points."""
    return table(spark, d, "documents").select("doc_id", (F.octet_length(F.encode("text", "UTF-16BE")) / 2).cast("long").alias("units"))

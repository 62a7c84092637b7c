"""Pages of study lists and of a library of texts, grouped results, point lookups, and romanisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossarium.functions.writing import LETTERS, SYLLABLES_OF, hangul_of, listed, values
from glossarium.plans.registry import query
from glossarium.plans.tables import ENTRIES, FORMS, entries, forms, table

W = f"WITH {ENTRIES}"

# Romanisation

#: Letters of the Revised Romanisation, by the order of initials, vowels and finals; - stands for none.
ROMAN_INITIALS = "g kk n d tt r m b pp s ss - j jj ch k t p h"
ROMAN_VOWELS = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i"
ROMAN_FINALS = "- k k k n n n t l k m l l l p l m p p t t ng t t k t p t"


def _roman(text: str) -> list[str]:
    return ["" if x == "-" else x for x in text.split()]


def romanize(word: Column) -> Column:
    """Syllable by syllable, without the changes between syllables; hyphens fall, other characters stay."""
    k = lambda c: F.ascii(c) - 0xAC00
    at = lambda text, i: F.element_at(F.array(*map(F.lit, _roman(text))), i.cast("int") + 1)
    one = lambda c: F.when(c.rlike("[가-힣]"), F.concat(at(ROMAN_INITIALS, F.floor(k(c) / 588)), at(ROMAN_VOWELS, F.floor(k(c) % 588 / 28)), at(ROMAN_FINALS, k(c) % 28))).when(c == "-", "").otherwise(c)
    return F.array_join(F.transform(F.split(word, ""), one), "")


def looks_romanized(lemma: Column, headword: Column) -> Column:
    """Whether an English equivalent only spells the headword: at most a quarter of its letters, or one, differ."""
    bare = F.regexp_replace(F.trim(lemma), "^-+|-+$", "")
    hangul = F.regexp_replace(headword, "[^가-힣]", "")
    near = F.levenshtein(romanize(hangul), bare) <= F.greatest(F.floor(F.length(bare) / 4), F.lit(1))
    return bare.rlike("^[a-z]+$") & (hangul != "") & near


ROMANIZED = ["학교", "값-", "닭갈비", "읽다", "school", "의사", "꽃", ""]


def _letter_sql(text: str, k: str) -> str:
    return "[" + ", ".join(f"'{x}'" for x in _roman(text)) + f"][CAST({k} AS INT) + 1]"


def _roman_sql(word: str) -> str:
    letters = " || ".join((_letter_sql(ROMAN_INITIALS, "(unicode(c) - 44032) // 588"), _letter_sql(ROMAN_VOWELS, "(unicode(c) - 44032) % 588 // 28"), _letter_sql(ROMAN_FINALS, "(unicode(c) - 44032) % 28")))
    return f"coalesce(array_to_string([CASE WHEN regexp_matches(c, '[가-힣]') THEN {letters} WHEN c = '-' THEN '' ELSE c END for c in string_split({word}, '')], ''), '')"


@query("str05_romanize", f"SELECT n, {_roman_sql('word')} AS roman FROM {values(ROMANIZED)}")
def romanize_query(spark, d):
    return listed(spark, d, ROMANIZED).select("n", romanize(F.col("word")).alias("roman"))


_NAME = f"translate(lower(replace(p_name, ' ', '')), '{LETTERS}', '{SYLLABLES_OF}')"


@query(
    "str05_looks_romanized",
    f"""WITH h AS (SELECT p_partkey AS id, {_NAME} AS headword, {_roman_sql(_NAME)} AS roman, replace(p_name, ' ', '') AS name FROM part),
l AS (SELECT id, headword, CASE id % 6 WHEN 0 THEN roman WHEN 1 THEN '-' || roman || '-' WHEN 2 THEN 'x' || substr(roman, 2) WHEN 3 THEN name WHEN 4 THEN upper(roman) ELSE replace(roman, 'a', 'oo') END AS lemma FROM h),
b AS (SELECT *, regexp_replace(trim(lemma), '^-+|-+$', '', 'g') AS bare FROM l)
SELECT id, regexp_full_match(bare, '[a-z]+') AND headword <> '' AND levenshtein({_roman_sql('headword')}, bare) <= greatest(length(bare) // 4, 1) AS romanized FROM b""",
)
def looks_romanized_query(spark, d):
    """Names of parts in Hangul beside their romanisation as it is, with hyphens, with a letter or many changed, in capitals, and beside another word."""
    p = table(spark, d, "part")
    name = F.replace("p_name", F.lit(" "), F.lit(""))
    x = p.select(F.col("p_partkey").alias("id"), hangul_of(name).alias("headword"), name.alias("name")).withColumn("roman", romanize(F.col("headword")))
    k, roman = F.col("id") % 6, F.col("roman")
    lemma = F.when(k == 0, roman).when(k == 1, F.concat(F.lit("-"), roman, F.lit("-"))).when(k == 2, F.concat(F.lit("x"), F.substr("roman", F.lit(2)))).when(k == 3, F.col("name")).when(k == 4, F.upper("roman")).otherwise(F.replace(roman, F.lit("a"), F.lit("oo")))
    return x.select("id", looks_romanized(lemma, F.col("headword")).alias("romanized"))


# Study lists

def study_words(curriculum: DataFrame, e: DataFrame, level: int, limit: int, offset: int) -> DataFrame:
    """A page of a level's words (id, level, rank), one row an entry, in the order of the list."""
    page = curriculum.filter((F.col("level") == level) & F.col("id").isNotNull()).groupBy("id").agg(F.min("rank").alias("r")).orderBy("r", "id").offset(offset).limit(limit)
    return page.join(e.drop("level", "rank"), "id").orderBy("r", "id")


_CURRICULUM = "c AS (SELECT CASE WHEN l_quantity > 48 THEN NULL ELSE l_partkey END AS id, l_linenumber AS level, CAST(l_orderkey AS BIGINT) AS rank FROM lineitem)"


def _curriculum(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.when(F.col("l_quantity") <= 48, F.col("l_partkey")).alias("id"), F.col("l_linenumber").alias("level"), F.col("l_orderkey").alias("rank"))


@query("qry25_study_words", f"{W}, {_CURRICULUM}, p AS (SELECT id, min(rank) AS r FROM c WHERE level = 5 AND id IS NOT NULL GROUP BY id ORDER BY r, id LIMIT 20 OFFSET 10) SELECT p.id, p.r, e.headword FROM p JOIN entries e ON e.id = p.id")
def study_words_query(spark, d):
    return study_words(_curriculum(spark, d), entries(spark, d), 5, 20, 10).select("id", "r", "headword")


@query("qry25_study_overview", f"{W}, {_CURRICULUM} SELECT 'words' AS part, CAST(level AS VARCHAR) AS name, count(DISTINCT id) AS n FROM c WHERE id IS NOT NULL GROUP BY level UNION ALL SELECT 'grammar', CAST(level AS VARCHAR), count(*) FROM entries WHERE kind = 'phrase' AND level IS NOT NULL GROUP BY level UNION ALL SELECT 'topics', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority UNION ALL SELECT 'idioms', pack, count(*) FROM entries WHERE kind = 'idiom' GROUP BY pack")
def study_overview(spark, d):
    """What there is to study: words and patterns by level, topics, lists of idioms."""
    e = entries(spark, d)
    count = lambda part, rows, by, n: rows.groupBy(F.col(by).cast("string").alias("name")).agg(n.alias("n")).select(F.lit(part).alias("part"), "name", "n")
    every = F.count("*")
    out = count("words", _curriculum(spark, d).filter("id IS NOT NULL"), "level", F.countDistinct("id"))
    out = out.unionByName(count("grammar", e.filter("kind = 'phrase' AND level IS NOT NULL"), "level", every))
    return out.unionByName(count("topics", table(spark, d, "orders"), "o_orderpriority", every)).unionByName(count("idioms", e.filter("kind = 'idiom'"), "pack", every))


def topic_words(topics: DataFrame, e: DataFrame, category: str, by_level: bool, limit: int, offset: int) -> DataFrame:
    """A page of a topic's words (category, id): of one category, or of all below a top one; by level first if wanted, those without one last."""
    own = F.col("category") == category if " > " in category else F.col("category").startswith(f"{category} > ")
    order = [F.col("level").isNull(), "level", "hw_norm", "id"] if by_level else ["hw_norm", "id"]
    return topics.filter(own).join(e, "id").orderBy(*order).offset(offset).limit(limit)


_TOPICS = "t AS (SELECT id, pack || ' > ' || kind AS category FROM entries)"


@query("qry25_topic_words", f"{W}, {_TOPICS} SELECT * FROM (SELECT 'all' AS part, e.id FROM t JOIN entries e USING (id) WHERE starts_with(category, 'ECONOMY > ') ORDER BY level IS NULL, level, hw_norm, e.id LIMIT 30 OFFSET 5) UNION ALL SELECT * FROM (SELECT 'one', e.id FROM t JOIN entries e USING (id) WHERE category = 'PROMO > word' ORDER BY hw_norm, e.id LIMIT 30)")
def topic_words_query(spark, d):
    e = entries(spark, d)
    topics = e.select("id", F.concat_ws(" > ", "pack", "kind").alias("category"))
    page = lambda part, *args: topic_words(topics, e, *args).select(F.lit(part).alias("part"), "id")
    return page("all", "ECONOMY", True, 30, 5).unionByName(page("one", "PROMO > word", False, 30, 0))


# The library of texts

#: Lengths of texts, each below so many characters.
LENGTHS = {"short": 1000, "medium": 5000}


def length_bucket(chars: Column) -> Column:
    return F.when(chars < LENGTHS["short"], "short").when(chars < LENGTHS["medium"], "medium").otherwise("long")


def level_bucket(level: Column) -> Column:
    """The shelf label of a text's level as its maker writes it."""
    low, digit = F.lower(level), F.regexp_extract(level, "[0-9]", 0).try_cast("int")
    exam = F.when(digit <= 2, "topik12").when(digit <= 4, "topik34").otherwise("topik56")
    return F.when(low.contains("topik") & digit.isNotNull(), exam).when(low.contains("classic"), "classical").when(low.contains("advanc"), "advanced")


def library_matches(texts: DataFrame, shelf: str = "", period: str = "", theme: str = "", level: str = "", length: str = "", script: str = "") -> DataFrame:
    """Texts (shelf, period, themes, level, chars, script) that fit all facets that are given."""
    facets = [(shelf, F.col("shelf") == shelf), (period, F.col("period") == period), (theme, F.array_contains("themes", theme)), (level, level_bucket(F.col("level")) == level), (length, length_bucket(F.col("chars")) == length), (script, F.col("script") == script)]
    for given, fits in facets:
        texts = texts.filter(fits) if given else texts
    return texts


def _texts(spark, d) -> DataFrame:
    level = F.element_at(F.array(*map(F.lit, ("TOPIK 2", "TOPIK 3-4", "topik6", "Advanced", "Classical Chinese", ""))), (F.col("doc_id") % 6 + 1).cast("int"))
    period = F.when(F.col("doc_id") % 2 == 0, "modern").otherwise("joseon")
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("shelf"), period.alias("period"), F.array("lang", F.lit("all")).alias("themes"), level.alias("level"), F.col("n_chars").alias("chars"), F.col("lang").alias("script"), "text")


@query("flt11_facets", "SELECT doc_id AS id FROM documents WHERE doc_id % 2 = 0 AND doc_id % 6 IN (0, 1, 2, 3, 4, 5) AND lang = 'en' AND ((doc_id % 6 = 0 AND n_chars < 1000) OR (doc_id % 6 = 2 AND n_chars >= 1000 AND n_chars < 5000) OR (doc_id % 6 = 4 AND n_chars >= 5000))")
def facets_query(spark, d):
    t = _texts(spark, d)
    found = [library_matches(t, period="modern", theme="en", level=level, length=length, script="en") for level, length in (("topik12", "short"), ("topik56", "medium"), ("classical", "long"))]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("id")


@query("prj11_bands", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'topik12' WHEN 1 THEN 'topik34' WHEN 2 THEN 'topik56' WHEN 3 THEN 'advanced' WHEN 4 THEN 'classical' END AS level, CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 5000 THEN 'medium' ELSE 'long' END AS length FROM documents")
def bands_query(spark, d):
    return _texts(spark, d).select(F.col("id").alias("doc_id"), level_bucket(F.col("level")).alias("level"), length_bucket(F.col("chars")).alias("length"))


def list_texts(texts: DataFrame) -> DataFrame:
    """Summaries of texts (id, meta: JSON, sort), in order; what the JSON lacks is empty."""
    get = lambda k: F.coalesce(F.get_json_object("meta", f"$.{k}"), F.lit("")).alias(k)
    themes = F.coalesce(F.from_json(F.get_json_object("meta", "$.themes"), "array<string>"), F.array().cast("array<string>"))
    n = F.row_number().over(Window.orderBy("sort", "id"))  # a library's list
    return texts.select("id", n.alias("n"), get("title_ko"), get("title_en"), get("date"), themes.alias("themes"))


def get_text(paragraphs: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts (id, meta) with all their paragraphs (id, n, orig), in order."""
    own = paragraphs.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "orig"))), lambda p: p["orig"]).alias("paragraphs"))
    return texts.join(own, "id", "left").withColumn("paragraphs", F.coalesce("paragraphs", F.array().cast("array<string>")))


@query("qry29_list_texts", "SELECT conv_id AS id, row_number() OVER (ORDER BY n DESC, conv_id) AS n, 'talk ' || conv_id AS title_en, '' AS title_ko, CASE WHEN conv_id % 2 = 0 THEN 'a,b' ELSE '' END AS themes FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)")
def list_texts_query(spark, d):
    t = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg((-F.count("*")).alias("sort"))
    themes = F.when(F.col("id") % 2 == 0, F.array(F.lit("a"), F.lit("b")))
    meta = F.to_json(F.struct(F.concat(F.lit("talk "), "id").alias("title_en"), themes.alias("themes")))
    got = list_texts(t.select("id", "sort", meta.alias("meta")))
    return got.select("id", "n", "title_en", "title_ko", F.array_join("themes", ",").alias("themes"))


@query("qry29_get_text", "SELECT c.id, coalesce(string_agg(text, '|' ORDER BY turn, text), '') AS body FROM (SELECT DISTINCT conv_id AS id FROM conversations UNION SELECT -1) c LEFT JOIN conversations v ON v.conv_id = c.id GROUP BY c.id")
def get_text_query(spark, d):
    c = table(spark, d, "conversations")
    texts = c.select(F.col("conv_id").alias("id")).distinct().union(spark.createDataFrame([(-1,)], "id long"))
    got = get_text(c.select(F.col("conv_id").alias("id"), F.col("turn").alias("n"), F.col("text").alias("orig")), texts)
    return got.select("id", F.array_join("paragraphs", "|").alias("body"))


@query("qry29_pending", "SELECT doc_id AS id, CASE WHEN doc_id % 4 = 1 THEN 'repair' WHEN doc_id % 4 = 2 THEN 'held' ELSE 'preparing' END AS status FROM documents WHERE doc_id % 4 > 0")
def pending(spark, d):
    """Catalogue texts that the library lacks, with why."""
    catalogue = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    there = catalogue.filter("id % 4 = 0")
    why = F.when(F.col("id") % 4 == 1, "repair").when(F.col("id") % 4 == 2, "held").otherwise("preparing")
    return catalogue.join(there, "id", "left_anti").select("id", why.alias("status"))


# Lookups and joins

@query("qry13_lookups", f"{W}, {FORMS} SELECT 'headword' AS by, 'red gear' AS key, id FROM entries WHERE hw_norm = 'redgear' UNION ALL SELECT 'entry', 'Brand#3', id FROM entries WHERE source = 'Brand#3' AND id = (SELECT min(id) FROM entries WHERE source = 'Brand#3') UNION ALL SELECT 'char', form, min(entry_id) FROM forms WHERE form = 'hot' GROUP BY form")
def lookups(spark, d):
    """Entries of a headword, one entry by source and id, and what is known of a character, the first pack's."""
    e = entries(spark, d)
    by = lambda kind, key, rows: rows.select(F.lit(kind).alias("by"), F.lit(key).alias("key"), "id")
    third = e.filter("source = 'Brand#3'")
    one = third.join(third.agg(F.min("id").alias("id")), "id")
    char = forms(spark, d).filter("form = 'hot'").groupBy("form").agg(F.min("entry_id").alias("id"))
    return by("headword", "red gear", e.filter("hw_norm = 'redgear'")).unionByName(by("entry", "Brand#3", one)).unionByName(by("char", "hot", char))


@query("jn03_sentence_hits", "WITH f AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM documents) SELECT d.doc_id, d.lang, d.n_chars FROM f JOIN documents d ON d.doc_id = f.doc_id WHERE f.word = 'the'")
def sentence_hits(spark, d):
    """The word index of texts joined to the texts, for one word."""
    t = table(spark, d, "documents")
    index = t.select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))).alias("word"))
    return index.filter("word = 'the'").join(t.select("doc_id", "lang", "n_chars"), "doc_id").select("doc_id", "lang", "n_chars")


@query("jn05_curriculum", f"{W}, {_CURRICULUM} SELECT 'word' AS part, c.rank, e.id FROM c JOIN entries e ON e.id = c.id WHERE c.level <= 2 UNION ALL SELECT 'grammar', c.rank, n.n_nationkey FROM c JOIN nation n ON n.n_nationkey = c.id WHERE c.level > 2")
def curriculum(spark, d):
    """A curriculum's rows joined to entries, and to patterns."""
    c = _curriculum(spark, d)
    patterns = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    words = c.filter("level <= 2").join(entries(spark, d).select("id"), "id").select(F.lit("word").alias("part"), "rank", "id")
    return words.unionByName(c.filter("level > 2").join(patterns, "id").select(F.lit("grammar").alias("part"), "rank", "id"))


# Grouped results

#: Kinds of matches, best first.
TIERS = ["exact", "hanja", "form", "deconj", "prefix", "fts"]


def result_groups(rows: DataFrame, order: list[str], korean: list[str]) -> DataFrame:
    """One row for each headword and hanja of result rows (at, headword, hanja, source, level, pos, gloss, via): its sources in their order, its primary row (of the first source in English, or of the first at all), the first level, two parts of speech and the best kind of match."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    tier = F.array_position(F.array(*map(F.lit, TIERS)), F.col("via"))
    own = rows.withColumns({"o": place, "t": tier, "ko": F.col("source").isin(korean)})
    primary = F.min_by(F.struct("headword", "gloss", "at"), F.struct("ko", "o", "at"))
    in_order = F.array_sort(F.collect_list(F.struct("at", "pos", "level", "gloss", "ko")))
    g = own.groupBy(F.regexp_replace("headword", "[- ^·]", "").alias("key"), F.coalesce("hanja", F.lit("")).alias("hanja")).agg(in_order.alias("r"), primary.alias("p"), F.array_sort(F.collect_set(F.struct("o", "source"))).alias("s"), F.min("t").alias("t"), F.count("*").alias("n"), F.min("at").alias("at"))
    first = lambda c, ok: F.get(F.filter(F.transform("r", c), ok), F.lit(0))
    is_there = lambda x: x.isNotNull()
    pos = F.slice(F.array_distinct(F.filter(F.transform("r", lambda r: r["pos"]), is_there)), 1, 2)
    english = first(lambda r: F.when(~r["ko"], r["gloss"]), is_there)
    gloss = F.trim(F.coalesce("p.gloss", english, first(lambda r: r["gloss"], is_there), F.lit("")))
    via = F.element_at(F.array(*map(F.lit, TIERS)), F.col("t").cast("int"))
    return g.select("key", "hanja", "n", "at", F.col("p.at").alias("primary"), "p.headword", first(lambda r: r["level"], is_there).alias("level"), F.array_join(pos, ",").alias("pos"), gloss.alias("gloss"), F.array_join(F.transform("s", lambda x: x["source"]), ",").alias("sources"), via.alias("via"))


_ORDER = ", ".join(f"'Brand#{k}'" for k in range(1, 26))


@query(
    "ag12_result_groups",
    f"""{W}, r AS (SELECT rank * 1000000 + id AS w, headword, pack AS hanja, source, level, kind AS pos, CASE WHEN id % 4 > 0 THEN gloss END AS gloss, list_position([{_ORDER}], source) AS o, source IN ('Brand#1', 'Brand#2') AS ko, [{', '.join(f"'{t}'" for t in TIERS)}][id % 6 + 1] AS via, id % 6 AS t FROM entries)
SELECT replace(headword, ' ', '') AS key, hanja, count(*) AS n, min(w) AS "at", arg_min(w, (ko, o, w)) AS "primary", min(headword) AS headword, arg_min(level, w) FILTER (level IS NOT NULL) AS level, (SELECT string_agg(pos, ',' ORDER BY f) FROM (SELECT pos, min(w) AS f FROM r x WHERE x.headword = r.headword AND x.hanja = r.hanja GROUP BY pos ORDER BY f LIMIT 2)) AS pos,
trim(coalesce(arg_min_null(gloss, (ko, o, w)), arg_min(gloss, w) FILTER (NOT ko AND gloss IS NOT NULL), arg_min(gloss, w) FILTER (gloss IS NOT NULL), '')) AS gloss, (SELECT string_agg(source, ',' ORDER BY o) FROM (SELECT DISTINCT source, o FROM r x WHERE x.headword = r.headword AND x.hanja = r.hanja)) AS sources, arg_min(via, t) AS via FROM r GROUP BY headword, hanja""",
)
def result_groups_query(spark, d):
    e = entries(spark, d)
    via = F.element_at(F.array(*map(F.lit, TIERS)), (F.col("id") % 6 + 1).cast("int"))
    rows = e.select((F.col("rank") * 1_000_000 + F.col("id")).alias("at"), "headword", F.col("pack").alias("hanja"), "source", "level", F.col("kind").alias("pos"), F.when(F.col("id") % 4 > 0, F.col("gloss")).alias("gloss"), via.alias("via"))
    return result_groups(rows, [f"Brand#{k}" for k in range(1, 26)], ["Brand#1", "Brand#2"])

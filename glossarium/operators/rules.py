"""Rules of the dictionary in full: glosses and search texts, script routes, leaked markup, filling and folding of homographs, phrases, stems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossarium.functions.hangul import INITIALS
from glossarium.functions.markup import make_gloss
from glossarium.functions.text import truncate
from glossarium.functions.writing import listed, values
from glossarium.plans.registry import query
from glossarium.plans.tables import ENTRIES, entries, table

W = f"WITH {ENTRIES}"
NONE = "array<string>"


# Glosses and search texts

def distinct_ci(items: Column) -> Column:
    """The items without those that only repeat an earlier one in other letters."""
    return F.filter(items, lambda x, k: F.array_position(F.transform(items, lambda y: F.lower(y)), F.lower(x)) == k + 1)


def gloss_pieces(glosses: Column) -> Column:
    """The pieces of the senses' glosses, in order, once each."""
    pieces = F.flatten(F.transform(glosses, lambda g: F.split(g, ";")))
    return distinct_ci(F.filter(F.transform(pieces, lambda p: F.trim(p)), lambda p: p != ""))


def entry_gloss(glosses: Column, defs: Column, ko_defs: Column, limit: int = 120) -> Column:
    """An entry's gloss: the pieces that fit, else its first definition, English before Korean."""
    joined = make_gloss(gloss_pieces(glosses), limit)
    first = F.coalesce(F.get(F.filter(defs, lambda x: x != ""), F.lit(0)), F.get(F.filter(ko_defs, lambda x: x != ""), F.lit(0)))
    return F.when(joined != "", joined).otherwise(truncate(first, limit))


def search_text(glosses: Column, defs: Column) -> Column:
    """(head, en): the first twelve pieces, and the others with up to eight definitions."""
    pieces = gloss_pieces(glosses)
    more = F.transform(F.slice(F.filter(defs, lambda x: x != ""), 1, 8), lambda x: truncate(x, 300))
    rest = F.slice(pieces, F.lit(13), F.greatest(F.size(pieces) - 12, F.lit(0)))
    return F.struct(F.array_join(F.slice(pieces, 1, 12), " ; ").alias("head"), F.array_join(F.concat(rest, more), " ; ").alias("en"))


def gloss_items(glosses: Column, longest: int = 40) -> Column:
    """(term, first) of an entry's gloss items: lower case, without "to ", not longer than 40, once each; first marks the entry's first item, where it isn't too long."""
    items = F.flatten(F.transform(glosses, lambda g: F.split(g, "[;,]")))
    items = F.transform(items, lambda x: F.trim(F.regexp_replace(F.trim(F.regexp_replace(F.lower(x), r"\s+", " ")), "^to ", "")))
    items = F.filter(items, lambda x: x != "")
    own = F.filter(items, lambda x, k: (F.length(x) <= longest) & (F.array_position(items, x) == k + 1))
    return F.transform(own, lambda x: F.struct(x.alias("term"), (x == F.get(items, F.lit(0))).alias("first")))


def _senses(e: DataFrame) -> DataFrame:
    """Entries with several senses, some of which repeat pieces, and some entries without glosses."""
    g = F.array(F.concat_ws("; ", "headword", F.lower("pack")), F.concat(F.lit("To "), "source", F.lit(", "), F.upper("headword"), F.lit(",an item that is far too long to be looked up by")), *(F.concat(F.lit(f"p{k} "), "kind") for k in range(12)))
    glosses = F.when(F.col("id") % 4 == 0, F.array().cast(NONE)).otherwise(g)
    defs = F.when(F.col("id") % 8 == 0, F.array().cast(NONE)).otherwise(F.array(F.lit(""), F.repeat(F.concat("headword", F.lit(" ")), F.lit(20))))
    return e.select("id", "headword", glosses.alias("glosses"), defs.alias("defs"), F.array(F.concat(F.lit("뜻 "), "headword")).alias("ko_defs"))


_PIECES = "[headword, lower(pack), 'To ' || source || ', ' || upper(headword) || ',an item that is far too long to be looked up by', " + ", ".join(f"'p{k} ' || kind" for k in range(12)) + "]"
_DEF = "repeat(headword || ' ', 20)"
_CUT = "CASE WHEN length({0}) > {1} THEN rtrim(left({0}, {2})) || '…' ELSE {0} END"


@query("prj02_entry_gloss", f"{W} SELECT id, CASE WHEN id % 8 = 0 THEN '뜻 ' || headword WHEN id % 4 = 0 THEN {_CUT.format(_DEF, 120, 119)} ELSE array_to_string(p[1:list_max([k for k in range(1, 16) if length(array_to_string(p[1:k], '; ')) <= 120])], '; ') END AS gloss FROM (SELECT *, {_PIECES} AS p FROM entries)")
def entry_gloss_query(spark, d):
    return _senses(entries(spark, d)).select("id", entry_gloss(F.col("glosses"), F.col("defs"), F.col("ko_defs")).alias("gloss"))


@query("prj03_search_text", f"{W} SELECT id, CASE WHEN id % 4 = 0 THEN '' ELSE array_to_string(p[1:12], ' ; ') END AS head, array_to_string(list_concat(CASE WHEN id % 4 = 0 THEN [] ELSE p[13:] END, CASE WHEN id % 8 = 0 THEN [] ELSE [{_CUT.format(_DEF, 300, 299)}] END), ' ; ') AS en FROM (SELECT *, {_PIECES} AS p FROM entries)")
def search_text_query(spark, d):
    return _senses(entries(spark, d)).select("id", search_text(F.col("glosses"), F.col("defs")).alias("t")).select("id", "t.*")


@query("prj04_gloss_items", f"{W} SELECT DISTINCT id, term, term = headword AS first FROM (SELECT id, headword, unnest([headword, lower(pack), lower(source), " + ", ".join(f"'p{k} ' || kind" for k in range(12)) + "]) AS term FROM entries WHERE id % 4 <> 0)")
def gloss_items_query(spark, d):
    return _senses(entries(spark, d)).select("id", F.explode(gloss_items(F.col("glosses"))).alias("i")).select("id", "i.*")


# Routes and leaks

_HANGUL, _HAN = "[가-힣ㄱ-ㆎᄀ-ᇿ]", "[一-鿿㐀-䶿]"


def route(q: Column) -> Column:
    """How a normalised query is searched: by initials, as mixed script, as Hangul, as hanja, or as English."""
    others = F.filter(F.split(q, " "), lambda t: ~t.rlike(_HANGUL))
    mixed = F.exists(others, lambda t: t.rlike(r"[\p{L}\p{N}]"))
    korean = F.when(q.rlike(f"^[{INITIALS}]{{2,6}}$"), "initials").when(mixed, "mixed").otherwise("hangul")
    return F.when(q == "", "none").when(q.rlike(_HANGUL), korean).when(q.rlike(_HAN), "han").otherwise("english")


_ROUTED = ["ㅂㄷ", "바다", "바다 ", "바다 學", "學", "", "ㅂ"]


@query("flt19_script_routing", f"{W}, q AS (SELECT id, trim(h || CASE WHEN id % 2 = 0 THEN ' ' || headword ELSE '' END) AS q FROM (SELECT id, headword, [{', '.join(f"'{x.strip()}'" for x in _ROUTED)}][id % {len(_ROUTED)} + 1] AS h FROM entries)) SELECT id, CASE WHEN q = '' THEN 'none' WHEN regexp_full_match(q, '[{INITIALS}]{{2,6}}') THEN 'initials' WHEN regexp_matches(q, '{_HANGUL}') THEN CASE WHEN regexp_matches(q, '[a-z]') OR contains(q, '學') THEN 'mixed' ELSE 'hangul' END WHEN contains(q, '學') THEN 'han' ELSE 'english' END AS route FROM q")
def route_query(spark, d):
    head = F.element_at(F.array(*(F.lit(x.strip()) for x in _ROUTED)), (F.col("id") % len(_ROUTED) + 1).cast("int"))
    q = F.trim(F.concat(head, F.when(F.col("id") % 2 == 0, F.concat(F.lit(" "), "headword")).otherwise("")))
    return entries(spark, d).select("id", route(q).alias("route"))


#: Markup and licence headings that a text must not hold.
LEAKS = ["{{", "}}", "[[", "]]", "<pages", "<ref", "__TOC__", "PD-old", "=="]
LICENCE_HEADINGS = ["## 라이선스", "## 저작권", "## License", "## Copyright"]


def raw_problem(paragraphs: Column) -> Column:
    """The code of what keeps a text from being packed, or null: ``markup`` of a wiki, a ``licence`` heading, three or more ``lost`` letters that became question marks, no ``text`` besides headings."""
    lines = F.array_join(paragraphs, "\n")
    leaks = F.exists(F.array(*map(F.lit, LEAKS)), lambda x: F.contains(lines, x))
    headed = F.arrays_overlap(F.transform(paragraphs, lambda p: F.trim(p)), F.array(*map(F.lit, LICENCE_HEADINGS)))
    bare = F.forall(paragraphs, lambda p: F.ltrim(p).startswith("## ") | (F.trim(p) == ""))
    found = [("markup", leaks), ("licence", headed), ("lost", F.regexp_count(lines, F.lit(r"\?(?=[가-힣])")) >= 3), ("text", bare)]
    return F.get(F.filter(F.array(*(F.when(on, code) for code, on in found)), lambda x: x.isNotNull()), F.lit(0))


@query("flt15_markup_leak", "SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'markup' WHEN 2 THEN 'licence' WHEN 3 THEN 'lost' WHEN 4 THEN 'text' END AS problem FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents) WHERE NOT list_bool_or([contains(x, '{{') OR contains(x, '}}') OR contains(x, '[[') OR contains(x, ']]') OR contains(x, '<pages') OR contains(x, '<ref') OR contains(x, '__TOC__') OR contains(x, 'PD-old') OR contains(x, '==') for x in p]) AND list_bool_or([trim(x) <> '' AND NOT starts_with(ltrim(x), '## ') for x in p])")
def raw_problem_query(spark, d):
    """Documents with one fault added to each by turns, where they have none of their own."""
    p = F.split("text", "\n")
    k = F.col("doc_id") % 5
    wrong = F.when(k == 1, F.concat(p, F.array(F.lit("see [[x]]")))).when(k == 2, F.concat(p, F.array(F.lit(" ## License ")))).when(k == 3, F.concat(p, F.array(F.lit("?가 ?나"), F.lit("봄?이")))).when(k == 4, F.array(F.lit("## a"), F.lit(" "))).otherwise(p)
    own = raw_problem(p)
    return table(spark, d, "documents").filter(own.isNull()).select("doc_id", raw_problem(wrong).alias("problem"))


# Homographs

def unique_fill(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (id, source, surface, hanja) with hanja filled from known (surface, hanja) where the source has the surface once and known has one hanja for it."""
    once = rows.groupBy("source", "surface").agg(F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    one = known.groupBy("surface").agg(F.min("hanja").alias("_hanja"), F.countDistinct("hanja").alias("_k")).filter("_k = 1").drop("_k")
    found = once.join(one, "surface")
    return rows.join(found, ["source", "surface"], "left").withColumn("hanja", F.coalesce("hanja", "_hanja")).drop("_hanja")


@query("jn18_unique_fill", f"{W}, r AS (SELECT id, source, hw_norm AS surface, CASE WHEN id % 3 = 0 THEN 'own' END AS hanja FROM entries), k AS (SELECT hw_norm AS surface, CASE WHEN length(hw_norm) % 2 = 0 THEN 'one' ELSE pack END AS hanja FROM entries), o AS (SELECT source, surface FROM r GROUP BY ALL HAVING count(*) = 1), u AS (SELECT surface, min(hanja) AS h FROM k GROUP BY surface HAVING count(DISTINCT hanja) = 1) SELECT r.id, coalesce(r.hanja, CASE WHEN o.surface IS NOT NULL THEN u.h END) AS hanja FROM r LEFT JOIN o ON o.source = r.source AND o.surface = r.surface LEFT JOIN u ON u.surface = r.surface")
def unique_fill_query(spark, d):
    e = entries(spark, d)
    rows = e.select("id", "source", F.col("hw_norm").alias("surface"), F.when(F.col("id") % 3 == 0, "own").alias("hanja"))
    known = e.select(F.col("hw_norm").alias("surface"), F.when(F.length("hw_norm") % 2 == 0, "one").otherwise(F.col("pack")).alias("hanja"))
    return unique_fill(rows, known).select("id", "hanja")


def gloss_words(gloss: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(gloss, F.lit(""))), "[^a-z]+"), lambda w: (F.length(w) > 2) & (w != "the")))


def fold_homographs(rows: DataFrame) -> DataFrame:
    """(id, into): rows (id, headword, hanja, gloss) without hanja with the hanja of their headword whose glosses share most words with theirs; the only one takes any row, of several the best must be alone and share a word."""
    homes = rows.filter("hanja IS NOT NULL").groupBy("headword", "hanja").agg(F.array_distinct(F.flatten(F.collect_set(gloss_words(F.col("gloss"))))).alias("theirs"))
    homes = homes.groupBy("headword").agg(F.collect_list(F.struct("hanja", "theirs")).alias("homes"))  # the hanja of one headword
    bare = rows.filter("hanja IS NULL").select("id", "headword", gloss_words(F.col("gloss")).alias("mine")).join(homes, "headword")
    scored = F.transform("homes", lambda h: F.struct(F.size(F.array_intersect(F.col("mine"), h["theirs"])).alias("n"), h["hanja"].alias("hanja")))
    best = bare.select("id", F.sort_array(scored, asc=False).alias("s"))
    top, second = F.get("s", F.lit(0)), F.get("s", F.lit(1))
    alone = F.size("s") == 1
    return best.select("id", F.when(alone | ((top["n"] > 0) & (top["n"] > second["n"])), top["hanja"]).alias("into"))


@query(
    "jn29_homograph_fold",
    f"""{W}, r AS (SELECT id, headword, CASE WHEN id % 3 > 0 THEN CASE WHEN headword < 'd' THEN 'only' ELSE source END END AS hanja, lower(pack) || ' the ' || kind AS gloss FROM entries),
h AS (SELECT headword, hanja, flatten(list(string_split(gloss, ' '))) AS theirs FROM r WHERE hanja IS NOT NULL GROUP BY ALL),
s AS (SELECT r.id, h.hanja, len(list_intersect(list_filter(string_split(r.gloss, ' '), lambda w: w <> 'the'), h.theirs)) AS n FROM r JOIN h USING (headword) WHERE r.hanja IS NULL),
m AS (SELECT id, count(*) AS homes, max(n) AS best, arg_max(hanja, n) AS hanja FROM s GROUP BY id),
t AS (SELECT id, count(*) AS ties FROM s JOIN m USING (id) WHERE s.n = m.best GROUP BY id)
SELECT id, CASE WHEN homes = 1 OR (best > 0 AND ties = 1) THEN hanja END AS into FROM m JOIN t USING (id)""",
)
def fold_homographs_query(spark, d):
    hanja = F.when(F.col("id") % 3 > 0, F.when(F.col("headword") < "d", "only").otherwise(F.col("source")))
    return fold_homographs(entries(spark, d).select("id", "headword", hanja.alias("hanja"), F.concat(F.lower("pack"), F.lit(" the "), "kind").alias("gloss")))


# Queries

@query("qry06_fts_tokens", "SELECT item_id, CASE WHEN len(t) > 0 THEN '\"' || array_to_string(t, '\" \"') || '\"*' END AS q FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')[1:8] AS t FROM benchmark)")
def fts_query(spark, d):
    """Up to eight words of a query, each quoted, the last as a prefix; null without words."""
    t = F.slice(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != ""), 1, 8)
    return table(spark, d, "benchmark").select("item_id", F.when(F.size(t) > 0, F.concat(F.lit('"'), F.array_join(t, '" "'), F.lit('"*'))).alias("q"))


def sentences(rows: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Sentences (id, ko, en) that hold a text, whatever the case of its Latin letters: translated ones first, then short ones."""
    return rows.filter(F.lower("ko").contains(text.lower())).orderBy(F.col("en").isNull(), F.length("ko"), "id").limit(limit)


@query("qry15_sentences", "SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'the') ORDER BY source IS NULL OR doc_id % 3 = 0, length(text), doc_id LIMIT 20")
def sentences_query(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("ko"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("en"))
    return sentences(rows, "The").select("id")


PHRASES, PHRASE_WORDS = 30, 6


def phrases(rows: DataFrame, q: str) -> DataFrame:
    """(n, term, words): terms (term, ko, rank) that begin with the query and a space, then those that hold its words further on; short ones first, thirty at most, six words each."""
    words = F.split("term", " ")
    run = F.array(*map(F.lit, q.split(" ")))
    later = F.exists(F.sequence(F.lit(2), F.greatest(F.size(words), F.lit(2))), lambda k: F.slice(words, k, F.size(run)) == run)
    begins = F.col("term").startswith(q + " ")
    terms = rows.filter(begins | later).groupBy("term").agg(F.array_sort(F.collect_list(F.struct("rank", "ko"))).alias("all"))
    terms = terms.orderBy(~F.col("term").startswith(q + " "), F.length("term"), "term").limit(PHRASES)
    n = F.row_number().over(Window.orderBy(~F.col("term").startswith(q + " "), F.length("term"), "term"))  # thirty rows
    return terms.select(n.alias("n"), "term", F.slice(F.array_distinct(F.transform("all", lambda x: x["ko"])), 1, PHRASE_WORDS).alias("words"))


@query("qry20_phrases", f"{W}, t AS (SELECT term, ko, min(rank) AS rank FROM (SELECT headword || CASE WHEN id % 2 = 0 THEN ' hot ' || kind ELSE '' END AS term, source AS ko, rank FROM entries) GROUP BY ALL), c AS (SELECT DISTINCT term FROM t WHERE starts_with(term, 'hot ') OR contains(substr(term, instr(term, ' ')) || ' ', ' hot ')), n AS (SELECT term, row_number() OVER (ORDER BY NOT starts_with(term, 'hot '), length(term), term) AS n FROM c) SELECT n, n.term, array_to_string(list(ko ORDER BY rank, ko)[1:6], ',') AS words FROM n JOIN t ON t.term = n.term WHERE n <= 30 GROUP BY n, n.term")
def phrases_query(spark, d):
    term = F.concat("headword", F.when(F.col("id") % 2 == 0, F.concat(F.lit(" hot "), "kind")).otherwise(""))
    rows = entries(spark, d).select(term.alias("term"), F.col("source").alias("ko"), "rank")
    return phrases(rows, "hot").select("n", "term", F.array_join("words", ",").alias("words"))


@query("qry28_chain_check", f"{W}, w AS (SELECT unnest(['Red Gear', 'hot-rod', 'x', '', 'nothing here']) AS word) SELECT word, arg_min(e.id, (CASE WHEN e.level IS NOT NULL THEN 0 ELSE 1000000 END + e.rank) * 1000000 + e.id) AS id FROM w JOIN entries e ON e.hw_norm = translate(lower(trim(word)), ' -^', '') AND e.kind = 'word' WHERE length(translate(lower(trim(word)), ' -^', '')) >= 2 GROUP BY word")
def chain_check(spark, d):
    """Whether a word that a player says is a noun of two syllables or more, and its best entry."""
    w = spark.createDataFrame([(x,) for x in ("Red Gear", "hot-rod", "x", "", "nothing here")], "word string")
    w = w.withColumn("hw_norm", F.translate(F.lower(F.trim("word")), " -^", "")).filter("length(hw_norm) >= 2")
    score = (F.when(F.col("level").isNotNull(), 0).otherwise(1_000_000) + F.col("rank")) * 1_000_000 + F.col("id")
    return w.join(entries(spark, d).filter("kind = 'word'"), "hw_norm").groupBy("word").agg(F.min_by("id", score).alias("id"))


@query("snk05_meta", f"{W} SELECT '{{\"entries\":' || (SELECT count(*) FROM entries) || ',\"forms\":' || (SELECT count(DISTINCT (headword, id)) FROM entries) || ',\"sources\":{{' || (SELECT string_agg('\"' || source || '\":' || n, ',' ORDER BY source) FROM (SELECT source, count(*) AS n FROM entries GROUP BY source)) || '}}}}' AS meta")
def meta(spark, d):
    """Counts of tables and sources, as JSON."""
    e = entries(spark, d)
    by = e.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("headword", "id").alias("f"))  # a row a source
    sources = F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "n"))))
    return by.agg(F.to_json(F.struct(F.sum("n").alias("entries"), F.sum("f").alias("forms"), sources.alias("sources"))).alias("meta"))


# Stems of frequent forms

#: Endings by which a form shows its stem.
ENDINGS = (
    "어 아 여 어요 아요 여요 었 았 였 었어 았어 였어 었어요 았어요 었다 았다 었는데 았는데 고 지 지만 지는 지요 면 으면 서 어서 아서 니 으니 네 네요 자 게 도록 는 은 을 ㄴ ㄹ "
    "는데 은데 을까 을게 을래 을 거 을거 는다 ㄴ다 습니다 ㅂ니다 세요 으세요 십시오 으십시오 려고 으려고 ㄹ 려 러 으러 며 으며 기 음 ㅁ 다 냐 니까 으니까 어도 아도 어야 아야 어라 아라 거나 다가 더니 던 ㄹ까"
).split()


def stem_ranks(ranks: DataFrame) -> DataFrame:
    """(stem, rank): the best rank of a form (word, rank) that is a stem and an ending; 해 and 했 show a stem in 하."""
    endings = F.broadcast(ranks.sparkSession.createDataFrame([(e,) for e in dict.fromkeys([*ENDINGS, ""])], "rest string"))  # the list above
    cut = ranks.select("rank", "word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("k")).filter("length(word) > 1")
    cut = cut.select("rank", F.left("word", F.col("k")).alias("stem"), F.substr("word", F.col("k") + 1).alias("tail"))
    plain = cut.select("rank", "stem", F.col("tail").alias("rest")).filter("rest <> ''")
    ha = cut.filter(F.left("tail", F.lit(1)).isin("해", "했")).select("rank", F.concat("stem", F.lit("하")).alias("stem"), F.substr("tail", F.lit(2)).alias("rest"))
    return plain.unionByName(ha).join(endings, "rest", "left_semi").groupBy("stem").agg(F.min("rank").alias("rank"))


FORMS_BY_RANK = ["먹어요", "먹고", "말했어요", "말해", "시작했다", "가는데", "가", "좋은", "좋다", "해", "school", "닫는다"]


@query("ag16_min_stem_rank", f"WITH e AS (SELECT unnest([{', '.join(f"'{e}'" for e in dict.fromkeys(ENDINGS))}]) AS rest), c AS (SELECT n AS rank, left(word, k) AS stem, substr(word, k + 1) AS tail FROM (SELECT n, word, unnest(range(1, length(word))) AS k FROM {values(FORMS_BY_RANK)})), s AS (SELECT rank, stem FROM c WHERE tail IN (SELECT rest FROM e) UNION ALL SELECT rank, stem || '하' FROM c WHERE tail[1] IN ('해', '했') AND (substr(tail, 2) = '' OR substr(tail, 2) IN (SELECT rest FROM e))) SELECT stem, min(rank) AS rank FROM s GROUP BY stem")
def stem_ranks_query(spark, d):
    return stem_ranks(listed(spark, d, FORMS_BY_RANK).select("word", F.col("n").alias("rank")))

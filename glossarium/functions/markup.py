"""Markup of dictionaries and wikis: entities and tags, glosses, wikitext, headings, boilerplate, kinds of pages."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from glossarium.functions.text import truncate
from glossarium.plans.registry import query
from glossarium.plans.tables import ENTRIES, entries, table

W = f"WITH {ENTRIES}"

# Entities and tags

#: Named entities that dictionaries use.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "middot": "·", "hellip": "…"}
#: Tags that fall with what they hold, that become a space, and that fall alone.
DROP_TAGS = "hanja word_no sp_no each_sense_no equ_no"
BREAK_TAGS = "br dr hr"
KEEP_TAGS = "sub sup i b u em strong span a fl in equ p div font sp small"

_ENTITY = re.compile(r"&(#[xX][0-9a-fA-F]+|#[0-9]+|[a-z]+);")


def _named(m: re.Match) -> str:
    name = m[1]
    if not name.startswith("#"):
        return ENTITIES.get(name, m[0])
    code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]


@F.pandas_udf(StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    """Text with its entities read once, so that an escaped entity stays one."""
    return text.map(lambda t: None if t is None else _ENTITY.sub(_named, t)).astype(object)


def _tag(names: str) -> str:
    return rf"(?i)<\s*/?\s*(?:{names.replace(' ', '|')})(?:\s[^<>]{{0,50}})?/?\s*>"


def strip_markup(text: Column) -> Column:
    """Text without known tags; other angle brackets stay."""
    whole = rf"(?is)<\s*({DROP_TAGS.replace(' ', '|')})(?:\s[^<>]{{0,50}})?(?<!/)>.*?</\1>"
    text = F.regexp_replace(F.regexp_replace(text, whole, ""), _tag(DROP_TAGS), "")
    return F.regexp_replace(F.regexp_replace(text, _tag(BREAK_TAGS), " "), _tag(KEEP_TAGS), "")


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(strip_markup(html_unescape(text)), r"[\s 　]+", " "))


def clean_ko(text: Column) -> Column:
    """clean, without the braces that mark quoted and dialect words."""
    return F.translate(clean(text), "{}", "")


@query("str03_clean", "SELECT p_partkey, p_name || ' xA<' || p_type || ' <unknown> &lt; a < b' AS text FROM part")
def clean_query(spark, d):
    """Part names inside markup come out as they were."""
    raw = F.concat(F.lit("<b>"), F.replace("p_name", F.lit(" "), F.lit("<br/>\n")), F.lit("</b> <sp_no n='1'>12</sp_no>x&#65;<FL>&lt;</FL>{"), F.col("p_type"), F.lit("}&nbsp;<unknown> &amp;lt; a < b<hanja/>"))
    return table(spark, d, "part").select("p_partkey", clean_ko(raw).alias("text"))


# Glosses

_EDGE = r"\s,;:\-–—/\\|\"'`~*+="


def clean_gloss(text: Column) -> Column:
    """A gloss without control characters, stray punctuation at its edges and spaces before commas."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"\p{Cntrl}", " "), r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, f"^[{_EDGE}.]+", ""), f"[{_EDGE}]+$", ""), " +,", ",")


#: Words that keep their capital.
PROPER = """
Korea Korean Koreans Seoul Pacific Atlantic Japan Japanese China Chinese English America American
Asia Asian Europe European Buddha Buddhist Buddhism God Christ Christian Christianity Confucian
Confucius Catholic Islam Muslim Jesus Monday Tuesday Wednesday Thursday Friday Saturday Sunday
January February March April May June July August September October November December
Russia Russian France French Germany German England British Britain India Indian Mongol Mongolia
Manchu Manchuria Pyongyang Busan Jeju Silla Goryeo Joseon Baekje Goguryeo Hanguk Hangeul Hangul
Latin Greek Sanskrit Taoism Taoist Shinto Africa African Australia Canada Mr Mrs Ms Dr
""".split()


def normalize_case(gloss: Column) -> Column:
    """Each item of a gloss in lower case where only its position gave it a capital."""

    def one(item: Column) -> Column:
        word = F.regexp_extract(item, "^[A-Za-z']+", 0)
        return F.when(word.rlike("^(A|[A-Z][a-z]+)$") & ~word.isin(PROPER), F.concat(F.lower(F.left(item, F.lit(1))), F.substr(item, F.lit(2)))).otherwise(item)

    return F.array_join(F.transform(F.split(gloss, "; "), one), "; ")


_SQL_EDGE = r"\s,;:\-–—/\\|\"''`~*+="


@query(
    "str09_gloss_case",
    f"""{W}, g AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(raw, '\\s+', ' ', 'g')), '^[{_SQL_EDGE}.]+', ''), '[{_SQL_EDGE}]+$', ''), ' +,', ',', 'g') AS clean FROM (SELECT id, ' .,' || upper(left(headword, 1)) || substr(headword, 2) || ' ,to ' || pack || '; Korean ' || headword || '; A ' || source || '; TV set; I''m;  -' AS raw FROM entries))
SELECT id, clean, array_to_string([CASE WHEN regexp_full_match(regexp_extract(s, '^[A-Za-z'']+'), 'A|[A-Z][a-z]+') AND regexp_extract(s, '^[A-Za-z'']+') NOT IN ({", ".join(f"'{w}'" for w in PROPER)}) THEN lower(left(s, 1)) || substr(s, 2) ELSE s END for s in string_split(clean, '; ')], '; ') AS gloss FROM g""",
)
def gloss_case_query(spark, d):
    e = entries(spark, d)
    name = F.concat(F.upper(F.left("headword", F.lit(1))), F.substr("headword", F.lit(2)))
    raw = F.concat(F.lit(" .,"), name, F.lit(" ,to "), "pack", F.lit("; Korean "), "headword", F.lit("; A "), "source", F.lit("; TV set; I'm;  -"))
    return e.select("id", clean_gloss(raw).alias("clean")).select("id", "clean", normalize_case(F.col("clean")).alias("gloss"))


def make_gloss(items: Column, limit: int) -> Column:
    """The first items that fit within limit characters, joined; a first one that doesn't fit is cut."""
    some = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    start = F.struct(F.lit("").alias("text"), F.lit(True).alias("going"))

    def step(acc: Column, x: Column) -> Column:
        longer = F.when(acc["text"] == "", x).otherwise(F.concat(acc["text"], F.lit("; "), x))
        fits = acc["going"] & (F.length(longer) <= limit)
        return F.struct(F.when(fits, longer).when(acc["going"] & (acc["text"] == ""), truncate(x, limit)).otherwise(acc["text"]).alias("text"), fits.alias("going"))

    return F.aggregate(some, start, step)["text"]


_PIECES = "list_filter([trim(x) for x in [headword, lower(pack), 'a rather long piece of a gloss', source, headword || ' ' || pack]], lambda x: x <> '')"


def _make_gloss_sql(items: str, limit: int) -> str:
    fitting = f"list_max([k for k in range(1, len({items}) + 1) if length(array_to_string(({items})[1:k], '; ')) <= {limit}])"
    cut = f"CASE WHEN length(({items})[1]) > {limit} THEN rtrim(left(({items})[1], {limit - 1})) || '…' ELSE ({items})[1] END"
    return f"coalesce(array_to_string(({items})[1:{fitting}], '; '), {cut}, '')"


@query("str04_make_gloss", f"{W} SELECT id, {_make_gloss_sql(_PIECES, 40)} AS middle, {_make_gloss_sql(_PIECES, 9)} AS short FROM entries")
def make_gloss_query(spark, d):
    items = F.array("headword", F.lower("pack"), F.lit("a rather long piece of a gloss"), "source", F.concat_ws(" ", "headword", "pack"))
    return entries(spark, d).select("id", make_gloss(items, 40).alias("middle"), make_gloss(items, 9).alias("short"))


# Wikitext

#: Namespaces whose links show nothing.
SILENT_NAMESPACES = "file image category 파일 그림 분류"
_OPENERS = re.compile(r"<!--|<nowiki>|<ref\b[^<>]*/>|<ref\b[^<>]*>|\{\{|\{\||\[\[|\[(?=[a-z]+://)|</?[a-zA-Z][^<>]*>|'{2,}|__[A-Z]+__")


def _closing(text: str, at: int, opening: str, closing: str) -> int:
    """Behind the bracket that closes the one opened just before at; the text's end where none does."""
    depth, step = 1, re.compile(re.escape(opening) + "|" + re.escape(closing))
    while depth:
        m = step.search(text, at)
        if not m:
            return len(text)
        depth += 1 if m[0] == opening else -1
        at = m.end()
    return at


def _until(text: str, mark: str, at: int) -> int:
    found = text.find(mark, at)
    return len(text) if found < 0 else found


def _inline(text: str, depth: int = 0) -> str:
    """Text without its inline markup: what is shown of links stays, what templates and tables hold goes."""
    out, at = [], 0
    for_next = _OPENERS.search(text, at)
    while for_next:
        out.append(text[at : for_next.start()])
        mark, at = for_next[0], for_next.end()
        if mark == "<!--":
            at = _until(text, "-->", at) + 3
        elif mark == "<nowiki>":
            end = _until(text, "</nowiki>", at)
            out.append(text[at:end])
            at = end + 9
        elif mark.startswith("<ref"):
            at = at if mark.endswith("/>") else _until(text, "</ref>", at) + 6
        elif mark == "{{":
            at = _closing(text, at, "{{", "}}")
        elif mark == "{|":
            at = _closing(text, at, "{|", "|}")
        elif mark == "[[":
            end = _closing(text, at, "[[", "]]")
            inner = text[at : end - 2] if text[at:end].endswith("]]") else text[at:end]
            target, _, shown = inner.partition("|")
            if target.strip().split(":")[0].lower() not in SILENT_NAMESPACES.split():
                shown = shown or target.lstrip(":")
                out.append(_inline(shown, depth + 1) if depth < 20 else shown)
            at = end
        elif mark == "[":
            end = _until(text, "]", at)
            out.append(text[at:end].partition(" ")[2])
            at = end + 1
        elif re.match(r"<br\b", mark, re.I):
            out.append("\n")
        for_next = _OPENERS.search(text, at)
    return "".join(out) + text[at:]


def plain_wikitext(text: str | None) -> str | None:
    """A wiki page as text: headings as ## lines, list marks dropped, poems by line, paragraphs apart by an empty line."""
    if text is None:
        return None
    lines = []
    for line in _ENTITY.sub(_named, _inline(text)).split("\n"):
        heading = re.fullmatch(r"(={1,6})\s*(.+?)\s*\1\s*", line)
        lines.append(f"\n## {heading[2]}\n" if heading else re.sub(r"^[*#:;]+\s*", "", line).strip())
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


@F.pandas_udf(StringType())
def wikitext(text: pd.Series) -> pd.Series:
    return text.map(plain_wikitext).astype(object)


@query("str20_wikitext", f"{W} SELECT id, '## ' || headword || chr(10) || chr(10) || headword || ' is ' || pack || ' and ' || source || '.' || chr(10) || 'first ' || kind || chr(10) || kind || ' & more' AS text FROM entries")
def wikitext_query(spark, d):
    """Entries written as wiki pages, with every kind of markup, come out as their text."""
    h, pack, source, kind = (F.col(c) for c in ("headword", "pack", "source", "kind"))
    page = F.concat(
        F.lit("{{Infobox|name={{x|"), h, F.lit("}}}}<!-- "), source, F.lit(" -->== "), h, F.lit(" ==\n__TOC__[[File:a.png|thumb|[[x]] y]]"),
        F.lit("'''"), h, F.lit("''' is [["), pack, F.lit("]] and [["), pack, F.lit("|''"), source, F.lit("'']].<ref name=a>see {{c}}</ref><ref name=b />\n"),
        F.lit("{| class=t\n|-\n| cell {| in |}\n|}* first <small>"), kind, F.lit("</small>[[Category:"), kind, F.lit("]]\n# [http://example.org/"), source, F.lit(" "), kind, F.lit("] <nowiki>&amp;</nowiki> more\n\n"),
    )
    return entries(spark, d).select("id", wikitext(page).alias("text"))


@query("str26_strip_wikitext", "SELECT doc_id, trim(regexp_replace(source || ' ' || lang || ' ' || n_chars, '\\s+', ' ', 'g')) AS text FROM documents")
def strip_wikitext_query(spark, d):
    """For corpora: one line of text a page."""
    c = F.concat(F.lit("[[x|"), "source", F.lit("]]{{t|\n|"), "lang", F.lit("}}\n* '''"), "lang", F.lit("'''<ref>"), "lang", F.lit("</ref>\n"), F.col("n_chars").cast("string"))
    return table(spark, d, "documents").select("doc_id", F.trim(F.regexp_replace(wikitext(c), r"\s+", " ")).alias("text"))


# Pages and headings

#: Words of edition pages, and of the templates that mark pages of versions.
EDITION_WORDS = "판 본 필사 이본 edition version".split()
VERSION_TEMPLATES = "판본 동음이의 versions disambig 다의어 중의 이본 버전".split()


def link_targets(text: Column, title: Column) -> Column:
    """Pages that a wikitext links to, once each; /x is a page below the title, and namespaces are left out."""
    targets = F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#]*)"), F.lit(1)), lambda t: F.trim(F.replace(t, F.lit("_"), F.lit(" "))))
    targets = F.filter(targets, lambda t: (t != "") & (~t.contains(":") | t.startswith("/")))
    return F.array_distinct(F.transform(targets, lambda t: F.when(t.startswith("/"), F.concat(title, t)).otherwise(t)))


def page_kind(title: Column, text: Column, plain: Column, subpages: Column) -> Column:
    """The code of a page that only lists others, or null: ``versions`` by a template, ``editions`` where a short page and its subpages name two or more, ``stub`` for next to no text."""
    of = lambda values, seen: F.exists(F.array(*map(F.lit, values)), lambda v: F.contains(F.lower(seen), v))
    templates = F.regexp_extract_all(text, F.lit(r"\{\{([^|}\n]*)"), F.lit(1))
    own = F.filter(link_targets(text, title), lambda t: (t != title) & F.contains(t, title))
    editions = F.size(F.filter(F.concat(own, subpages), lambda t: of(EDITION_WORDS, t)))
    length = F.length(plain)
    kinds = [("versions", F.exists(templates, lambda n: of(VERSION_TEMPLATES, n))), ("editions", (length < 3000) & (editions > 1)), ("stub", (length < 10) & (F.size(subpages) == 0))]
    return F.coalesce(*(F.when(on, code) for code, on in kinds))


@query("utl06_page_kind", f"{W} SELECT id, CASE WHEN id % 5 = 0 THEN 'versions' WHEN id % 5 = 1 THEN 'editions' WHEN id % 5 = 2 THEN 'stub' END AS why FROM entries")
def page_kind_query(spark, d):
    """Pages made from entries, one of each kind in turn."""
    h, k = F.col("headword"), F.col("id") % 5
    text = F.when(k == 0, F.concat(F.lit("{{Versions|"), h, F.lit("}} long text"))).when(k == 1, F.concat(F.lit("[["), h, F.lit(" 1 edition]] [[/second version|x]] [[Talk:"), h, F.lit("]]"))).when(k == 2, "short").otherwise(F.concat(F.lit("[["), h, F.lit(" edition]] and a text of some length")))
    subpages = F.when(k == 2, F.array().cast("array<string>")).otherwise(F.array(F.concat(h, F.lit("/notes"))))
    return entries(spark, d).select("id", page_kind(h, text, text, subpages).alias("why"))


def under_headings(text: Column, names: list[str]) -> Column:
    """The paragraphs from each ## heading that holds one of the names up to the next heading that doesn't."""
    wanted = F.array(*map(F.lit, names))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("on"))

    def step(acc: Column, p: Column) -> Column:
        on = F.when(p.startswith("## "), F.exists(wanted, lambda n: F.contains(F.substr(p, F.lit(4)), n))).otherwise(acc["on"])
        return F.struct(F.when(on, F.concat(acc["kept"], F.array(p))).otherwise(acc["kept"]).alias("kept"), on.alias("on"))

    return F.array_join(F.aggregate(F.split(text, "\n\n"), start, step)["kept"], "\n\n")


@query("utl08_under_headings", f"{W} SELECT id, CASE kind WHEN 'word' THEN '## About word' || chr(10) || chr(10) || headword || chr(10) || chr(10) || source ELSE '' END AS text FROM entries")
def under_headings_query(spark, d):
    page = F.concat(F.lit("preface\n\n## About "), "kind", F.lit("\n\n"), "headword", F.lit("\n\n"), "source", F.lit("\n\n## Notes\n\nnone"))
    return entries(spark, d).select("id", under_headings(page, ["word"]).alias("text"))


def strip_boilerplate(raw: Column) -> Column:
    """A public-domain book's text between its start and end marks; all of it where they are missing."""
    begun = F.regexp_replace(raw, r"(?s)^.*?\*\*\* START OF[^\n]*(\n|$)", "")
    return F.trim(F.regexp_replace(begun, r"(?s)\*\*\* END OF.*$", ""))


@query("utl10_strip_boilerplate", "SELECT item_id, regexp_replace(trim(text), '^\\s+|\\s+$', '', 'g') AS text FROM benchmark")
def strip_boilerplate_query(spark, d):
    book = F.when(F.col("item_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("The book\nLicence\n*** START OF THIS BOOK ***\n"), F.trim("text"), F.lit("\n*** END OF THIS BOOK ***\nMore *** END OF it")))
    return table(spark, d, "benchmark").select("item_id", F.regexp_replace(F.trim(strip_boilerplate(book)), r"^\s+|\s+$", "").alias("text"))


# Pages of a history database

def strip_page_markers(text: Column) -> Column:
    return F.regexp_replace(text, "<[0-9-]{1,12}>|＜[0-9-]{1,12}＞", "")


def is_citation(line: Column) -> Column:
    """A line that names the volume and pages that a text is printed on."""
    t = F.trim(line)
    return (F.length(t) < 60) & t.endswith("面") & t.rlike("[第輯集]")


def cut_between(text: Column, begin: str | None, end: str | None) -> Column:
    """The lines from the first that holds begin up to, not including, the first later one that holds end; null without begin."""
    lines = F.split(text, "\n")
    at = F.lit(1).cast("long") if begin is None else F.array_position(F.transform(lines, lambda x: F.contains(x, F.lit(begin))), F.lit(True))
    later = F.slice(lines, at.cast("int") + 1, F.size(lines))
    n = F.lit(0).cast("long") if end is None else F.array_position(F.transform(later, lambda x: F.contains(x, F.lit(end))), F.lit(True))
    rest = F.when(n == 0, later).otherwise(F.slice(later, F.lit(1), F.greatest(n.cast("int") - 1, F.lit(0))))
    return F.when(at > 0, F.trim(F.array_join(F.concat(F.slice(lines, F.greatest(at, F.lit(1)).cast("int"), F.lit(1)), rest), "\n")))


@F.pandas_udf(StringType())
def _mapped(text: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else t.translate(str.maketrans(dict(zip(a, b)))) for t, a, b in zip(text, old, new)], dtype=object)


def from_private_use(text: Column, mapping: dict[str, str]) -> Column:
    """Text with its private-use characters as the letters that the mapping, a table of the font's maker, gives for them."""
    return _mapped(text, F.array(*map(F.lit, mapping)), F.array(*map(F.lit, mapping.values())))


@query("str25_history_pages", f"{W} SELECT id, headword || ' x' AS marked, (kind = 'word') AS citation, CASE WHEN kind = 'idiom' THEN NULL ELSE 'from ' || headword || chr(10) || source END AS cut, chr(4370) || chr(4510) || headword AS letters FROM entries")
def history_pages_query(spark, d):
    h, word = F.col("headword"), F.col("kind") == "word"
    page = F.when(F.col("kind") == "idiom", "nothing here").otherwise(F.concat(F.lit("before\nfrom "), h, F.lit("\n"), "source", F.lit("\nthe end\nfrom after")))
    return entries(spark, d).select(
        "id",
        strip_page_markers(F.concat(F.lit("<406>"), h, F.lit("＜12-18＞ x<9>"))).alias("marked"),
        is_citation(F.concat(F.when(word, F.lit("韓國獨立運動 第一集 ")).otherwise(F.lit("二〇")), F.lit("二〇-二一面"))).alias("citation"),
        cut_between(page, "from ", "the end").alias("cut"),
        from_private_use(F.concat(F.lit("\ue000"), h), {"\ue000": "\u1112\u119e"}).alias("letters"),
    )

"""The longest known beginning of every place of many texts.

A place of a text is a window, as many characters as the longest key has.
Texts are cut into stretches that end where the next one begins, each with the
character before it and a window's length behind it, so places are found and
looked up where the text lies: no window moves. Keys that a task can hold are
grouped by their first characters, and a place looks through the one group
that its own first characters name.

More keys than that meet the windows in order. In the sorted union of windows
and keys, the key before a window begins with every key that the window begins
with: whatever sorts between a string and its beginning begins with that too.
So a window needs the one key before it, and of that key's own beginnings
(found once for each key) the longest that they share. Windows that repeat are
looked up once; no prefix of a text is a row.

All keys that stand at a place are beginnings of the longest one there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossarium.operators.numbering import carried
from glossarium.plans.registry import query
from glossarium.plans.tables import table
from glossarium.sources.shared import cut

#: Keys of more characters are not looked for.
MOST_CHARS = 40
#: Letters and digits of ASCII and what lies beyond it make words.
_IN_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Behind a character of ASCII, so that no pair of surrogates is split.
WORD_STARTS = f"(?<={_IN_WORD.replace('^', '')})(?={_IN_WORD})"
EVERY_PLACE = ""
#: Characters of the blocks of a text, of their parts, and of the stretches cut from these: a piece is found by counting characters from the beginning.
PARTS = (1 << 15, 1 << 11, 1 << 7)
#: So many keys go to every task; more are sorted together with the windows.
MOST_KEYS = 50_000
#: Keys with the same first characters that a place looks through, as far as DEEPEST characters tell them apart.
MOST_OF_A_GRAM, DEEPEST = 16, 5
#: Other characters than those of Latin-1 that a filter names one by one.
MOST_NAMED = 64


def lower(c: Column) -> Column:
    """A-Z lower-cased; the text's length stays."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def chains(keys: DataFrame) -> DataFrame:
    """(key, chain): the lengths of the known beginnings of each distinct key, itself included, ascending."""
    own = keys.select("key").filter((F.length("key") > 0) & (F.length("key") <= MOST_CHARS)).distinct()
    begun = own.select("key", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n")).select("key", "n", F.left("key", F.col("n")).alias("begin"))
    return begun.join(own.select(F.col("key").alias("begin")), "begin", "left_semi").groupBy("key").agg(F.sort_array(F.collect_list("n")).alias("chain"))


def beginnings(windows: DataFrame, keys: DataFrame) -> DataFrame:
    """(window, lens): for each distinct window the lengths of the keys that it begins with, ascending; windows without one are left out."""
    known = chains(keys).select(F.col("key").alias("at"), F.lit(0).alias("kind"), F.struct("key", "chain").alias("own"))
    asked = windows.select(F.col("window").alias("at")).distinct().withColumn("kind", F.lit(1)).withColumn("own", F.lit(None).cast(known.schema["own"].dataType))
    near = carried(known.unionByName(asked), ["at", "kind"], "own", "before").filter("kind = 1 AND before IS NOT NULL")
    shared = F.filter("before.chain", lambda n: F.left("at", n) == F.left("before.key", n))
    return near.select(F.col("at").alias("window"), shared.alias("lens")).filter(F.size("lens") > 0)


def _cut_text(texts: DataFrame, size: int, ahead: int, kept: list[str]) -> DataFrame:
    """texts (at, text: one character before its first place, then its places) in parts of ``size`` places with the ``ahead`` characters behind them."""
    parts = F.transform(F.sequence(F.lit(0), F.length("text") - 2, F.lit(size)), lambda k: F.struct((F.col("at") + k).alias("at"), F.substring("text", k + 1, F.lit(1 + size + ahead)).alias("text"), F.least(F.col("places") - k, F.lit(size)).alias("places")))
    return texts.filter("places > 0").select(*kept, F.inline(parts))


def windows_of(texts: DataFrame, starts: str = WORD_STARTS, size: int = MOST_CHARS) -> DataFrame:
    """(id, start, window) of texts (id, text): ``size`` characters from each place where the pattern splits a text, by code points from 0; other columns of texts stay.

    A text counts as if a line's end stood before it.
    """
    kept = [c for c in texts.columns if c != "text"]
    whole = texts.filter("text IS NOT NULL").select(*kept, F.lit(0).cast("long").alias("at"), F.concat(F.lit("\n"), "text").alias("text"), F.length("text").alias("places"))
    parts = whole
    for n in PARTS:
        parts = _cut_text(parts, n, size, kept)
    if starts == EVERY_PLACE:
        at = parts.select(*kept, "at", "text", F.explode(F.sequence(F.lit(1), "places")).alias("k"))
    else:
        # a fold over the pieces of a stretch, whose first is the character before it and what no place divides from it
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
        ends = F.aggregate(F.split("text", starts), none, lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.array_append(a["found"], a["at"] + F.length(p)).alias("found")))
        at = parts.select(*kept, "at", "text", "places", F.explode(ends["found"]).alias("k")).filter("k <= places")
    return at.select(*kept, (F.col("at") + F.col("k") - 1).alias("start"), F.substring("text", F.col("k") + 1, F.lit(size)).alias("window")).filter("window <> ''")


def _known(keys: DataFrame) -> tuple[DataFrame, int, int, int]:
    """The distinct keys as a table, their number, and the least and most characters of one."""
    known = cut(keys.select("key").filter((F.length("key") > 0) & (F.length("key") <= MOST_CHARS)).distinct(), "keys")
    of = known.agg(F.count("*").alias("n"), F.min(F.length("key")).alias("least"), F.max(F.length("key")).alias("most")).first()
    return known, of["n"], of["least"] or 0, of["most"] or 0


def _may_begin(known: DataFrame, letters: int) -> str:
    """A pattern of the places where each of the first ``letters`` characters is one that some key has there."""
    firsts = known.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(letters)), lambda k: F.struct(k.alias("k"), F.substring("key", k, F.lit(1)).alias("c")))).alias("x")).select("x.*").distinct()
    at: dict[int, set[int]] = {}
    for r in firsts.collect():  # characters, not keys
        at.setdefault(r["k"], set()).add(ord(r["c"]))
    out = ""
    for k in sorted(at):
        near, far = sorted(c for c in at[k] if c < 256), sorted(c for c in at[k] if c >= 256)
        named = "".join(f"\\x{{{c:x}}}" for c in near + (far if len(far) <= MOST_NAMED else []))
        # no half of a pair of surrogates is a place
        out += f"[{named}]" if len(far) <= MOST_NAMED else f"[{named}[^\\x00-\\xFF\\x{{DC00}}-\\x{{DFFF}}]]"
    return f"(?={out})"


def _look_up(windows: DataFrame, known: DataFrame, least: int, most: int) -> DataFrame:
    """windows (window) with the longest key (key) that each begins with; windows without one are left out. Keys of few characters are met by equality, longer ones in groups by their first characters."""
    q = F.explode(F.sequence(F.lit(least), F.least(F.length("key"), F.lit(DEEPEST))))
    grams = known.filter(F.length("key") <= DEEPEST).select("key", q.alias("q")).unionByName(known.filter(F.length("key") > DEEPEST).select("key", F.explode(F.sequence(F.lit(min(least, DEEPEST)), F.lit(DEEPEST))).alias("q")))
    hot = {r["q"]: r["n"] for r in grams.groupBy("q", F.left("key", F.col("q")).alias("gram")).agg(F.count("*").alias("n")).groupBy("q").agg(F.max("n").alias("n")).collect()}
    deep = next((n for n in sorted(hot) if hot[n] <= MOST_OF_A_GRAM), max(hot))
    levels, out = list(range(min(least, deep), deep + 1)), windows
    for n in levels:
        own = known.filter(F.length("key") >= n) if n == deep else known.filter(F.length("key") == n)
        longest_first = F.transform(F.array_sort(F.collect_list(F.struct((-F.length("key")).alias("n"), "key"))), lambda x: x["key"])
        node = own.groupBy(F.left("key", F.lit(n)).alias(f"_g{n}")).agg(longest_first.alias(f"_k{n}"))
        out = out.withColumn(f"_g{n}", F.left("window", F.lit(n))).join(F.broadcast(node), f"_g{n}", "inner" if len(levels) == 1 else "left")  # MOST_KEYS keys at most
    found = [F.get(F.filter(f"_k{n}", lambda k: F.startswith(F.col("window"), k)), F.lit(0)) for n in reversed(levels)]
    return out.withColumn("key", F.coalesce(*found)).drop(*(f"_{x}{n}" for n in levels for x in "gk")).filter("key IS NOT NULL")


def matches(texts: DataFrame, keys: DataFrame, starts: str = WORD_STARTS) -> DataFrame:
    """(id, start, len, key): at each place of texts (id, text; ids are distinct) the longest of the keys (key) that stands there; other columns of texts stay."""
    known, n, least, most = _known(keys)
    kept = [c for c in texts.columns if c not in ("id", "text")]
    if n == 0:
        return texts.select("id", F.lit(0).cast("long").alias("start"), F.lit(0).alias("len"), F.lit("").alias("key"), *kept).limit(0)
    windows = windows_of(texts, _may_begin(known, min(least, 4)) if starts == EVERY_PLACE else starts, most)
    if n <= MOST_KEYS:
        found = _look_up(windows, known, least, most).withColumn("len", F.length("key"))
    else:
        found = windows.join(beginnings(windows, known).select("window", F.array_max("lens").alias("len")), "window").withColumn("key", F.left("window", F.col("len")))
    return found.select("id", "start", "len", "key", *kept)


def all_hits(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, start, key): every place of texts (id, text) where a key (key) stands, hits in hits too; other columns of texts stay."""
    found = matches(texts, keys, EVERY_PLACE)
    begun = cut(chains(keys), "chains")
    kept = [c for c in found.columns if c not in ("key", "len")]
    return found.join(begun, "key").select(*kept, F.explode(F.transform("chain", lambda n: F.left("key", n))).alias("key"))


def leftmost(found: DataFrame) -> DataFrame:
    """Of matches (id, start, len; other columns stay) those that a reader takes from the left: each next one begins where the last has ended, or later.

    A place that no match before it reaches begins a stretch of its own, and
    within a stretch the choice is a fold, so a long text is many short folds.
    """
    w = Window.partitionBy("id").orderBy("start")
    reach = F.max(F.col("start") + F.col("len")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    parted = found.withColumn("fresh", F.when(F.coalesce(reach <= F.col("start"), F.lit(True)), 1).otherwise(0))
    parted = parted.withColumn("stretch", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    alone = parted.withColumn("size", F.count("*").over(Window.partitionBy("id", "stretch")))
    one = alone.filter("size = 1").select("id", *(own := [c for c in found.columns if c != "id"]))
    spans = F.array_sort(F.collect_list(F.struct("start", "len", *(c for c in own if c not in ("start", "len")))))
    more = alone.filter("size > 1").groupBy("id", "stretch").agg(spans.alias("s"))
    none = F.filter("s", lambda x: F.lit(False))

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        return F.when((F.size(acc) == 0) | (last["start"] + last["len"] <= x["start"]), F.concat(acc, F.array(x))).otherwise(acc)

    chosen = more.select("id", F.explode(F.aggregate("s", none, step)).alias("x")).select("id", "x.*")
    return one.unionByName(chosen)


def extensions(asked: DataFrame, entries: DataFrame, most: int = 25) -> DataFrame:
    """(q, n, pack, id) of entries (id, pack, rank, key) whose key goes on from a query (q), at most ``most`` a pack by rank and id.

    The beginnings of keys meet the queries by equality; a query that many
    keys begin with keeps a pack's first ones before anything else moves.
    """
    begun = entries.filter(F.length("key") > 1).select("id", "pack", "rank", "key", F.explode(F.sequence(F.lit(1), F.least(F.length("key") - 1, F.lit(100)))).alias("k"))
    hits = begun.select("id", "pack", "rank", F.left("key", F.col("k")).alias("q")).join(asked.select("q").distinct(), "q")
    n = F.row_number().over(Window.partitionBy("q", "pack").orderBy("rank", "id"))
    return hits.select("q", n.alias("n"), "pack", "id").filter(F.col("n") <= most)


# Queries: words and pairs of words of the benchmark's items, in the documents.

def _keys(spark, d) -> DataFrame:
    words = F.filter(F.split(lower(F.col("text")), "[^a-z]+"), lambda w: F.length(w) >= 2)
    items = table(spark, d, "benchmark").select(words.alias("w"))
    single = items.select(F.explode("w").alias("key"))
    # beginnings too, so that keys nest
    begun = single.select(F.left("key", F.lit(2)).alias("key")).unionByName(single.select(F.left("key", F.lit(4)).alias("key")))
    pairs = items.select(F.explode(F.transform(F.slice("w", 2, 10_000), lambda b, k: F.concat(F.get("w", k), F.lit(" "), b))).alias("key"))
    return single.unionByName(begun).unionByName(pairs).distinct()


_KEYS = """i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z]+'), lambda x: length(x) >= 2) AS w FROM benchmark),
s AS (SELECT unnest(w) AS key FROM i), keys AS MATERIALIZED (SELECT DISTINCT key, length(key) AS n FROM (SELECT key FROM s UNION ALL SELECT left(key, 2) FROM s UNION ALL SELECT left(key, 4) FROM s
  UNION ALL SELECT w[k] || ' ' || w[k + 1] FROM (SELECT w, unnest(range(1, len(w))) AS k FROM i)) WHERE length(key) <= 40)"""
_PLACES = r"""t AS (SELECT doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE text IS NOT NULL),
pc AS (SELECT id, k, p FROM (SELECT id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*')) AS p,
  generate_subscripts(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*'), 1) AS k FROM t)),
st AS (SELECT id, length(regexp_extract(text, '^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*')) AS lead FROM t),
pl AS (SELECT id, CAST(lead + coalesce(sum(length(p)) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
  p || coalesce(string_agg(p, '') OVER (PARTITION BY id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING), '') AS win FROM pc JOIN st USING (id)),
m AS MATERIALIZED (SELECT id, start, max(n) AS len FROM (SELECT pl.id, pl.start, l.n, left(win, l.n) AS key FROM pl, (SELECT DISTINCT n FROM keys) l) JOIN keys USING (key, n) GROUP BY ALL)"""


def _texts(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), lower(F.col("text")).alias("text"))


@query("srt14_longest_spans", f"WITH {_KEYS}, {_PLACES} SELECT id, start, CAST(len AS INT) AS len FROM m")
def longest_spans(spark, d):
    return matches(_texts(spark, d), _keys(spark, d)).select("id", "start", "len")


@query(
    "qry23_leftmost_spans",
    f"""WITH {_KEYS}, {_PLACES}, f AS (SELECT id, list_reduce(list_prepend({{'a': CAST(0 AS BIGINT), 'e': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT), 'c': CAST(0 AS BIGINT), 'z': CAST(0 AS BIGINT)}},
  list({{'a': start, 'e': start + len, 'n': CAST(0 AS BIGINT), 'c': CAST(0 AS BIGINT), 'z': CAST(0 AS BIGINT)}} ORDER BY start)),
  lambda s, x: CASE WHEN x.a >= s.e THEN {{'a': x.a, 'e': x.e, 'n': s.n + 1, 'c': s.c + x.e - x.a, 'z': s.z + x.a * (x.e - x.a)}} ELSE s END) AS r FROM m GROUP BY id)
SELECT id, r.n AS n, r.c AS covered, r.z AS checksum FROM f""",
)
def leftmost_spans(spark, d):
    """What a reader finds from the left in each document: how many spans, how much they cover, and a sum that tells one choice from another."""
    chosen = leftmost(matches(_texts(spark, d), _keys(spark, d)).drop("key"))
    return chosen.groupBy("id").agg(F.count("*").alias("n"), F.sum("len").alias("covered"), F.sum(F.col("start") * F.col("len")).alias("checksum"))


@query("qry11_extensions", f"WITH {_KEYS}, e AS (SELECT p_partkey AS id, p_type AS pack, CAST(round(p_retailprice * 100) AS BIGINT) AS rank, p_name AS key FROM part), q AS (SELECT DISTINCT left(p_name, 3) AS q FROM part UNION SELECT DISTINCT string_split(p_name, ' ')[1] FROM part UNION SELECT DISTINCT left(key, 2) FROM keys) SELECT q, CAST(n AS INT) AS n, pack, id FROM (SELECT q, pack, id, row_number() OVER (PARTITION BY q, pack ORDER BY rank, id) AS n FROM q JOIN e ON starts_with(key, q) AND key <> q) WHERE n <= 25")
def extensions_query(spark, d):
    p = table(spark, d, "part")
    e = p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("pack"), F.round(F.col("p_retailprice") * 100).cast("long").alias("rank"), F.col("p_name").alias("key"))
    asked = p.select(F.left("p_name", F.lit(3)).alias("q")).union(p.select(F.get(F.split("p_name", " "), F.lit(0)))).union(_keys(spark, d).select(F.left("key", F.lit(2))))
    return extensions(asked, e)

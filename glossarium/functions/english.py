"""English query words: base forms of inflected words, and the one to search instead of an unknown word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossarium.plans.registry import query
from glossarium.plans.tables import ENTRIES, FORMS, forms, table

#: Irregular forms after their base, in alphabetical order of the bases.
IRREGULAR_FORMS = """
bad: worse worst
be: am are been being is was were
bear: bore born
begin: began begun
bend: bent
bite: bit bitten
blow: blew blown
break: broke broken
bring: brought
build: built
buy: bought
catch: caught
child: children
choose: chose chosen
come: came
dig: dug
do: did does done
draw: drawn drew
drink: drank drunk
drive: driven drove
eat: ate eaten
fall: fallen fell
far: farther further
feed: fed
feel: felt
fight: fought
find: found
flee: fled
fly: flew flown
foot: feet
forget: forgot forgotten
freeze: froze frozen
get: got gotten
give: gave given
go: gone went
good: best better
goose: geese
grow: grew grown
half: halves
hang: hung
have: had has
hear: heard
hide: hid hidden
hold: held
keep: kept
knife: knives
know: knew known
lay: laid
lead: led
leaf: leaves
leave: left
lend: lent
life: lives
light: lit
lose: lost
make: made
man: men
mean: meant
meet: met
mouse: mice
pay: paid
person: people
ride: ridden rode
ring: rang
rise: risen rose
run: ran
say: said
see: saw seen
seek: sought
sell: sold
send: sent
shake: shaken shook
shelf: shelves
shoot: shot
sing: sang sung
sink: sank
sit: sat
sleep: slept
slide: slid
speak: spoke spoken
spend: spent
stand: stood
steal: stole stolen
stick: stuck
strike: struck
swim: swam
take: taken took
teach: taught
tear: tore torn
tell: told
think: thought
throw: threw thrown
tooth: teeth
understand: understood
wake: woke woken
wear: wore worn
wife: wives
win: won
wolf: wolves
woman: women
write: written wrote
"""

IRREGULAR = {form: base for line in IRREGULAR_FORMS.strip().splitlines() for base, rest in [line.split(": ")] for form in rest.split()}

#: Regular endings in the order in which they are undone: (ending, what takes its place, whether a doubled consonant before it becomes single).
ENDINGS = [
    *((s, "y", False) for s in ("ies", "ied", "ier", "iest", "ily")),
    *(rule for s in ("ing", "ed", "er", "est") for rule in ((s, "", True), (s, "", False), (s, "e", False))),
    *((s, "", False) for s in ("es", "s", "ly", "ness")),
]


def en_lemmas(w: Column) -> Column:
    """Candidates for the base form of a lower-case word, likeliest first; none for null."""
    found = []
    for ending, to, single in ENDINGS:
        stem = F.left(w, F.length(w) - len(ending))
        fits = w.endswith(ending)
        if single:
            fits, stem = fits & stem.rlike(r"[^ ]([^aeiouslz])\1$"), F.left(stem, F.length(stem) - 1)
        found.append(F.when(fits & w.rlike("^[a-z-]{4,}$"), F.concat(stem, F.lit(to))))
    pairs = F.create_map(*(F.lit(x) for pair in IRREGULAR.items() for x in pair))
    every = F.array(F.when(w.isNotNull(), F.try_element_at(pairs, w)), *found)
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (F.length(x) >= 2) & (x != w)))


def base_forms(queries: DataFrame, known: DataFrame) -> DataFrame:
    """(q, base) for single words q that known (term) lacks: their first candidate that it has."""
    single = queries.select("q").distinct().filter(~F.col("q").contains(" ")).join(known.select(F.col("term").alias("q")), "q", "left_anti")
    tried = single.select("q", F.posexplode(en_lemmas(F.col("q"))).alias("k", "term"))
    return tried.join(known.select("term").distinct(), "term", "left_semi").groupBy("q").agg(F.min_by("term", "k").alias("base"))


def _lemmas_sql() -> str:
    """DuckDB's rows (w, k, lemma) for a table words(w)."""
    parts = ["SELECT w, -1 AS k, base AS lemma FROM words JOIN (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in IRREGULAR.items()) + ") i(form, base) ON form = w"]
    for k, (ending, to, single) in enumerate(ENDINGS):
        stem = f"left(w, length(w) - {len(ending)})"
        fits = f"ends_with(w, '{ending}') AND regexp_full_match(w, '[a-z-]{{4,}}')"
        if single:
            fits += f" AND length({stem}) >= 3 AND {stem}[-1] = {stem}[-2] AND {stem}[-1] NOT IN ('a', 'e', 'i', 'o', 'u', 's', 'l', 'z')"
            stem = f"left(w, length(w) - {len(ending) + 1})"
        parts.append(f"SELECT w, {k}, {stem} || '{to}' FROM words WHERE {fits}")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE length(lemma) >= 2 AND lemma <> w"


_INFLECTED = "SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z-]+')) AS w FROM benchmark UNION SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z-]+')) FROM conversations UNION SELECT * FROM (VALUES " + ", ".join(f"('{x}')" for x in sorted(IRREGULAR)) + ")"


@query("ud04_en_lemmas", f"WITH words AS ({_INFLECTED}) SELECT DISTINCT w, lemma FROM ({_lemmas_sql()})")
def en_lemmas_query(spark, d):
    words = [table(spark, d, t).select(F.explode(F.split(F.lower("text"), "[^a-z-]+")).alias("w")) for t in ("benchmark", "conversations")]
    words.append(spark.createDataFrame([(w,) for w in sorted(IRREGULAR)], "w string"))
    every = words[0].union(words[1]).union(words[2]).distinct()
    return every.select("w", F.explode(en_lemmas(F.col("w"))).alias("lemma"))


#: What the query adds to known words: some give a word that only its base form answers.
SUFFIXES = ["", "s", "es", "ing", "ed", "er", "ly", "ness"]


@query("qry18_base_form", f"WITH {ENTRIES}, {FORMS}, known AS (SELECT DISTINCT form AS term FROM forms), words AS (SELECT DISTINCT term || s AS w FROM known, (VALUES " + ", ".join(f"('{s}')" for s in SUFFIXES) + f") t(s)), c AS ({_lemmas_sql()}) SELECT w AS q, arg_min(lemma, k) AS base FROM c WHERE w NOT IN (SELECT term FROM known) AND lemma IN (SELECT term FROM known) GROUP BY w")
def base_form_query(spark, d):
    known = forms(spark, d).select(F.col("form").alias("term")).distinct()
    asked = known.select(F.explode(F.transform(F.array(*map(F.lit, SUFFIXES)), lambda s: F.concat("term", s))).alias("q"))
    return base_forms(asked, known)

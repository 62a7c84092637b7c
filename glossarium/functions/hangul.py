"""Hangul syllables by code-point arithmetic, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossarium.functions.writing import listed, values
from glossarium.plans.registry import query

#: The initial consonants, in the order of the code points.
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
#: The vowels, in the order of the code points.
VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
#: The final consonants, in the order of the code points; the first stands for none.
FINALS = " ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"
FIRST, LAST = 0xAC00, 0xD7A3

SAMPLE = ["학교", "가다", "춥다", "닭고기", "school", "학교 가다", "", "값", "읽다", "ㄱ"]


_VALUES = values(SAMPLE)


def chars(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda c: c != "")


def initials(word: Column) -> Column:
    """The initial consonants of a word; null unless every character is a syllable."""
    one = lambda c: F.substring(F.lit(INITIALS), F.floor((F.ascii(c) - FIRST) / 588).cast("int") + 1, F.lit(1))
    return F.when(word.rlike(f"^[가-힣]+$"), F.array_join(F.transform(chars(word), one), ""))


def jamo(word: Column) -> Column:
    """Syllables taken apart into initial, vowel and final; other characters stay."""

    def one(c: Column) -> Column:
        k = F.ascii(c) - FIRST
        at = lambda s, i: F.substring(F.lit(s), i.cast("int") + 1, F.lit(1))
        parts = F.concat(at(INITIALS, F.floor(k / 588)), at(VOWELS, F.floor(k % 588 / 28)), F.trim(at(FINALS, k % 28)))
        return F.when(c.rlike("[가-힣]"), parts).otherwise(c)

    return F.array_join(F.transform(chars(word), one), "")


def has_final(word: Column) -> Column:
    """Whether the last syllable ends in a consonant; null where the last character isn't a syllable."""
    last = F.right(word, F.lit(1))
    return F.when(last.rlike("[가-힣]"), (F.ascii(last) - FIRST) % 28 != 0)


@query("str06_choseong", f"SELECT n, CASE WHEN regexp_full_match(word, '[가-힣]+') THEN array_to_string([substr('{INITIALS}', CAST((unicode(c) - 44032) // 588 + 1 AS INT), 1) for c in string_split(word, '')], '') END AS cho FROM {_VALUES}")
def choseong_query(spark, d):
    return listed(spark, d, SAMPLE).select("n", initials(F.col("word")).alias("cho"))


@query("str07_scripts", f"SELECT n, regexp_matches(word, '[가-힣]') AS hangul, regexp_matches(word, '[一-鿿]') AS han, regexp_matches(word, '[A-Za-z]') AS latin FROM {_VALUES}")
def scripts(spark, d):
    w = F.col("word")
    return listed(spark, d, SAMPLE).select("n", w.rlike("[가-힣]").alias("hangul"), w.rlike("[一-鿿]").alias("han"), w.rlike("[A-Za-z]").alias("latin"))


@query("str08_jamo", f"SELECT n, coalesce(array_to_string([CASE WHEN regexp_matches(c, '[가-힣]') THEN substr('{INITIALS}', CAST((unicode(c) - 44032) // 588 + 1 AS INT), 1) || substr('{VOWELS}', CAST((unicode(c) - 44032) % 588 // 28 + 1 AS INT), 1) || trim(substr('{FINALS}', CAST((unicode(c) - 44032) % 28 + 1 AS INT), 1)) ELSE c END for c in string_split(word, '')], ''), '') AS jamo FROM {_VALUES}")
def jamo_query(spark, d):
    return listed(spark, d, SAMPLE).select("n", jamo(F.col("word")).alias("jamo"))


@query("str08_batchim", f"SELECT n, CASE WHEN regexp_matches(right(word, 1), '[가-힣]') THEN (unicode(right(word, 1)) - 44032) % 28 != 0 END AS final FROM {_VALUES}")
def batchim_query(spark, d):
    return listed(spark, d, SAMPLE).select("n", has_final(F.col("word")).alias("final"))

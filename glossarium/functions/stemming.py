"""Porter's stemmer."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def porter(word: str) -> str:
    """Porter's stemmer of 1980."""
    if len(word) <= 2:
        return word
    vowel = lambda w, k: w[k] in "aeiou" or w[k] == "y" and k > 0 and not vowel(w, k - 1)
    shape = lambda w: "".join("v" if vowel(w, k) else "c" for k in range(len(w)))
    measure = lambda w: len(re.findall("v+c+", shape(w)))
    has_vowel = lambda w: "v" in shape(w)
    double = lambda w: len(w) > 1 and w[-1] == w[-2] and not vowel(w, len(w) - 1)
    short = lambda w: shape(w)[-3:] == "cvc" and w[-1] not in "wxy"

    def rules(w: str, table: str, ok) -> str:
        for rule in table.split():
            old, new = rule.split(":")
            if w.endswith(old):
                stem = w[: len(w) - len(old)]
                return stem + new if ok(stem, old) else w
        return w

    w = rules(word, "sses:ss ies:i ss:ss s:", lambda s, _: True)
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and has_vowel(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and short(w):
                    w += "e"
                break
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    positive = lambda s, _: measure(s) > 0
    w = rules(w, "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble", positive)
    w = rules(w, "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:", positive)
    w = rules(w, "al: ance: ence: er: ic: able: ible: ant: ement: ment: ent: ion: ou: ism: ate: iti: ous: ive: ize:", lambda s, old: measure(s) > 1 and (old != "ion" or s.endswith(("s", "t"))))
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not short(w[:-1])):
        w = w[:-1]
    return w[:-1] if measure(w) > 1 and double(w) and w.endswith("l") else w


@lru_cache(1 << 17)
def _known(word: str) -> str:
    return porter(word)


@F.pandas_udf(ArrayType(StringType()))
def stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: [_known(w) for w in ws])

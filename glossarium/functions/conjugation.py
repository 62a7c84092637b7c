"""Dictionary forms of inflected Korean words.

A word is written in decomposed jamo, where final and initial consonants are
different characters, so that an ending which is half a syllable (the ㅂ니다 of
갑니다) is a plain suffix. An ending says what it may follow:

- ``any``: the bare stem;
- ``eu``: a stem in a vowel or ㄹ, or a consonant stem with 으 between;
- ``a``: the infinitive, that is the stem with 아 or 어, mostly contracted.

Undoing the ending gives stems, which may themselves be a stem with a prefinal
part or an auxiliary verb; then the search goes on. Candidates are ordered by
cost: each step costs, irregular stems cost, explained jamo earn.

Defined results: null, empty and non-Hangul words have no candidates; at most
``most`` are returned, each lemma once, with the endings found for it.
"""

from __future__ import annotations

import heapq
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from glossarium.functions.writing import listed
from glossarium.plans.registry import query


def _split(text: str) -> str:
    """Decomposed jamo; lone compatibility consonants (as in ㅂ니다) stand for finals."""
    finals = dict(zip("ㄴㄹㅁㅂㅆ", "ᆫᆯᆷᆸᆻ"))
    return unicodedata.normalize("NFD", "".join(finals.get(c, c) for c in text))


def _join(text: str) -> str:
    return unicodedata.normalize("NFC", text)


#: Endings after the bare stem.
ANY = "다 고 지 지요 죠 지만 는 는데 는데요 는군요 는구나 는다 는지 군요 구나 네 네요 게 게요 기 도록 던 던데 더라 더라고요 자 자고 자마자 거든요 거나 습니다 습니까 고서 든지 느라고 니 냐 소"
#: Endings after a vowel or ㄹ, or with 으 after a consonant.
EU = "면 면서 니까 니 려고 려면 러 며 므로 나 세요 셔요 십시오 십니다 시오 ㄴ ㄴ데 ㄴ데요 ㄴ지 ㄴ다 ㄴ다고 ㄴ대 ㄴ대요 ㄹ ㄹ게 ㄹ게요 ㄹ까 ㄹ까요 ㄹ래 ㄹ래요 ㄹ지 ㄹ수록 ㄹ거예요 ㅁ ㅂ니다 ㅂ니까 ㅂ시다 라고 ㄹ|거예요 ㄹ|것이다 ㄹ|것|같아요 ㄴ|것|같아요 ㄴ|적이|있어요"
#: Endings after the infinitive; the first is none.
A = " 요 서 도 야 라 라고 야지 야겠다 서요 도요 야지요"
#: Parts that stand between a stem and its ending, auxiliaries included, and what they follow.
INNER = [
    ("ㅆ", "a", "past"), ("시", "eu", "honorific"), ("겠", "any", "future"), ("고|싶", "any", "wish"), ("고|있", "any", "progress"), ("지|않", "any", "negation"), ("지|말", "any", "prohibition"), ("지|못하", "any", "inability"),
    ("야|하", "a", "duty"), ("야|되", "a", "duty"), ("도|되", "a", "permission"), ("면|되", "eu", "condition"), ("ㄹ|수|있", "eu", "ability"), ("ㄹ|수|없", "eu", "inability"), ("려고|하", "eu", "intention"), ("게|되", "any", "change"),
    ("|주", "a", "favour"), ("|보", "a", "attempt"), ("|있", "a", "state"), ("|버리", "a", "completion"), ("주", "a", "favour"), ("보", "a", "attempt"), ("지", "a", "change"), ("|드리", "a", "favour"),
]
#: Particles by what the noun before them ends in (any, a consonant, a vowel).
PARTICLES = {
    "any": "에 에서 에게 한테 께 도 의 만 까지 부터 처럼 보다 하고 들 에는 에서는 에도 마다 밖에 조차 마저 에게서 한테서 께서 대로 같이",
    "final": "이 을 은 과 으로 이랑 이나 이에요 입니다 이다 이었다 이었어요 이라고 이라서 이면",
    "open": "가 를 는 와 로 랑 나 예요 입니다 이다 였다 였어요 라고 라서 면",
}

_I, _V, _F = (lambda c: "ᄀ" <= c <= "ᄒ"), (lambda c: "ᅡ" <= c <= "ᅵ"), (lambda c: "ᆨ" <= c <= "ᇂ")
_L, _D, _S, _B, _H = "ᆯ", "ᆮ", "ᆺ", "ᆸ", "ᇂ"
_IEUNG, _RIEUL, _HIEUH = "ᄋ", "ᄅ", "ᄒ"
_a, _ae, _ya, _yae, _eo, _e, _yeo, _ye = "ᅡ", "ᅢ", "ᅣ", "ᅤ", "ᅥ", "ᅦ", "ᅧ", "ᅨ"
_o, _wa, _wae, _oe, _u, _wo, _eu, _i = "ᅩ", "ᅪ", "ᅫ", "ᅬ", "ᅮ", "ᅯ", "ᅳ", "ᅵ"
#: What a contracted vowel of the infinitive may come from, and how rare that is.
CONTRACTED = {
    _a: [(_a, 0), (_eu, 2)], _eo: [(_eo, 1), (_eu, 1), (_u, 5)], _wa: [(_o, 0)], _wo: [(_u, 0)], _yeo: [(_i, 0), (_yeo, 1)],
    _ae: [(_ae, 1), (_a + _H, 2), (_eo + _H, 2)], _e: [(_e, 1), (_eo + _H, 4)], _wae: [(_oe, 0)], _yae: [(_ya + _H, 1)], _ye: [(_ye, 2), (_yeo + _H, 3)],
}


def _after(s: str, kind: str, ending: str) -> list[tuple[str, int]]:
    """The stems that, before such an ending, are written s; each with a cost."""
    if not s or not (_V(s[-1]) or _F(s[-1])):
        return []
    begins, open_ = ending[:1], _V(s[-1])
    dropped = begins in (_split("ㄴ"), _split("ㅂ"), _split("ㄹ"), "ᄂ", "ᄉ")
    if kind == "any":
        return [(s, 0)] + ([(s + _L, 2)] if open_ and begins in ("ᄂ", "ᄉ") else [])
    if kind == "eu":
        out = []
        if open_:
            out.append((s, 0))
            if dropped:
                out.append((s + _L, 2))
            if s[-1] in (_a, _ya, _eo, _yeo) and len(s) > 3:
                out.append((s + _H, 2))
            if s.endswith(_IEUNG + _u) and len(s) > 2 and _V(s[-3]):
                out.append((s[:-2] + _B, 1))
        elif s.endswith(_L) and not dropped:
            out.append((s, 0))
        if s.endswith(_IEUNG + _eu) and len(s) > 2:
            t = s[:-2]
            out += [(t, 0)] if _F(t[-1]) and t[-1] != _L else [(t + _S, 1)] if _V(t[-1]) else [(t[:-1] + _D, 1)]
        return out
    out = []
    if not open_:
        return out
    if s[-2:] in (_IEUNG + _a, _IEUNG + _eo) and len(s) > 2:
        t = s[:-2]
        out.append((t, 0 if _F(t[-1]) else 3))
        if t.endswith(_L):
            out.append((t[:-1] + _D, 1))
        elif _V(t[-1]):
            out.append((t + _S, 1))
    if s[-2:] in (_IEUNG + _wa, _IEUNG + _wo) and len(s) > 2 and _V(s[-3]):
        out.append((s[:-2] + _B, 0))
    if s[-3:] in (_L + _RIEUL + _a, _L + _RIEUL + _eo):
        out.append((s[:-3] + _RIEUL + _eu, 0))
    if s.endswith(_RIEUL + _eu + _RIEUL + _eo):
        out.append((s[:-2], 0))
    if s[-2:] in (_HIEUH + _ae, _HIEUH + _a + _IEUNG + _yeo):
        out.append((s[: s.rindex(_HIEUH)] + _HIEUH + _a, 0))
    out += [(s[:-1] + v, c) for v, c in CONTRACTED.get(s[-1], [])]
    return out


def _rows(text: str, kind: str) -> list[tuple[str, str, str]]:
    return [(_split(e.replace("|", " ")), kind, e.replace("|", " ")) for e in text.split(" ") if e or kind == "a"]


ENDINGS = list(dict.fromkeys(_rows(ANY, "any") + _rows(EU, "eu") + _rows(A, "a")))
_INNER = [(_split(e.replace("|", " ")), kind, rule) for e, kind, rule in INNER]
_NOUN = [(_split(p), where, p) for where, text in PARTICLES.items() for p in text.split()]
STEP, EARNED, PARTICLE = 4, 2, 1


def candidates(word: str | None, most: int = 40, depth: int = 5) -> list[tuple[str, str]]:
    """(lemma, rule) of a word, the likeliest first."""
    word = " ".join((word or "").split())
    if not word or not all("가" <= c <= "힣" or c == " " for c in word):
        return []
    whole = _split(word)
    queue: list[tuple[int, int, str, str]] = []
    best: dict[str, tuple[int, str]] = {}
    said = 0

    def push(stem: str, cost: int, rule: str) -> None:
        nonlocal said
        said += 1
        heapq.heappush(queue, (cost, said, stem, rule))

    def lemma(text: str, cost: int, rule: str) -> None:
        if text and text != word and " " not in text and (text not in best or cost < best[text][0]):
            best[text] = (cost, rule)

    for e, kind, rule in ENDINGS:
        if whole.endswith(e) and len(e) < len(whole):
            for stem, cost in _after(whole[: len(whole) - len(e)], kind, e):
                push(stem, cost + STEP - EARNED * len(e), f"-{rule or '어'}")
    if whole.endswith(_split("세요")) and len(word) > 2:  # verbs with 시 of their own, as 계시다
        push(whole[: -len(_split("세요"))] + _split("시"), STEP + 1 - EARNED * 4, "-세요")
    def fits(noun: str, where: str, p: str) -> bool:
        return where == "any" or _F(noun[-1]) == (where == "final") or noun.endswith(_L) and p == _split("로")

    for p, where, rule in _NOUN:
        noun = whole[: len(whole) - len(p)]
        if whole.endswith(p) and noun and fits(noun, where, p) and (_V(noun[-1]) or _F(noun[-1])):
            lemma(_join(noun), STEP + PARTICLE - EARNED * len(p), f"noun + {rule}")
            for q, at, other in _NOUN:  # one particle after another
                inner = noun[: len(noun) - len(q)]
                if noun.endswith(q) and len(inner) > 2 and fits(inner, at, q):
                    lemma(_join(inner), 2 * STEP + PARTICLE - EARNED * (len(p) + len(q)), f"noun + {other} + {rule}")
    for adverb, tail in (("이", ""), ("히", "하")):
        if whole.endswith(_split(adverb)) and len(word) > 1:
            lemma(_join(whole[: -len(_split(adverb))]) + tail + "다", 0, f"adverb -{adverb}")
    seen: dict[str, int] = {}
    while queue:
        cost, _, stem, rule = heapq.heappop(queue)
        if seen.get(stem, cost + 1) <= cost:
            continue
        seen[stem] = cost
        text = _join(stem)
        lemma(text + "다", cost, rule)
        if text.endswith("하") and len(text) > 2:
            lemma(text[:-1], cost + 1, f"noun + 하다, {rule}")
        if rule.count(",") < depth:
            for e, kind, name in _INNER:
                if stem.endswith(e) and len(stem) > len(e) + 1:
                    for inner, more in _after(stem[: len(stem) - len(e)], kind, e):
                        push(inner, cost + more + STEP - EARNED * len(e) - (3 if name in ("past", "honorific") or " " in e else 0), f"{name}, {rule}")
    ordered = sorted(best.items(), key=lambda kv: (kv[1][0], kv[0]))
    return [(k, rule) for k, (_, rule) in ordered[:most]]


@F.pandas_udf(ArrayType(StructType().add("lemma", "string").add("rule", "string")))
def deconjugate(words: pd.Series) -> pd.Series:
    return words.map(lambda w: [{"lemma": k, "rule": r} for k, r in candidates(w)])


def lemmas(word: Column, most: int = 5) -> Column:
    return F.transform(F.slice(deconjugate(word), 1, most), lambda c: c["lemma"])


#: Words that the queries below look up, alone and beside names of parts.
SAMPLE = ["먹어요", "추워요", "몰랐어요", "갑니다", "공부했어요", "학교에서는", "먹고 싶어요", "많이", "school", ""]


@query("ud01_deconjugate")
def deconjugate_query(spark, d):
    words = listed(spark, d, SAMPLE)
    return words.select("n", F.posexplode(deconjugate(F.col("word"))).alias("place", "c")).select("n", "place", "c.lemma", "c.rule")


@query("ud02_grammar_hints")
def grammar_hints(spark, d):
    words = listed(spark, d, SAMPLE)
    return words.select("n", F.array_distinct(F.transform(F.slice(deconjugate(F.col("word")), 1, 3), lambda c: c["rule"])).alias("patterns"))

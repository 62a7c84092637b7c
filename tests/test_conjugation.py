"""Words conjugated forwards, by a small conjugator of this test's own, come back to their dictionary form."""

import pytest

from glossarium.functions.conjugation import candidates

FIRST = 0xAC00
#: Stems by the way they conjugate, chosen for this test.
STEMS = {
    "regular": "닫 씻 믿 얻 심 남 숨 감 접 꺾 벗 뽑 타 비싸 나누 바꾸 던지 느끼 비비 쏘",
    "ㅂ": "가깝 무겁 눕 반갑 두껍 차갑",
    "ㄷ": "깨닫 싣 일컫",
    "ㅅ": "붓 잇 긋",
    "르": "고르 흐르 누르 기르 마르",
    "으": "모으 끄 슬프 바쁘 담그",
    "ㄹ": "놀 열 울 팔 흔들",
    "하": "시작하 말하 조심하",
}


def parts(c):
    k = ord(c) - FIRST
    return k // 588, k % 588 // 28, k % 28


def made(initial, vowel, final=0):
    return chr(FIRST + initial * 588 + vowel * 28 + final)


A, AE, EO, YEO, O, WA, U, WO, EU, I = 0, 1, 4, 6, 8, 9, 13, 14, 18, 20  # noqa: E741
NONE, N, L, B, SS = 0, 4, 8, 17, 20


def with_final(word, final):
    i, v, _ = parts(word[-1])
    return word[:-1] + made(i, v, final)


def bright(stem):
    return parts(stem[-1])[1] in (A, O)


def infinitive(stem, kind):
    i, v, f = parts(stem[-1])
    if kind == "하":
        return stem[:-1] + made(i, AE)
    if kind == "ㅂ":
        return with_final(stem, NONE) + "워"
    if kind == "ㄷ":
        stem = with_final(stem, L)
    if kind == "ㅅ":
        return with_final(stem, NONE) + ("아" if bright(stem) else "어")
    if kind == "르":
        return with_final(stem[:-1], L) + ("라" if bright(stem[:-1]) else "러")
    if kind == "으":
        return stem[:-1] + made(i, A if len(stem) > 1 and bright(stem[:-1]) else EO)
    if f or kind == "ㄷ":
        return stem + ("아" if bright(stem) else "어")
    vowel = {A: A, EO: EO, O: WA, U: WO, I: YEO}[v]
    return stem[:-1] + made(i, vowel)


def open_stem(stem, kind):
    """The stem before an ending that begins with 으 after a consonant."""
    f = parts(stem[-1])[2]
    if kind == "ㅂ":
        return with_final(stem, NONE) + "우"
    if kind == "ㄷ":
        return with_final(stem, L) + "으"
    if kind == "ㅅ":
        return with_final(stem, NONE) + "으"
    return stem if not f or kind == "ㄹ" else stem + "으"


def forms(stem, kind):
    inf, opened = infinitive(stem, kind), open_stem(stem, kind)
    light = with_final(opened, NONE) if kind == "ㄹ" else opened
    past = with_final(inf, SS)
    yield from (inf + "요", inf + "서", past + "어요", past + "습니다", past + "지만", stem + "고", stem + "지만", stem + "겠어요", stem + "고 싶어요", stem + "지 않아요")
    yield from (opened + "면", opened + "려고", light + "니까", light + "세요", with_final(light, L) + "까요", with_final(light, N))
    yield from ([with_final(light, B) + "니다"] if not parts(stem[-1])[2] or kind == "ㄹ" else [stem + "습니다"])


CASES = [(stem, form) for kind, stems in STEMS.items() for stem in stems.split() for form in forms(stem, kind)]


@pytest.mark.parametrize("stem", sorted({stem for stem, _ in CASES}))
def test_forms_come_back(stem):
    missed = [form for s, form in CASES if s == stem and stem + "다" not in [k for k, _ in candidates(form)][:8]]
    assert missed == []


NOUNS = ["바다", "연필", "가게", "지붕", "언니", "수박"]


@pytest.mark.parametrize("noun", NOUNS)
def test_particles_come_off(noun):
    closed = parts(noun[-1])[2] != 0
    marks = ["은", "이", "을", "과"] if closed else ["는", "가", "를", "와"]
    marks += ["에서", "에게", "부터", "까지", "도", "으로" if closed and parts(noun[-1])[2] != L else "로", "에서는"]
    for mark in marks:
        assert noun in [k for k, _ in candidates(noun + mark)][:8], mark


@pytest.mark.parametrize("word", [None, "", "  ", "school", "ㄱ", "가"])
def test_nothing_to_undo(word):
    assert all(k != word for k, _ in candidates(word))
    assert word == "가" or candidates(word) == []


def test_long_word_is_bounded():
    found = candidates("닫" * 2000 + "았어요")
    assert 0 < len(found) <= 40 and len({k for k, _ in found}) == len(found)

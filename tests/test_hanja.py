"""Hanja by evidence, and hanja meanings from lines, on small tables."""

import json

from glossarium.functions.korean import extract_hun_eum
from glossarium.operators.hanja import infer_hanja

ENTRIES = [
    ("수도", "首都", "capital; chief city", "krdict", 1),
    ("수도", "水道", "water supply; pipe", "stdict", 2),
    ("수도", "首都", "the capitals of countries", "wikt", 3),
    ("공사", "工事", "construction of buildings", "krdict", 4),
    ("배", "倍", "double; twice", "krdict", 5),
    ("배", "", "a ship; a pear", "krdict", 6),
    ("도서실", "圖書室", "reading room", "krdict", 7),
    ("수도원", "修道院", "monastery", "krdict", 8),
    ("수도로", "水道路", "aqueduct", "krdict", 9),
    ("마을", "", "a village", "krdict", 10),
    ("하늘", None, "sky", "wikt", 11),
    ("수도꼭지", "水道꼭지", "faucet", "krdict", 12),
]


def test_evidence(spark):
    rows = [
        (1, "수도", "a capital city", "kengdic", None, "首都"),
        (2, "수도", "monk training", "kengdic", None, None),  # nothing points anywhere
        (3, "수도", "capital; water supply, pipes", "kengdic", "", "水道"),  # three against one
        (4, "수도", "capital; water", "kengdic", "", None),  # no clear margin
        (5, "수도 공사", "water pipe construction", "kengdic", None, "水道 工事"),
        (6, "배", "ship", "kengdic", None, None),  # the native word
        (7, "배", "double", "kengdic", None, "倍"),
        (8, "도서실", "something else", "kengdic", None, "圖書室"),  # three syllables, one reading
        (9, "수도원", "monastery", "kengdic", None, "修道院"),
        (10, "수도원", "garden of the capital", "kengdic", None, None),  # its beginning means another word
        (11, "수도로", "unrelated", "kengdic", None, "水道路"),  # a word written in hanja throughout
        (12, "수도로 공사", "construction", "kengdic", None, None),  # may be a noun with a particle
        (13, "없는말 공사", "construction", "kengdic", None, None),  # a part that no dictionary has
        (14, "마을 공사", "construction in a village", "kengdic", None, "마을 工事"),
        (15, "마을", "a village", "kengdic", None, None),
        (16, "수도", "a capital city", "krdict", None, None),  # records hanja itself
        (17, "수도", "a capital city", "kengdic", "水道", None),  # has some
        (18, "도서실 마을", "a village", "kengdic", None, None),  # the word means something else there
        (19, None, None, "kengdic", None, None),
        (20, "하늘 수도", "water supply", None, None, "하늘 水道"),
    ]
    got = infer_hanja(
        spark.createDataFrame([r[:5] for r in rows], "row long, headword string, gloss string, source string, hanja string"),
        spark.createDataFrame([(w, h, g, s, s, r) for w, h, g, s, r in ENTRIES], "hw_norm string, hanja string, gloss string, source string, pack string, rank long"),
    )
    assert {r.row: r.hanja for r in got.collect()} == {r[0]: r[5] for r in rows if r[5]}


def test_hun_eum(spark):
    lines = [
        ({"head_templates": [{"name": "ko-hanja", "args": {"1": "구름", "2": "운"}, "expansion": "雲 • (eumhun 구름 운)"}]}, ["구름 운"], ["운"]),
        ({"head_templates": [{"name": "ko-hanja/x", "args": {"1": "큰  바람 풍"}}], "senses": [{"glosses": ["풍 (pung): wind", "other"]}]}, ["큰 바람 풍"], ["풍"]),
        ({"forms": [{"form": "긴 장 (x)", "tags": ["eumhun"]}, {"form": "어른 장", "tags": ["a", "eumhun"]}, {"form": "다른 말", "tags": ["b"]}, {"form": None, "tags": None}]}, ["긴 장", "어른 장"], ["장"]),
        ({"head_templates": [{"name": "ko-hanja", "args": {"1": "사"}}, {"name": "other", "args": {"1": "모래"}}]}, [], ["사"]),
        ({"head_templates": [{"name": "ko-hanja", "args": {"hangeul": "모래 사"}}], "senses": [{"glosses": None}, {}]}, ["모래 사"], ["사"]),
        ({"head_templates": [{"name": "h", "expansion": "(hangeul 물 수, eumhun 바다 해)"}]}, ["물 수", "바다 해"], ["해", "수"]),
        ({"word": "x"}, [], []),
    ]
    rows = [(k, json.dumps(x, ensure_ascii=False)) for k, (x, _, _) in enumerate(lines)] + [(98, "{damaged"), (99, None)]
    got = {r.k: r.e for r in spark.createDataFrame(rows, "k int, line string").select("k", extract_hun_eum(__import__("pyspark.sql.functions").sql.functions.col("line")).alias("e")).collect()}
    for k, (_, pairs, readings) in enumerate(lines):
        assert ([f"{p.hun} {p.eum}" for p in got[k].pairs], got[k].readings) == (pairs, readings)
    assert got[98] is None and got[99] is None

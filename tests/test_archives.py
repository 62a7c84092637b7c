"""Archives and stored replies as data sources."""

import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from glossarium.sources import archives, readers


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    f = tmp_path_factory.mktemp("archives")
    with zipfile.ZipFile(f / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("one.u8", "﻿# comment\r\n學校 学校 [xue2 xiao4] /school/\r\nbad line\r\n")
        z.writestr("folder/", "")
        z.writestr("two.txt", "\n".join(str(k) for k in range(20_000)))
        z.writestr("bytes.txt", b"a\x00b\x07c\xff\td\n\ne")
        z.writestr("empty.txt", "")
    for name, mode in (("b.tar.bz2", "w:bz2"), ("c.tgz", "w:gz")):
        with tarfile.open(f / name, mode) as t:
            for member, text in (("links.csv", "1\t11\n1\t10\nx\t2\n3\n"), ("sub/other.csv", "한\n글")):
                data = text.encode()
                info = tarfile.TarInfo(member)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    (f / "readme.md").write_text("not an archive")
    return str(f)


def test_lines(spark, folder):
    rows = archives.archive_lines(spark, folder)
    got = {}
    for r in rows.collect():
        got.setdefault((r.archive, r.member), []).append((r.n, r.value))
    assert {k: [v for _, v in sorted(x)] for k, x in got.items() if k[1] != "two.txt"} == {
        ("a.zip", "one.u8"): ["# comment", "學校 学校 [xue2 xiao4] /school/", "bad line"],
        ("a.zip", "bytes.txt"): ["abc�\td", "", "e"],
        **{(a, "links.csv"): ["1\t11", "1\t10", "x\t2", "3"] for a in ("b.tar.bz2", "c.tgz")},
        **{(a, "sub/other.csv"): ["한", "글"] for a in ("b.tar.bz2", "c.tgz")},
    }
    assert sorted(got["a.zip", "two.txt"]) == [(k + 1, str(k)) for k in range(20_000)]
    assert archives.archive_lines(spark, f"{folder}/a.zip", "two*").count() == 20_000
    assert archives.archive_lines(spark, f"file://{folder}/c.tgz").count() == 6


def test_patterns_are_planned(folder, monkeypatch):
    def planned(**options):
        return [(p.archive.rsplit("/", 1)[-1], p.members) for p in archives.LinesReader({"path": folder, **options}).partitions()]

    assert planned(member="two.txt", archive="*.zip") == [("a.zip", ["two.txt"])]
    assert planned(archive="c.*") == [("c.tgz", None)]
    assert planned(archive="zz") == [("", [])]
    monkeypatch.setattr(archives, "PARTITION_BYTES", 20)
    assert [m for _, m in planned(archive="a.zip")] == [["one.u8"], ["two.txt"], ["bytes.txt", "empty.txt"]]


def test_two_scans_in_one_plan(spark, folder):
    one, two = (archives.archive_lines(spark, folder, member) for member in ("links.csv", "*/other.csv"))
    assert one.select("member").unionAll(two.select("member")).distinct().count() == 2
    whole = archives.archive_lines(spark, folder)
    both = whole.filter("member = 'links.csv'").select("member").unionAll(whole.filter("member = 'sub/other.csv'").select("member"))
    assert both.distinct().count() == 2


def test_formats(spark, folder):
    lines = archives.archive_lines(spark, folder)
    assert [r.simplified for r in readers.cedict(lines.filter("member = 'one.u8'").select("value")).collect()] == ["学校"]
    assert sorted((r.id, r.other) for r in archives.link_rows(lines.filter("archive = 'b.tar.bz2' AND member = 'links.csv'")).collect()) == [(1, 10), (1, 11)]
    tsv = spark.createDataFrame([(1, "id\ta\tb\tc"), (2, "5\t 가 \t\\N\tgo\tA\tx"), (3, "6\t나\tx"), (4, "x\t다\t\tthen"), (5, "7\t\t\tgloss")], "n long, value string")
    assert [tuple(r) for r in archives.kengdic_rows(tsv).orderBy("surface").collect()] == [(5, "가", None, "go", "A"), (None, "다", None, "then", None)]
    said = spark.createDataFrame([("1\tko\t 가\t나 ",), ("2\ten\tx",), ("x\tko\ty",), ("3\tko\t ",), ("4\tko",)], "value string")
    assert [tuple(r) for r in archives.sentence_rows(said, "ko").collect()] == [(1, "가\t나")]
    assert [r[0] for r in spark.createDataFrame([("a\x01b\tc\nd\x1f",)], "t string").select(archives.without_control(F.col("t"))).collect()] == ["ab\tc\nd"]


def test_round_trip(spark, tmp_path):
    rows = [(f"m{k % 5}", k, f"line {k}" if k % 9 else None) for k in range(500)]
    archives.write_zips(spark.createDataFrame(rows, "member string, n long, value string").repartition(7), str(tmp_path / "out"))
    got = {}
    for r in archives.archive_lines(spark, str(tmp_path / "out")).collect():
        got.setdefault(r.member, []).append((r.n, r.value))
    assert {m: [v for _, v in sorted(x)] for m, x in got.items()} == {f"m{j}": [v or "" for m, _, v in rows if m == f"m{j}"] for j in range(5)}


def test_replies(spark, tmp_path):
    def store(question, n, asked, titles, then, key="allpages"):
        (tmp_path / question).mkdir(exist_ok=True)
        reply = {"query": {key: [{"title": t} for t in titles]}}
        if asked:
            reply["asked"] = {"continue": asked}
        if then:
            reply["continue"] = {"apcontinue": then}
        (tmp_path / question / f"{n:03}.json").write_text(json.dumps(reply))

    store("whole", 3, "", ["a", "b"], "c")
    store("whole", 1, "c", ["c"], "d")
    store("whole", 2, "d", ["d"], None)
    store("whole", 4, "c", ["again"], "d")  # fetched twice: the file that comes first counts
    store("broken", 1, "", ["x"], "y")
    store("empty", 1, "", [], None)
    (tmp_path / "whole" / "zzz.json").write_text("{damaged")
    got = {}
    for r in archives.stored_replies(spark, str(tmp_path)).collect():
        got.setdefault(r.question, []).append((r.n, r.title, r.last))
    assert {q: sorted(x) for q, x in got.items()} == {"whole": [(0, "a", False), (1, "b", False), (2, "c", False), (3, "d", True)], "broken": [(0, "x", False)]}
    assert [r.title for r in archives.stored_replies(spark, str(tmp_path), question="bro*").collect()] == ["x"]

"""Readers of files, and what leaves a build, on small files of these tests' own."""

import bz2
import gzip
import json
import zipfile

import pytest

from glossarium.operators import lessons as views
from glossarium.sources import dictionaries as src
from glossarium.sources import exports


def lines(spark, *text):
    return spark.createDataFrame([(t,) for t in text], "value string")


def test_discover(spark, tmp_path):
    for name in ("b.xml", "a.xml", "c.tsv"):
        (tmp_path / name).write_text("x")
    found = src.discover(spark, str(tmp_path), 1)
    assert {k: [x.rsplit("/", 1)[-1] for x in v] for k, v in found.items()} == {"xml": ["a.xml"], "tsv": ["c.tsv"]}
    assert src.discover(spark, str(tmp_path / "none")) == {}


KRDICT = """<LexicalResource><Lexicon>
<LexicalEntry att="id" val="7"><feat att="homonym_number" val="2" /><feat att="lexicalUnit" val="단어" /><feat att="partOfSpeech" val="어미" />
<Lemma><feat att="writtenForm" val="-거든" /></Lemma><feat att="vocabularyLevel" val="중급" />
<Sense att="id" val="1"><feat att="definition" val="조건 &amp;amp; 까닭." /><SenseExample><feat att="type" val="대화" /><feat att="example" val="가: 뭐?" /><feat att="example" val="나: 응." /></SenseExample>
<Equivalent><feat att="language" val="영어" /><feat att="lemma" val="if" /></Equivalent></Sense></LexicalEntry>
<LexicalEntry att="id" val="8"><Lemma><feat att="writtenForm" val="" /></Lemma></LexicalEntry>
</Lexicon></LexicalResource>"""


def test_krdict_file(spark, tmp_path):
    (tmp_path / "k.xml").write_text(KRDICT)
    rows = src.krdict(src.elements(spark, str(tmp_path / "k.xml"), "LexicalEntry", src.KRDICT)).collect()
    assert [(r.ext_id, r.headword, r.homonym, r.kind, r.level) for r in rows] == [("7", "-거든", 2, "grammar", 2)]
    sense = rows[0].senses[0]
    assert (sense.gloss, sense.ko_def, sense.examples[0].ko, sense.examples[0].type) == ("if", "조건 & 까닭.", "가: 뭐?\n나: 응.", "dialogue")


def test_zhwikt_redirects_and_order(spark):
    text = [
        {"word": "書", "lang_code": "zh", "pos": "noun", "etymology_number": 1, "senses": [{"glosses": ["writing", "book"]}], "forms": [{"form": "书", "tags": ["Simplified"]}]},
        {"word": "本", "lang_code": "zh", "pos": "noun", "senses": [{"glosses": ["root"]}]},
        {"word": "書", "lang_code": "zh", "pos": "verb", "etymology_number": 1, "senses": [{"glosses": ["to write"]}]},
        {"word": "书", "lang_code": "zh", "senses": [{"form_of": [{"word": "書"}], "glosses": ["x"]}]},
    ]
    got, moves = src.zhwikt(lines(spark, *map(json.dumps, text), "{", "null"))
    by = {r.word: r for r in got.collect()}
    assert set(by) == {"書", "本"} and [s.gloss for s in by["書"].senses] == ["book", "to write"] and by["書"].senses[0].parent == "writing"
    assert by["書"].poses == ["noun", "verb"] and by["書"].forms == ["书"] and by["本"].homonym is None
    assert [tuple(r) for r in moves.collect()] == [("书", "書")]


def test_unihan_and_ranks(spark):
    got = src.unihan(lines(spark, "# x", "U+5B78\tkHangul\t학:0E", "U+5B78\tkTotalStrokes\t16 17", "U+5B78\tkDefinition\told", "U+5B78\tkDefinition\tlearning", "U+5B78\tkRSUnicode\t39.13", "U+4E00\tkKorean\tIL", "broken")).collect()
    assert sorted(map(tuple, got)) == [(0x4E00, ["il"], None, None, None), (0x5B78, ["학"], "learning", 16, 39)]
    ranks = src.frequency_ranks(lines(spark, "b 9", "no number", "a 3", "b 1", "c d 2").coalesce(1))
    assert {r.word: r["rank"] for r in ranks.collect()} == {"b": 1, "a": 2, "c d": 4}


def test_strict_tables(spark):
    good = "1\t2\t가다01\t가다\t1\t동사\t"
    assert src.curriculum_words(lines(spark, "# c", "", good)).first().homonym == 1
    with pytest.raises(Exception, match="7 columns expected"):
        src.curriculum_words(lines(spark, good, "1\t2")).collect()
    study = "\t".join(src.STUDY)
    row = "a\t1\t말\tkrdict\t5\t말\t0.5\t1\t1\t1\t"
    assert src.study_list(lines(spark, study, row)).first().score == 0.5
    with pytest.raises(Exception, match="unknown source"):
        src.study_list(lines(spark, row.replace("krdict", "other"))).collect()


def test_grammar_overlay(spark):
    p, e = "P\t-거든\tfinal ending\t3\t뜻.\tai\ta b c d e\t거들랑, 거드면", "E\t-거든\t가거든 말해요.\tai\tTell me."
    row = src.grammar_overlay(lines(spark, "# x", p, e, e.replace("가거든", "오거든"))).first()
    assert row.forms == ["거들랑", "거드면"] and [x.ko for x in row.examples] == ["가거든 말해요.", "오거든 말해요."] and row.level == 3
    for wrong in (e.replace("-거든", "-없는"), "X\ty", "P\ttoo\tshort"):
        with pytest.raises(Exception, match="grammar overlay"):
            src.grammar_overlay(lines(spark, p, wrong)).collect()


def test_lessons(spark, tmp_path):
    body = {"form": "-거든", "label": "if so", "meaning_en": "x", "examples": []}
    (tmp_path / "l.json").write_text(json.dumps([body, {**body, "form": "-면"}]))
    assert sorted(r.form for r in src.lesson_files(spark, str(tmp_path / "l.json"), 3).collect()) == ["-거든", "-면"]
    with pytest.raises(Exception, match="unknown fields"):
        src.lessons(spark.createDataFrame([(1, json.dumps({**body, "colour": 1}))], "level int, value string")).collect()


def test_text_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "a", "text": "one\ntwo"}, indent=1))
    (tmp_path / "_b.json").write_text(json.dumps({"id": "b"}))
    (tmp_path / "c.json").write_text("{broken")
    assert [(r.id, r.text) for r in src.text_files(spark, str(tmp_path)).collect()] == [("a", "one\ntwo")]


def test_corpus(spark, tmp_path):
    page = "<page><title>{}</title><ns>{}</ns>{}<revision><text>{}</text></revision></page>"
    dump = "<mediawiki>" + page.format("A", 0, "", "text a") + page.format("B", 1, "", "talk") + page.format("C", 0, '<redirect title="A" />', "x") + "</mediawiki>"
    (tmp_path / "w.xml.bz2").write_bytes(bz2.compress(dump.encode()))
    (tmp_path / "t.txt.gz").write_bytes(gzip.compress("one\ntwo\n".encode()))
    assert [r.text for r in src.corpus(spark, str(tmp_path / "w.xml.bz2")).collect()] == ["text a"]
    assert sorted(r.text for r in src.corpus(spark, str(tmp_path / "t.txt.gz")).collect()) == ["one", "two"]


def test_rss(spark, tmp_path):
    item = "<item><title>T &amp;amp; {}</title><link>http://x/{}</link><pubDate>today</pubDate></item>"
    (tmp_path / "f.xml").write_text("<rss><channel>" + item.format(1, 1) + item.format(1, 1) + item.format(2, 2) + "</channel></rss>")
    assert sorted((r.title, r.link) for r in src.rss(spark, str(tmp_path / "f.xml")).collect()) == [("T & 1", "http://x/1"), ("T & 2", "http://x/2")]


def test_chunks_there_and_back(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", "concat('w', id) AS word").coalesce(1)
    out, target = str(tmp_path / "chunks"), str(tmp_path / "table")
    exports.export_chunks(rows, out, 30)
    manifest = exports.chunk_manifest(spark, out)
    kept = spark.createDataFrame(manifest.collect(), manifest.schema)
    assert sorted(r.rows for r in kept.collect()) == [10, 30, 30, 30]
    assert exports.import_chunks(spark, out, kept, "id long, word string", target) == 100
    for f in (tmp_path / "chunks").glob(".*.crc"):  # the local file system's own sums
        f.unlink()
    (next((tmp_path / "chunks").glob("*.gz"))).write_bytes(gzip.compress(b'{"id": 1}\n'))
    with pytest.raises(ValueError, match="differ from the manifest"):
        exports.import_chunks(spark, out, kept, "id long, word string", target)
    assert spark.read.parquet(target).count() == 100


def test_finish(spark, tmp_path):
    got = exports.finish(spark.range(50).withColumnRenamed("id", "k"), "finished_table", str(tmp_path / "t"), "k")
    assert got["rows"] == 50 and got["bytes"] > 0
    spark.sql("DROP TABLE finished_table")


def test_digest_sees_every_cell_and_no_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k int, w string")
    b = spark.createDataFrame([(2, None), (1, "x"), (2, None)], "k int, w string")
    c = spark.createDataFrame([(2, None), (1, "x"), (2, "")], "k int, w string")
    assert exports.strong_digest(a).first() == exports.strong_digest(b).first() != exports.strong_digest(c).first()
    cells = lambda kind, *rows: exports.strong_digest(spark.createDataFrame([(x,) for x in rows], f"v {kind}")).first()["digest"]
    assert len({cells("string", None), cells("string", "\x00"), cells("string", "-"), cells("string", ""), cells("string", "1"), cells("int", 1), cells("long", 1), cells("string", "1", "1"), cells("string")}) == 9
    odd = ["", "a", "é學🙂", "x" * 300]
    h = {}
    for w in odd:
        v = 1469598103934665603
        for b in w.encode():
            v = (v ^ b) * 1099511628211 % (1 << 64)
        h[w] = str(v)
    got = spark.createDataFrame([(w,) for w in [*odd, None]], "w string").select("w", exports.fnv1a(exports.F.col("w")).alias("h")).collect()
    assert {r.w: r.h for r in got} == {**h, None: None}


def test_catalogue(spark):
    text = '[[text]]\nid = "a-1"\ntitle = "T"\nsource = "wiki"\npage = "P"\nyear = 1900\n[[text]]\nid = "B"\ntitle = " "\nsource = "x"\n'
    rows = exports.catalogue(spark, text)
    assert sorted(r.problem for r in exports.catalogue_problems(rows, ["wiki"]).collect()) == sorted(["no title", "unknown source", "no page", "no year", "id must be lower-case letters, digits and hyphens"])


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = lambda n, vs: f'<row r="{n}">' + "".join(f'<c r="{c}{n}" t="s"><v>{v}</v></c>' for c, v in vs) + "</row>"
    shared = ["순위", "1.0", "1급", "가다01", "동사", "  길을  가다"]
    sheet = cells(1, [("A", 0)]) + cells(2, [("A", 1), ("B", 2), ("C", 3), ("D", 4), ("E", 5)]) + cells(3, [("A", 1), ("C", 3)])
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")
    got = [r.value for r in exports.curriculum_lines(spark, str(tmp_path / "w.xlsx")).collect()]
    assert got == ["1\t1\t가다01\t가다\t1\t동사\t길을 가다", "1\t\t가다01\t가다\t1\t\t"]


def test_cycles_cover_everything():
    for n in (1, 2, 7, 25):
        days = [views.picks(n, views.WORD_SALT, d, 3) for d in range(0, 3 * n)]
        assert all(len(set(x)) == min(3, n) for x in days)
        assert sorted(views.order_of_cycle(n, 5, 2)) == list(range(n))
        assert {k for x in days[:n] for k in x} == set(range(n))
    assert views.order_of_cycle(25, views.WORD_SALT, 0) != views.order_of_cycle(25, views.GRAMMAR_SALT, 0)
    assert views.picks(0, 1, 4, 3) == []


def test_variants_of_proverbs(spark):
    rows = [(1, "가는 말이 고와야 한다", 5, 1, 3.0), (2, "가는 말이 고와야 할까", 5, 1, 3.0), (3, "가는 말이 고와야 한다 늘", 5, 1, 2.0), (4, "가는 말이 고와야 한다", 4, 1, 2.5), (5, "짧다", 0, 0, 0.0), (6, "짧다", 0, 0, 0.0)]
    got = views.without_variants(spark.createDataFrame(rows, "id long, text string, a_full int, a_partial int, score double"), ["a"])
    assert {r.id: r.variant_of for r in got.collect()} == {1: None, 2: 1, 3: 1, 4: None, 5: None, 6: None}

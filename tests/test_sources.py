from glossarium.sources import readers


def lines(spark, *text):
    return spark.createDataFrame([(t,) for t in text], "value string")


def test_cedict(spark):
    got = readers.cedict(lines(spark, "# comment", "學校 学校 [xue2 xiao4] /school/CL:所[suo3]/", "bad line")).collect()
    assert [(r.traditional, r.simplified, r.pinyin, r.glosses) for r in got] == [("學校", "学校", "xue2 xiao4", ["school", "CL:所[suo3]"])]


def test_jsonl_leaves_out_broken_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"word": "a", "lang_code": "ko"}\n{"word": \n{"word": "b", "lang_code": "en"}\n')
    got = readers.jsonl(spark, str(tmp_path / "x.jsonl"), "word string, lang_code string", "ko").collect()
    assert [r.word for r in got] == ["a"]


def test_kengdic(spark, tmp_path):
    (tmp_path / "k.tsv").write_text('id\tsurface\thanja\tgloss\tlevel\tcreated\tsource\n1\t학교\t學校\t"a school\tA\t\tx\n')
    got = readers.kengdic(spark, str(tmp_path / "k.tsv")).collect()
    assert got[0].gloss == '"a school'


def test_tatoeba(spark):
    ko = spark.createDataFrame([(1, "가"), (2, "나"), (3, "가")], "id long, text string")
    en = spark.createDataFrame([(10, "go"), (11, "went")], "id long, text string")
    links = spark.createDataFrame([(1, 11), (1, 10), (3, 99)], "id long, other long")
    assert {r.ko: r.en for r in readers.tatoeba(ko, links, en).collect()} == {"가": "go", "나": None}


def test_xml_rows(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<r><item><word>가</word></item><item><word>나</word></item></r>")
    assert sorted(r.word for r in readers.xml_rows(spark, str(tmp_path / "x.xml"), "item", "word string").collect()) == ["가", "나"]

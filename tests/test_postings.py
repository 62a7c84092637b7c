"""Search of many queries where words have many terms, and stems of words that come again."""

import pandas as pd

from glossarium.functions import stemming
from glossarium.plans import postings


def test_candidates_meet_words_not_terms(spark, monkeypatch):
    # every document has the rare word, and one of 200 terms that go on from the other
    rows = [(k, "p", "", f"rare{k % 2} abc{k}") for k in range(200)]
    ix = postings.indexed(spark.createDataFrame(rows, "id long, pack string, head string, en string"), stemmed=False)
    asked = postings.asked_words(spark.createDataFrame([(q, f"rare{q % 2} abc") for q in range(6)], "q long, text string"), stemmed=False)
    made = {}

    def kept(df, label, cut=postings.cut):
        out = cut(df, label)
        made[label] = out.count()
        return out

    monkeypatch.setattr(postings, "cut", kept)
    got = {(r.q, r.id) for r in postings.search_postings(ix, asked).collect()}
    assert got == {(q, k) for q in range(6) for k in range(200) if k % 2 == q % 2}
    # terms that go on and documents are gathered by word, once for six queries
    assert made["wanted"] == 202 and made["held"] == 400


def test_a_word_is_stemmed_once(monkeypatch):
    called = []

    def porter(word, own=stemming.porter):
        called.append(word)
        return own(word)

    monkeypatch.setattr(stemming, "porter", porter)
    words = pd.Series([["sailings", "ponies"] * 50] * 20)
    assert stemming.stems.func(words).iloc[3][:2] == ["sail", "poni"]
    assert len(called) <= 2

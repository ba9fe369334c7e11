"""Cross-parsing against a plain greedy search, over many letters and texts of several pieces; edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import cross_parsing as cp

DOC = "doc_id long, text string, lang string"


def greedy(symbols, sample):
    """Fewest longest-match phrases: a phrase grows while it occurs in the sample; a symbol that is not there is one."""
    s, ref = "".join(map(chr, symbols.tolist())), "".join(map(chr, sample.tolist()))
    n = i = 0
    while i < len(s):
        k = i + 1
        while k < len(s) and s[i : k + 1] in ref:
            k += 1
        n, i = n + 1, k
    return n


LETTERS = "".join(chr(0x4E00 + i) for i in range(320)) + "abcdefghij"


@pytest.mark.parametrize("letters", ["abc ", "abcdefghijklmnop .", LETTERS + " "])
def test_equals_greedy_search(monkeypatch, letters):
    monkeypatch.setattr(cp, "PIECE", 64)
    r = random.Random(9)
    texts = {x: "".join(r.choice(letters) for _ in range(700)) for x in "xyz"}
    m = cp.Model(texts)
    assert m.alphabet.size == 2 + len({c for t in texts.values() for c in t if c.isalpha()})
    asked = ["".join(r.choice(letters + "ωж7") for _ in range(r.choice([1, 3, 63, 64, 65, 200, 1500]))) for _ in range(40)]
    asked += [texts["x"] * 3, texts["y"][5:600] + texts["z"][:300], texts["x"][1:], "ωω", "a", " a"]  # phrases longer than many pieces
    got = m.phrases(asked)
    for t, row in zip(asked, got, strict=True):
        assert row.tolist() == [greedy(m.alphabet.encode(t), m.alphabet.encode(texts[x])) for x in "xyz"], t[:40]


def test_long_text_of_many_letters():
    r = random.Random(2)
    sample = "".join(r.choice(LETTERS[:40] if i % 3 else LETTERS) for i in range(4000))
    m = cp.Model({"x": sample})
    t = sample[100:3000] + "".join(r.choice(LETTERS) for _ in range(3000)) + sample[:2500]
    assert len(t) > 5 * cp.PIECE and m.alphabet.size > 300
    assert m.phrases([t, t[1:]]).ravel().tolist() == [greedy(m.alphabet.encode(x), m.alphabet.encode(sample)) for x in (t, t[1:])]


def test_one_long_text_does_not_fill_a_sample(spark):
    rows = [(i, f"kalomi ru{i} " * 12, "aa") for i in range(300)] + [(1000, "zzzz yyyy " * 40_000, "aa")] + [(2000 + i, "schten verü " * 9, "bb") for i in range(200)]
    m = cp.learn(spark.createDataFrame(rows, DOC))
    got = m.phrases(["kalomi ru5 kalomi ru7 " * 5, "schten verü " * 5])
    assert got[0, 0] < got[0, 1] and got[1, 1] < got[1, 0]


def test_edges(spark):
    rows = [(i, "ka lo mi ru " * 20 if i % 2 else "sch ten ver ü " * 20, "aa" if i % 2 else "bb") for i in range(60)]
    d = spark.createDataFrame(rows, DOC)
    m = cp.learn(d)
    odd = [(1, None, None), (1, "", "aa"), (2, "12 ??", "aa"), (None, "ka lo mi", None), (3, "ka lo mi", "bb"), (3, "ka lo mi", "bb"), (4, "日本語", None), (5, "ka lo " * 200_000, "aa")]
    out = cp.identify(spark.createDataFrame(odd, DOC).withColumns({"score": F.lit("old"), "LANG_PRED": F.lit(1)}), m)
    assert sorted(c.lower() for c in out.columns) == sorted(["doc_id", "text", "lang", "lang_pred", "score", "phrases_per_char"])
    got = out.collect()
    assert len(got) == len(odd) and [r["lang_pred"] for r in got if r["text"] in (None, "", "12 ??")] == ["und"] * 3
    assert all(r["lang_pred"] == "aa" for r in got if (r["text"] or "").startswith("ka"))
    tie = next(r for r in got if r["text"] == "日本語")
    assert tie["lang_pred"] == "aa" and tie["score"] == 0.5  # equal counts: the alphabetically first
    assert cp.identify(d.limit(0), m).collect() == []
    assert {r["lang_pred"] for r in cp.identify(d, cp.learn(d.limit(0))).collect()} == {"und"}
    one = cp.learn(d.where("lang = 'aa'"))
    assert {(r["lang_pred"], r["score"]) for r in cp.identify(d, one).collect()} == {("aa", 1.0)}
    assert np.isfinite([r["score"] for r in got]).all()

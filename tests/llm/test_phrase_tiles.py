"""Tiles against plain counts, and collocations against counts of tuples."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import _base
from tidemark.llm import phrase_tiles as pt


@pytest.mark.parametrize("dense", [1, 40, 10**9])
def test_tiles_count_all_pairs(monkeypatch, dense):
    monkeypatch.setattr(pt, "DENSE", dense)
    rng = np.random.default_rng(dense % 97)
    a, b = (rng.zipf(1.3, 20_000) % 1_000_000 for _ in range(2))
    unit, f = pt.count_pairs(a << 32 | b)
    assert dict(zip(unit.tolist(), f.tolist(), strict=True)) == Counter((a << 32 | b).tolist()) and len(set(unit.tolist())) == len(unit)


def plain(rows, least, longest=5, top=2000):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    cands = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    inside = set()
    for p, a in cands.items():
        w = p[1:]
        inside |= {q for m in range(2, len(w)) for i in range(len(w) - m + 1) if a >= f[q := (p[0], *w[i : i + m])]}
    out = []
    for p, a in cands.items():
        if p in inside:
            continue
        cuts = [(1000 * a * n[p[0]] // (f[p[: k + 1]] * f[p[0], *p[k + 1 :]]), k) for k in range(1, len(p) - 1)]
        score, k = min(cuts)
        out.append((p[0], " ".join(p[1:]), a, f[p[: k + 1]], f[p[0], *p[k + 1 :]], n[p[0]], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    seen = Counter()
    return [(r[0], seen[r[0]], *r[1:]) for r in out if (seen.update([r[0]]) or seen[r[0]]) <= top]


@pytest.mark.parametrize("few", [300_000, 0])
def test_equals_plain_counts(spark, monkeypatch, few):
    monkeypatch.setattr(_base, "BROADCAST_ROWS", few)
    monkeypatch.setattr(pt, "BATCH_CHARS", 500)
    monkeypatch.setattr(pt, "BUFFER_PAIRS", 200)
    rng = random.Random(9)
    words = ["a", "B", "b", "c", "Öl", "öl", "of", "the\t", "sea", "x" * 5000]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", ", ", ".\n", "\x0b"]) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "de", None, "und"])) for i in range(120)]
    rows += [(500, None, "en"), (None, "the sea the sea", "en"), (3, "", None)] + [(501, "of the sea", "en")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as rank", "'y' as phrase").repartition(4)
    got = [tuple(r) for r in pt.collocations(df, least=5).collect()]
    want = plain(rows, 5)
    assert sorted(got) == sorted(want) and len(want) > 50
    assert sorted(tuple(r) for r in pt.collocations(df, least=5, top=3).collect()) == sorted(plain(rows, 5, top=3))


def test_nothing_frequent_and_empty(spark):
    df = spark.createDataFrame([(1, "one two", "en")], "doc_id long, text string, lang string")
    assert pt.collocations(df).collect() == [] and pt.collocations(df.where("false")).collect() == []

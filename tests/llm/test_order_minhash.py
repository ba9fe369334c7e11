"""Order MinHash classes against all pairs, and the edge cases the docstring names."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import order_minhash as om
from tidemark.llm._words import Words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute_runs(t):
    w = brute_words(t)
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else [])
    return runs


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute_similarity(a, b):
    if not a or not b:
        return 0.0
    n = lcs(a, b)
    return n / (len(a) + len(b) - n)


def classes(pairs, ids):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_words_match_the_pattern():
    texts = ["The  Cat's 42 éÀ!", None, "", "***", "x", "日本 語a"]
    w = Words(texts)
    got = [[w.word(i).decode() for i in range(w.first[d], w.first[d + 1])] for d in range(len(texts))]
    assert got == [brute_words(t) for t in texts]


def test_alignment_equals_dynamic_programming():
    r = random.Random(1)
    for _ in range(200):
        a = np.array([r.randrange(6) for _ in range(r.randrange(0, 40))], np.uint64)
        b = np.array([r.randrange(6) for _ in range(r.randrange(0, 40))], np.uint64)
        assert om.aligned_runs(a, b, 100) == lcs(a.tolist(), b.tolist())
        assert om.aligned_runs(a, b, 3) <= lcs(a.tolist(), b.tolist())


def test_similarity_is_exact_at_and_above_the_threshold():
    r = random.Random(2)
    for _ in range(150):
        a = [r.randrange(50) for _ in range(r.randrange(1, 60))]
        b = list(a)
        for _ in range(r.randrange(0, 6)):
            b.insert(r.randrange(len(b) + 1), r.randrange(50))
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        want = brute_similarity(a, b)
        got = om.similarity(x, y, 0.8)
        assert got == pytest.approx(want) if want >= 0.8 else got < 0.8


def fixture_rows():
    r = random.Random(3)
    rows, n = [], 0
    for g in range(12):
        words = [f"w{r.randrange(400)}" for _ in range(r.choice([7, 40, 120, 400]))]
        for _ in range(r.choice([1, 2, 3, 25])):
            w = list(words)
            for _ in range(r.randrange(0, max(1, len(w) // 60) + 1)):
                w[r.randrange(len(w))] = f"x{r.randrange(9999)}"
            rows.append((n, " ".join(w), "s"))
            n += 1
    rows += [(n, "", "s"), (n + 1, None, "s"), (n + 2, "one two", "s"), (n + 3, "One, two!", "s"), (n + 4, "***", "s"), (None, "one two", "s"), (n + 2, "one two", "s")]
    return rows


def test_classes_equal_all_pairs(spark):
    rows = fixture_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = {r["doc_id"]: r for r in om.near_duplicates(df).collect()}
    text = {i: t for i, t, _ in rows if i is not None}
    runs = {i: brute_runs(t) for i, t in text.items()}
    same = [(a, b) for a in text for b in text if a < b and runs[a] and brute_words(text[a]) == brute_words(text[b])]
    near = [(a, b) for a in text for b in text if a < b and runs[a] and runs[b] and brute_similarity(runs[a], runs[b]) >= 0.8]
    want = classes(same + near, text)
    assert {i: r["class_id"] for i, r in got.items()} == want
    assert len(got) == len(text)
    copies = Counter(tuple(brute_words(t)) for i, t in text.items())
    assert all(r["n_copies"] == (copies[tuple(brute_words(text[i]))] if runs[i] else 0) for i, r in got.items())
    kept = om.keep_one_of_each(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in set(ids) if x is not None) == sorted(set(want.values())) and None in ids


def test_rounds_link_what_the_smallest_id_does_not(spark):
    # a chain: neighbours are near, ends are not, so that classes only close over later rounds
    words = [f"w{i}" for i in range(300)]
    rows = []
    for k in range(30):
        w = list(words)
        for j in range(k):
            w[(j * 9) % 300] = f"y{j}"
        rows.append((1000 - k, " ".join(w)))
    got = om.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {min(i for i, _ in rows)}


def test_empty_table(spark):
    assert om.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_alignment_of_unique_and_of_repeating_runs():
    r = random.Random(8)
    for k in (3, 40, 5000):
        for _ in range(60):
            a = np.array([r.randrange(k) for _ in range(r.randrange(0, 50))], np.uint64)
            b = np.array([x for x in a.tolist() if r.random() < 0.8] + [r.randrange(k) for _ in range(r.randrange(0, 9))], np.uint64)
            want = lcs(a.tolist(), b.tolist())
            assert om.aligned_runs(a, b, 200) == want == om._banded_bits(a, b, 200)
            for band in (0, 1, 4, 11):
                inside = banded_lcs(a.tolist(), b.tolist(), band)
                assert om._banded_bits(a, b, band) == inside <= om.aligned_runs(a, b, band) <= want  # equal ends may lie outside the band


def banded_lcs(a, b, band):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            t[i][j] = max(t[i - 1][j], t[i][j - 1], t[i - 1][j - 1] + 1 if x == y and abs(i - j) <= band else 0)
    return t[-1][-1]


def test_long_texts_are_aligned_fast():
    import time

    r = random.Random(9)
    words = [f"w{r.randrange(5000)}" for _ in range(100_000)]
    other = list(words)
    for _ in range(1500):
        other[r.randrange(len(other))] = "x"
    runs, limits = Words([" ".join(words), " ".join(other)]).grams(5)
    began = time.process_time()
    got = om.similarity(runs[: limits[1]], runs[limits[1] :], 0.8)
    assert 0.8 < got < 0.95 and time.process_time() - began < 1.0


def test_pages_of_one_template_meet_on_rare_runs(spark, monkeypatch):
    r = random.Random(10)
    template = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(60):  # about half of each page is the template's
        rows.append((i, " ".join(template + [f"p{i}x{j}" for j in range(r.choice([80, 100]))])))
    for i in range(60, 90):  # near copies of some of them
        w = rows[i - 60][1].split()
        w[r.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(90, None), (91, ""), (92, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    runs = {i: brute_runs(t) for i, t in rows}
    near = [(a, b) for a in runs for b in runs if a < b and runs[a] and runs[b] and abs(len(runs[a]) - len(runs[b])) < 40 and brute_similarity(runs[a], runs[b]) >= 0.8]
    want = classes(near, runs)
    plain = {r["doc_id"]: r["class_id"] for r in om.near_duplicates(df).collect()}
    used = []
    monkeypatch.setattr(om, "rare_runs", lambda *a, f=om.rare_runs: used.append(1) or f(*a))
    monkeypatch.setattr(om, "BUCKET_PAIRS", 3)
    assert {r["doc_id"]: r["class_id"] for r in om.near_duplicates(df).collect()} == plain == want and used


def test_rare_runs_hold_one_of_every_like_pair(spark):
    import tidemark.llm._base as base

    rows = [x[:2] for x in fixture_rows() if x[0] is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string").dropDuplicates(["doc_id"])
    members = df.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("class"), F.lit(1).cast("long").alias("runs"))
    rare = {}
    for x in om.rare_runs(base.Scratch(spark, "t"), members, df, "doc_id", "text", 0.8).collect():
        rare.setdefault(x["id"], set()).add(x["run"])
    runs = {r["doc_id"]: brute_runs(r["text"]) for r in df.collect()}
    for a in runs:
        for b in runs:
            if a < b and runs[a] and runs[b] and brute_similarity(runs[a], runs[b]) >= 0.8:
                assert rare[a] & rare[b]


def test_components_of_a_hub_a_chain_and_by_shuffles(spark, monkeypatch):
    import tidemark.llm._base as base

    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(37)] + [(1037, 5), (2000, 2001), (2001, 2000), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = classes([(min(e), max(e)) for e in edges], {x for e in edges for x in e})
    for rows in (base.BROADCAST_ROWS, 0):
        monkeypatch.setattr(base, "BROADCAST_ROWS", rows)
        assert {r["id"]: r["class_id"] for r in base.components(base.Scratch(spark, "t"), df).collect()} == want

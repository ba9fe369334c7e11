"""FTRL-proximal against a scalar one in plain Python, its features against plain grams, and edge cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ftrl_toxicity as ft

DOC = "doc_id long, text string"


def coordinates(text):
    return set(ft.features([text])[1].tolist())


def test_features_are_words_pairs_and_skips():
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(12)]
    one = {w: coordinates(w) for w in vocab}
    pair = {(a, b): coordinates(f"{a} {b}") - one[a] - one[b] for a in vocab for b in vocab}
    skip = {}
    for a in vocab:
        for b in vocab:
            m = "mid"
            skip[a, b] = coordinates(f"{a} {m} {b}") - one[a] - one[b] - coordinates(m) - coordinates(f"{a} {m}") - coordinates(f"{m} {b}")
    texts = [" ".join(r.choice(vocab) for _ in range(r.randrange(0, 25))) for _ in range(30)] + [None, "", "W1, w2"]
    doc, coord = ft.features(texts)
    for i, t in enumerate(texts):
        w = (t or "").lower().replace(",", "").split()
        want = set().union(*[one[x] for x in w], *[pair[p] for p in zip(w, w[1:])], *[skip[p] for p in zip(w, w[2:])])
        assert set(coord[doc == i].tolist()) == want and len(coord[doc == i]) == len(want)


def scalar(rows, rounds, weight_of_one):
    """FTRL-proximal, a coordinate at a time."""
    z, n, bz, bn = {}, {}, 0.0, 0.0
    for _ in range(rounds):
        for text, y in rows:
            c = coordinates(text)
            w = {}
            for i in c:
                zi, ni = z.get(i, 0.0), n.get(i, 0.0)
                w[i] = 0.0 if abs(zi) <= ft.L1 else (math.copysign(ft.L1, zi) - zi) / ((ft.BETA + math.sqrt(ni)) / ft.ALPHA + ft.L2)
            b = -bz / ((ft.BETA + math.sqrt(bn)) / ft.ALPHA)
            g = (1 / (1 + math.exp(-max(-35, min(35, sum(w.values()) + b)))) - y) * (weight_of_one if y else 1.0)
            for i in c:
                ni = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(ni + g * g) - math.sqrt(ni)) / ft.ALPHA * w[i]
                n[i] = ni + g * g
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / ft.ALPHA * b
            bn += g * g
    return {i: (math.copysign(ft.L1, v) - v) / ((ft.BETA + math.sqrt(n[i])) / ft.ALPHA + ft.L2) for i, v in z.items() if abs(v) > ft.L1}, -bz / ((ft.BETA + math.sqrt(bn)) / ft.ALPHA)


def corpus():
    r = random.Random(5)
    rows = []
    for i in range(400):
        w = [f"w{r.randrange(60)}" for _ in range(20)]
        if i % 4 == 0:
            w[r.randrange(20)] = r.choice(["vile", "nasty"])
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    return rows


@pytest.mark.parametrize("rounds", [1, 3])
def test_one_shard_equals_scalar_ftrl(spark, monkeypatch, rounds):
    monkeypatch.setattr(ft, "ROUNDS", rounds)
    rows = corpus()
    d = spark.createDataFrame(rows, "doc_id long, text string, label int")
    m = ft.learn(d.select("doc_id", "text"), d.select("doc_id", "label"))
    ordered = [(x["text"], x["label"]) for x in d.orderBy(F.xxhash64(F.col("doc_id").cast("string"))).collect()]
    weights, bias = scalar(ordered, rounds, math.sqrt(3))
    assert len(weights) > 10 and m.coord.tolist() == sorted(weights)
    assert np.allclose(m.weight, [weights[i] for i in sorted(weights)], rtol=1e-5) and m.bias == pytest.approx(bias)


def test_repeated_labels_count_once_and_edges(spark):
    rows = corpus()
    d = spark.createDataFrame(rows, "doc_id long, text string, label int")
    labels = d.select("doc_id", "label")
    a = ft.learn(d.select("doc_id", "text"), labels)
    more = labels.union(labels).union(labels.withColumn("label", F.lit(None).cast("int"))).union(labels.where("doc_id % 4 = 0").withColumn("label", F.lit(0)))
    b = ft.learn(d.select("doc_id", "text"), more)
    assert a.coord.tolist() == b.coord.tolist() and np.array_equal(a.weight, b.weight)
    odd = [(1, None), (None, ""), (2, "vile"), (2, "vile"), (3, "w1 " * 300_000), (4, "vile " * 50_000)]
    df = spark.createDataFrame(odd, DOC).withColumns({"Score": F.lit("old"), "y": F.lit(1)})
    got = ft.score(df, a).collect()
    assert len(got) == len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert ft.score(df.limit(0), a).collect() == []

"""Quantiles by narrowing, resampling without joins, tails, edit distances and subspaces against plain computations."""

import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import draws as D
from tidemark.operators import inference as N
from tidemark.operators import quantiles as Q
from tidemark.operators import reports as R


@pytest.mark.parametrize(("bins", "few"), [(4, 10), (64, 50), (1024, 20_000)])
def test_quantiles_of_groups(spark, bins, few):
    r = np.random.default_rng(bins)
    groups = {
        "even": r.random(3000), "tied": r.integers(0, 5, 2000).astype(float), "one": np.array([7.5]), "same": np.full(900, -3.0), "far": 10.0 ** r.uniform(-12, 12, 1500) * r.choice([-1, 1], 1500),
        "two": np.array([1.0, 4.0]), "huge": np.array([-1.7e308, 0.0, 1.7e308] * 30),
    }
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [(None, 2.0), (None, None), (None, float("nan")), ("none", None), ("none", float("inf"))]
    shares = [0.0, 0.025, 0.3, 0.5, 0.97, 1.0]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {x["g"]: x["q"] for x in Q.exact_quantiles(df, ["g"], F.col("v"), shares, bins=bins, few=few).collect()}
    assert set(got) == {*groups, None, "none"} and got["none"] is None and got[None] == [2.0] * 6
    for g, v in groups.items():
        s = np.sort(v)
        for share, x in zip(shares, got[g], strict=True):
            p = share * (len(s) - 1)
            lo, hi = math.floor(p), math.ceil(p)
            assert x == pytest.approx(s[lo] if lo == hi else (hi - p) * s[lo] + (p - lo) * s[hi], rel=1e-12, abs=1e-300)
    everything = Q.exact_quantiles(df, [], F.col("v"), [0.5], bins=bins, few=few).collect()
    assert everything[0]["q"][0] == pytest.approx(np.median([x for _, x in rows if x is not None and math.isfinite(x)]))


def test_no_task_holds_more_than_a_few_values_of_a_hot_group(spark, monkeypatch):
    held = []
    read_off = Q._read_off

    def watched(good, closed, by):
        inside = Q._within(good, closed.select(*by, "_lo", "_hi").distinct(), by)
        held.append(inside.groupBy(*by, "_lo", "_hi").count().agg(F.max("count")).first()[0])
        return read_off(good, closed, by)

    monkeypatch.setattr(Q, "_read_off", watched)
    df = spark.range(60_000).select(F.lit("hot").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7).alias("v"))
    got = Q.exact_quantiles(df, ["g"], F.col("v"), [0.1, 0.5, 0.99], bins=32, few=300).first()["q"]
    v = np.sort([x["v"] for x in df.collect()])
    assert got == pytest.approx(np.quantile(v, [0.1, 0.5, 0.99]).tolist()) and held and held[0] <= 300


def test_copies_are_poisson(spark):
    n = 200_000
    seen = {x["w"]: x["count"] for x in spark.range(n).select(N.copies(F.lit("s"), F.col("id")).alias("w")).groupBy("w").count().collect()}
    for k in range(6):
        p = math.exp(-1) / math.factorial(k)
        assert abs(seen[k] / n - p) < 5 * math.sqrt(p / n)


def test_interval_of_copies_is_that_of_drawn_clusters(spark):
    r = np.random.default_rng(2)
    rows = [(c, float(m + r.normal())) for c, m in enumerate(r.normal(0.3, 1, 300)) for _ in range(int(r.integers(1, 6)))]
    df = spark.createDataFrame(rows, "k long, diff double")
    a, b = (f(df, "k", "diff", 800).first() for f in (N.cluster_bootstrap, N.poisson_bootstrap))
    width = a["hi"] - a["lo"]
    assert (a["shift"], a["effect"], a["clusters"], a["pairs"]) == pytest.approx((b["shift"], b["effect"], b["clusters"], b["pairs"]))
    assert abs(a["lo"] - b["lo"]) < 0.12 * width and abs(a["hi"] - b["hi"]) < 0.12 * width


def test_resampling_joins_no_draws(spark):
    df = spark.range(1000).select((F.col("id") % 50).alias("k"), F.rand(1).alias("diff"))
    plan = N.poisson_bootstrap(df, "k", "diff", 100)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and plan.count("Join") == 1  # of the one row of sizes with the one row of intervals


def test_tail_of_chi_square(spark):
    x = [0.0, 1e-12, 1e-3, 0.5, 1.0, 2.9, 3.0, 3.841458820694124, 10.0, 80.0, 700.0, 3000.0]
    df = spark.createDataFrame([(v,) for v in x] + [(None,), (-1.0,)], "x double")
    for k in (1, 2, 4, 7, 40):
        got = {r["x"]: r["p"] for r in df.select("x", N.chi_square_tail(F.col("x"), k).alias("p")).collect()}
        assert got[None] is None and got[-1.0] == 1.0
        for v in x:
            h = v / 2
            if k == 1:
                want = math.erfc(math.sqrt(h))
            elif k % 2 == 0:
                want = math.exp(-h) * math.fsum(h**i / math.factorial(i) for i in range(k // 2))
            else:  # odd: the tail of one degree and the steps up from it
                want = math.erfc(math.sqrt(h)) + math.exp(-h) * math.fsum(h ** (i + 0.5) / math.gamma(i + 1.5) for i in range(k // 2))
            assert got[v] == pytest.approx(want, rel=1e-9, abs=1e-12), (k, v)


def test_contingency_of_groups(spark):
    df = spark.createDataFrame([("a", i % 2 == 0, i % 3 == 0) for i in range(60)] + [("b", True, True)] * 3, "g string, p boolean, q boolean")
    got = {r["g"]: r for r in R.contingency(df, F.col("p"), F.col("q"), ["g"]).collect()}
    assert got["a"]["n"] == 60 and got["a"]["p"] == pytest.approx(math.erfc(math.sqrt(got["a"]["chi2"] / 2)), abs=1e-6)
    assert got["b"]["chi2"] is None and got["b"]["p"] is None


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_word_edits_stay_on_the_jvm(spark):
    r = random.Random(4)
    words = ["a", "b", "é", "日本", "", "long word", "﻿", "😀", "A"]
    pairs = [([r.choice(words) for _ in range(r.randrange(0, 30))], [r.choice(words) for _ in range(r.randrange(0, 30))]) for _ in range(80)]
    pairs += [([f"w{i}" for i in range(3000)], [f"w{i}" for i in range(0, 3000, 2)]), ([], []), (["a"], None)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, a array<string>, b array<string>").select("i", N.word_edits(F.col("a"), F.col("b")).alias("d"))
    assert "Python" not in df._jdf.queryExecution().toString()
    got = {x["i"]: x["d"] for x in df.collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i] == (None if b is None else 1500 if len(a) == 3000 else plain_edits(a, b))


def test_shared_subspace_of_all_pairs(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(40, 10)) + 0.5
    x[3, :5] = 0.0
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(40) % 3, "x": x.tolist()}))
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)
    for g in N.mean_squared_cosine(df, "x", ["k"]).collect():
        own = x[np.arange(40) % 3 == g["k"]]
        assert g["n"] == len(own) and g["shared"] == pytest.approx(((unit(own[:, :5]) @ unit(own[:, 5:]).T) ** 2).mean())
    same = spark.createDataFrame([([1.0, 0.0, 2.0, 0.0],)] * 3 + [([0.0, 3.0, 0.0, 1.0],)] * 3, "x array<double>")
    assert N.mean_squared_cosine(same, "x", []).first()["shared"] == pytest.approx(0.5)


@pytest.mark.parametrize("centred", [True, False])
def test_principal_angles(spark, centred):
    r = np.random.default_rng(9)
    x = r.normal(size=(60, 8)) + 3.0
    x[:, 4] = x[:, 0] + 0.1 * r.normal(size=60)
    a, b = (v - v.mean(0) if centred else v for v in (x[:, :4], x[:, 4:]))
    want = np.linalg.svd(np.linalg.qr(a)[0].T @ np.linalg.qr(b)[0], compute_uv=False)
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    got = N.canonical_angles(df, "x", centred).orderBy("i").collect()
    assert [g["cosine"] for g in got] == pytest.approx(want.tolist(), abs=1e-8)
    assert N.canonical_angles(df.limit(0), "x").collect() == []


def test_numpy_draws_are_those_of_columns(spark):
    ids = ["1", "22", "abc", None, "x" * 60, "é", "9" * 19, "", "z" * 47, "y" * 48]
    got = {(at + i, ids[j]): int(x) for at, h in D.draws("p", ids, range(8, 130)) for i, row in enumerate(h) for j, x in enumerate(row)}
    df = spark.createDataFrame([(s,) for s in ids], "id string").withColumn("b", F.explode(F.sequence(F.lit(8), F.lit(129))))
    assert got == {(x["b"], x["id"]): x["h"] for x in df.select("b", "id", N.draw(F.lit("p"), F.col("b"), F.col("id")).alias("h")).collect()}


@pytest.mark.parametrize("near", [6.0, -5.0])  # the second misses every cut
def test_few_rows_of_a_permutation_are_ranked(spark, monkeypatch, near):
    monkeypatch.setattr(N, "NEAR", near)
    ranked = []
    kept = N.written

    def watched(df):
        out = kept(df)
        if "_near" in out.columns:
            ranked.append(out.where("h is not null").count())
        return out

    monkeypatch.setattr(N, "written", watched)
    r = np.random.default_rng(3)
    rows = [(i, "ab"[i % 2], float(r.normal()), int(i % 10 < 2)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "id long, g string, x double, y int")
    got = {(x["g"], x["b"]): x["s"] for x in N.permutation_sums(df, "x", df.groupBy("g").agg(F.sum("y").alias("k")), "id", 30, ["g"]).collect()}
    assert len(ranked) == 1 and ranked[0] < 30 * 20_000 / 8
    h = np.concatenate([x for _, x in D.draws("p", [str(i) for i in range(20_000)], range(30))])
    for g in (0, 1):
        own = np.array([x[2] for x in rows])[g::2]
        for b in range(30):
            first = np.argsort(h[b, g::2], kind="stable")[: sum(x[3] for x in rows[g::2])]
            assert got["ab"[g], b] == pytest.approx(own[first].sum())


def test_constant_columns_are_dead_however_they_are_merged(spark):
    from tidemark.plans.reports_queries import d08

    rows = [(i, [float(i % 7 + j) for j in range(64)], i % 3) for i in range(3 * 49 * 11)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(11)
    assert sorted((x["dim"], x["dead_in"]) for x in d08(lambda _: df).collect()) == [(2, 3), (8, 3)]


def test_word_edits_list_the_words_of_a_pair_once(spark):
    df = spark.createDataFrame([(["a"], ["b"])], "a array<string>, b array<string>").select(N.word_edits(F.col("a"), F.col("b")).alias("d"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_distinct") == 1 and df.first()["d"] == 1


@pytest.mark.parametrize("kind", ["ties", "hot", "distinct", "one"])
def test_rank_bootstrap_by_counts_equals_its_draws(spark, kind):
    r = random.Random(5)
    n = 1 if kind == "one" else 90
    x = {"ties": lambda i: r.choice([None, 1, 2, 3, 50, 51]), "hot": lambda i: 7 if i % 10 else i, "distinct": lambda i: r.random(), "one": lambda i: 1}[kind]
    rows = [(1000 - 3 * i, float(v) if v is not None else None, None if i % 17 == 3 else r.randrange(6) if kind != "distinct" else r.random()) for i in range(n) for v in [x(i)]]
    df = spark.createDataFrame([(i, u, None if v is None else float(v)) for i, u, v in rows], "k long, x double, y double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # ties and parts over many batches
        got = {b["b"]: b["rho"] for b in N.bootstrap_spearman(df, "x", "y", ["k"], 130, "r").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    rows.sort()
    assert sorted(got) == list(range(130))
    for b in (0, 9, 10, 99, 100, 129):
        drawn = [rows[int(hashlib.md5(f"r:{b}:{j}".encode()).hexdigest()[:8], 16) % n] for j in range(n)]
        u, v = (pd.Series([math.inf if d[c] is None else d[c] for d in drawn]).rank() for c in (1, 2))
        want = None if u.nunique() == 1 or v.nunique() == 1 else np.corrcoef(u, v)[0, 1]
        assert got[b] == (pytest.approx(want, abs=1e-9) if want is not None else None)

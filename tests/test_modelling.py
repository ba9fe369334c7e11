"""Models, probes, running sums and permutation tests against plain computations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import folds as K
from tidemark.operators import inference as N
from tidemark.operators import logistic as L
from tidemark.operators import ranks


def gradient_descent(x, y, classes, penalty, steps=6000):
    """Weighted multinomial ridge by small steps: slow and plain."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd > 1e-9, sd, 1.0)
    xb = np.column_stack(((x - mean) / sd, np.ones(len(x))))
    k = np.array([classes.index(v) for v in y])
    weight = np.array([len(k) / (len(classes) * (k == c).sum()) for c in range(len(classes))])[k]
    w = np.zeros((xb.shape[1], len(classes)))
    for _ in range(steps):
        z = xb @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = xb.T @ (weight[:, None] * (p - np.eye(len(classes))[k])) / len(k)
        g[:-1] += penalty * w[:-1]
        w -= 0.3 * g
    return lambda v: np.column_stack(((v - mean) / sd, np.ones(len(v)))) @ w


def grouped(seed, n=160):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, 3)) * [1.0, 0.1, 5.0]
    y = (x[:, 0] + 0.3 * x[:, 2] / 5 + 0.4 * r.standard_normal(n) > 0).astype(int) + (x[:, 2] > 6).astype(int)
    g = np.array(list("abcd"))[r.integers(0, 4, n)]
    return x, y, g


def test_leave_group_out_equals_plain_fits(spark):
    x, y, g = grouped(1)
    rows = spark.createDataFrame([(i, str(g[i]), [float(v) for v in x[i]], int(y[i])) for i in range(len(y))], "doc_id long, lang string, x array<double>, y int").repartition(3)
    got = {r["fold"]: r for r in L.leave_group_out(rows, "lang", "x", "y").collect()}
    for held in "abcd":
        best = (None, -1)
        for penalty in L.GRID:
            hits = 0
            for inner in "abcd":
                if inner != held:
                    tr, te = (g != held) & (g != inner), g == inner
                    classes = sorted(set(y[tr].tolist()))
                    hits += int((np.array(classes)[gradient_descent(x[tr], y[tr].tolist(), classes, penalty)(x[te]).argmax(axis=1)] == y[te]).sum())
            if hits > best[1]:
                best = (penalty, hits)
        tr, te = g != held, g == held
        classes = sorted(set(y[tr].tolist()))
        guess = np.array(classes)[gradient_descent(x[tr], y[tr].tolist(), classes, best[0])(x[te]).argmax(axis=1)]
        assert (got[held]["penalty"], got[held]["n"], got[held]["hits"]) == (best[0], te.sum(), (guess == y[te]).sum())


def test_groups_of_one_class_and_few_groups(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], [float(i % 7), float(i)], 1 if i % 2 else int(i % 3 == 0)) for i in range(40)], "doc_id long, lang string, x array<double>, y int")
    got = {r["fold"]: r for r in L.leave_group_out(rows, "lang", "x", "y").collect()}
    assert got["a"]["penalty"] is None and got["a"]["hits"] == 0 and got["a"]["distinct"] == 0  # the other group has one class
    assert got["b"]["penalty"] == 1.0


def test_probe_finds_what_is_there_and_not_what_is_not(spark):
    r = np.random.default_rng(2)
    rows = []
    for i in range(400):
        v = r.standard_normal(4)
        rows.append((i, [float(a) for a in v], int(v[0] > 0), int(r.random() < 0.5), 1))
    df = spark.createDataFrame(rows, "doc_id long, x array<double>, there int, random int, constant int").withColumn("fold", K.kfold(F.col("doc_id"), 4))
    p = {x["target"]: x for x in L.probes(df, "doc_id", "fold", "x", ["there", "random", "constant"]).collect()}
    assert p["there"]["auc"] > 0.97 and abs(p["random"]["auc"] - 0.5) < 0.12
    assert all(abs(p[c]["permuted_auc"] - 0.5) < 0.12 for c in ("there", "random"))
    assert not p["constant"]["interpretable"] and p["constant"]["auc"] is None
    few = {x["target"]: x for x in L.probes(df.where("doc_id < 19"), "doc_id", "fold", "x", ["there"]).collect()}
    assert not few["there"]["interpretable"] and few["there"]["n"] == 19


def test_ablation_turns_one_family_off(spark):
    x, y, g = grouped(3, 240)
    rows = spark.createDataFrame([(i, str(g[i]), [float(v) for v in x[i]], int(y[i] > 0)) for i in range(len(y))], "doc_id long, lang string, x array<double>, y int")
    got = {(r["variant"], r["seed"]): r["hits"] / r["n"] for r in L.ablation(rows, "lang", "x", "y", {"first": [0], "second": [1]}, 2, "doc_id").collect()}
    assert len(got) == 6 and all(got["first", s] < got["full", s] - 0.15 and abs(got["second", s] - got["full", s]) < 0.1 for s in (0, 1))
    with pytest.raises(KeyError):
        L.ablation(rows, "lang", "x", "y", {"none": [3]}, 1, "doc_id")


def test_dependence_of_copies_and_of_strangers(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(v) for v in a], [float(v) for v in r.standard_normal(3)], [float(v) for v in a + 0.1 * r.standard_normal(3)]) for i, a in enumerate(r.standard_normal((800, 3)))]
    df = spark.createDataFrame(rows, "vec_id long, a array<double>, b array<double>, c array<double>")
    own, other = (L.dependence(df, "vec_id", "a", o).first() for o in ("c", "b"))
    assert own["accuracy"] > 0.7 and own["jsd"] < 0.6 and other["accuracy"] < 0.58 and other["verdict"] == "at chance"


@pytest.mark.parametrize("parts", [1, 7])
def test_running_sums_in_parts(spark, parts):
    r = random.Random(5)
    rows = [(i, r.choice([None, "hot", "hot", "b"]), r.random(), r.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, o double, v long")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {x["id"]: (x["s"], x["n"]) for x in ranks.running_sums(df, ["g"], ["o"], {"s": F.col("v"), "n": F.lit(1)}).collect()}
        place = {x["id"]: x["p"] for x in ranks.numbered(df, ["o"], "p").collect()}
        assert ranks.numbered(df.limit(0), ["o"]).collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for i, g, o, _ in rows:
        before = [x for x in rows if x[1] == g and x[2] < o]
        assert got[i] == (sum(x[3] for x in before), len(before))
    assert [place[x[0]] for x in sorted(rows, key=lambda x: x[2])] == list(range(500))


def test_permutations_by_bins_equal_whole_ranks(spark, monkeypatch):
    monkeypatch.setattr(N, "DRAW_BINS", 8)
    r = random.Random(6)
    rows = [(i, "ab"[i % 2], r.gauss(0, 1) + (i % 5 == 0), int(i % 5 == 0)) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, g string, x double, y int")
    got = {(x["g"], x["b"]): x["s"] for x in N.permutation_sums(df, "x", df.groupBy("g").agg(F.sum("y").alias("k")), "id", 20, ["g"]).collect()}
    draws = {(x["id"], x["b"]): x["h"] for x in df.select("id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("b")).withColumn("h", N.draw(F.lit("p"), F.col("b"), F.col("id"))).collect()}
    for g in "ab":
        own = [x for x in rows if x[1] == g]
        for b in range(20):
            first = sorted(own, key=lambda x: (draws[x[0], b], x[0]))[: sum(x[3] for x in own)]
            assert got[g, b] == pytest.approx(sum(x[2] for x in first))
    t = {x["g"]: x for x in N.permutation_test(df.union(df.limit(0)), "x", "y", "id", 99, by=["g"]).collect()}
    assert set(t) == {"a", "b"} and all(0 < x["p"] <= 1 for x in t.values())


def test_fold_summary_flags_what_had_to_fall_back(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "id long, g string")
    got = K.fold_summary(rows, "id", "g").collect()
    assert all(r["fallback"] and r["disjoint"] and r["train"] == 0 and r["test"] == r["validation"] == 5 for r in got) and len(got) == 2


def test_subspace_and_angles(spark):
    r = np.random.default_rng(7)
    a = r.standard_normal((300, 3))
    same = spark.createDataFrame([([float(v) for v in [*x, *x]],) for x in a], "x array<double>")
    apart = spark.createDataFrame([([float(v) for v in [*x, 0.0, 0.0, 0.0]],) for x in a] + [([0.0, 0.0, 0.0, *[float(v) for v in x]],) for x in a], "x array<double>")
    assert N.shared_fraction(same, "x", []).first()["shared"] == pytest.approx(1) and N.shared_fraction(apart, "x", []).first()["shared"] == pytest.approx(0)
    assert all(x["cosine"] == pytest.approx(1) for x in N.canonical_angles(same, "x", False).collect())
    assert all(x["degrees"] == pytest.approx(90) for x in N.canonical_angles(apart, "x", False).collect())


def test_probes_of_classes_and_labels(spark):
    r = np.random.default_rng(12)
    rows = []
    for i in range(300):
        c = i % 3
        x = r.normal(size=4)
        x[0] += 3 * (c == 0)  # class a can be read, b and c can't be told apart
        rows.append((i, i % 4, x.tolist(), "rare" if i < 5 else "abc"[c], ["plus"] if x[1] > 0 else [] if i % 2 else ["coin", None]))
    df = spark.createDataFrame(rows + [(900, 0, [0.0] * 4, None, None)], "id long, fold int, x array<double>, c string, l array<string>")
    got = {g["class"]: g for g in L.class_probes(df, "id", "fold", "x", "c").collect()}
    assert set(got) == {"a", "b", "c", "rare"} and got["rare"]["skipped"] and got["rare"]["auc"] is None
    assert got["a"]["auc"] > 0.95 and all(g["n"] == 300 and g["usable"] == 3 and not g["covered"] for g in got.values())
    assert got["b"]["worst_auc"] == max(got[k]["auc"] for k in "abc") == got["a"]["auc"]
    assert got["b"]["mean_auc"] == pytest.approx(sum(got[k]["auc"] for k in "abc") / 3)
    assert abs(got["a"]["permuted_auc"] - 0.5) < 0.15
    labels = {g["class"]: g for g in L.label_probes(df, "id", "fold", "x", "l").collect()}
    assert set(labels) == {"plus", "coin"} and labels["plus"]["auc"] > 0.95 and all(g["covered"] and g["usable"] == 2 for g in labels.values())
    assert labels["plus"]["positives"] == sum(x[1] > 0 for _, _, x, _, _ in rows)
    assert L.class_probes(df.limit(0), "id", "fold", "x", "c").collect() == []


@pytest.mark.parametrize("name", ["m07_model", "m05"])
def test_models_read_measures_not_texts(spark, monkeypatch, name):
    from tidemark.plans import modelling_queries as M
    from tidemark.plans.registry import Tables

    seen = []

    class Seen(Exception):
        pass

    def watched(rows, *args):
        seen.append(rows._jdf.queryExecution().optimizedPlan().toString())
        raise Seen

    monkeypatch.setattr(M.L, "leave_group_out", watched)
    monkeypatch.setattr(M.L, "probes", watched)
    with pytest.raises(Seen):
        getattr(M, name)(Tables(spark, "/root/testdata/sf0.001"))
    assert len(seen) == 1 and "regexp_replace" not in seen[0]

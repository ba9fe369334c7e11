"""Site posteriors against a plain computation, and edge cases."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import site_quality as sq

DOC = "doc_id long, text string, lang string, source string"


def texts(n, seed=6):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        w = [f"w{r.randrange(300)}" for _ in range(r.choice([5, 50]))]
        bad = r.random() < (0.9 if i % 7 == 0 else 0.2)
        rows.append((i, " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w), r.choice(["en", "de", None]), r.choice([None, *(f"s{k}" for k in range(7))]) if i % 7 else "s0"))
    return rows


def plain(rows, model):
    """The same posteriors from dicts, a row at a time."""
    p = {k: float(v) for k, v in enumerate(model.probability([r[1] for r in rows]))}
    host, path = defaultdict(list), defaultdict(list)
    for k, (_, _, lang, source) in enumerate(rows):
        host[source].append(p[k])
        path[source, lang].append(p[k])
    rate = (sum(p.values()) + 1) / (len(p) + 2)

    def strength(groups):
        big = [(v, parent) for v, parent in groups if len(v) >= 2]
        n = sum(len(v) for v, _ in big)
        if not n:
            return 100.0
        spread = sum(len(v) * (sum(v) / len(v) - q) ** 2 for v, q in big) - sum(q * (1 - q) for _, q in big)
        return min(1e4, max(1.0, sum(len(v) * q * (1 - q) for v, q in big) / n / max(spread / n, 1e-9) - 1))

    m_host = strength([(v, rate) for v in host.values()])
    m_path = strength([(v, (sum(host[s]) + m_host * rate) / (len(host[s]) + m_host)) for (s, _), v in path.items()])
    out = []
    for k, (_, _, lang, source) in enumerate(rows):
        h, q = host[source], path[source, lang]
        p_host = min(1 - 1e-6, max(1e-6, (sum(h) - p[k] + m_host * rate) / (len(h) - 1 + m_host)))
        p_path = min(1 - 1e-6, max(1e-6, (sum(q) - p[k] + m_path * p_host) / (len(q) - 1 + m_path)))
        odds = math.log(p[k] / (1 - p[k])) - math.log(model.rate / (1 - model.rate)) + math.log(p_path / (1 - p_path))
        out.append((p[k], p_host, p_path, 1 / (1 + math.exp(-odds))))
    return out


@pytest.mark.parametrize("rows", [300_000, 0])
def test_posteriors_equal_plain_computation(spark, monkeypatch, rows):
    import tidemark.llm._base as base

    monkeypatch.setattr(base, "BROADCAST_ROWS", rows)
    data = texts(400) + [(900, None, None, None), (901, "", "en", "alone"), (902, "one two", "en", "s1"), (902, "one two", "en", "s1")]
    df = spark.createDataFrame(data, DOC)
    model = sq.learn(df.where("doc_id < 300"), spark.createDataFrame([(i, int("!!" not in t)) for i, t, *_ in data[:300]], "doc_id long, label int"))
    got = defaultdict(list)
    for x in sq.classify(df, model).collect():
        got[x["doc_id"]].append((x["p_doc"], x["p_host"], x["p_path"], x["p_good"], x["predicted"]))
    for (i, *_), want in zip(data, plain(data, model), strict=True):
        assert any(np.allclose(g[:4], want, rtol=1e-9) and g[4] == int(g[3] >= 0.5) for g in got[i]), i
    slim = sq.classify(df, model, keep_text=False)
    assert "text" not in slim.columns and slim.count() == len(data)


def test_repeated_labels_clashing_columns_and_empty_tables(spark):
    data = texts(200)
    df = spark.createDataFrame(data, DOC)
    labels = spark.createDataFrame([(i, int("!!" not in t)) for i, t, *_ in data], "doc_id long, label int")
    a, b = sq.learn(df, labels), sq.learn(df, labels.union(labels).union(labels.withColumn("label", F.lit(None).cast("int"))))
    assert np.allclose(a.weight, b.weight) and a.rate == b.rate
    odd = df.withColumns({"_site": F.lit("x"), "_sums": F.lit(1), "P_DOC": F.lit("old"), "h": F.lit(2)})
    out = sq.classify(odd, a)
    assert {"_site", "_sums", "h"} <= set(out.columns) and {r["_site"] for r in out.collect()} == {"x"} and out.count() == 200
    assert sq.classify(odd.limit(0), a).collect() == []
    none = sq.learn(df, labels.limit(0))
    assert {round(r["p_doc"], 6) for r in sq.classify(df, none).collect()} == {0.5}

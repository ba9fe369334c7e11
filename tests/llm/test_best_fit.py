"""Best-fit packing against a linear scan, and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import best_fit_packing as bf


def linear(sizes, sources, clusters, capacity):
    """Every piece looks at all bins and takes the fullest that has room and neither its source nor its cluster."""
    bins, out = [], []
    for n, s, c in zip(sizes, sources, clusters, strict=True):
        fits = [k for k, (left, ss, cc) in enumerate(bins) if left >= n and (s is None or s not in ss) and (c is None or c not in cc)]
        if fits:
            k = min(fits, key=lambda k: (bins[k][0], k))
        else:
            k = len(bins)
            bins.append([capacity, set(), set()])
        bins[k][0] -= n
        bins[k][1].add(s)
        bins[k][2].add(c)
        out.append(k)
    return out, len(bins)


@pytest.mark.parametrize("seed", range(12))
def test_equals_linear_scan(seed):
    r = random.Random(seed)
    n = r.randrange(1, 300)
    sizes = [r.randrange(1, 101) for _ in range(n)]
    if seed % 2:
        sizes.sort(reverse=True)
    sources = [r.choice([None, "hot", "hot", *"abcdefgh"]) for _ in range(n)]
    clusters = [r.choice([None, None, *range(20)]) for _ in range(n)]
    assert bf.best_fit(sizes, sources, clusters, 100) == linear(sizes, sources, clusters, 100)


def test_repeated_null_and_clashing(spark, monkeypatch):
    monkeypatch.setattr(bf, "SHARD_ROWS", 20)
    rows = [(None, "one two three", "s")] * 70 + [(7, "one two three", None)] * 30 + [(8, None, "s"), (9, "", "t"), (10, "w " * 5000, "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"n_tokens": F.lit(-1), "cluster": F.lit("mine"), "shard": F.lit(0), "spread": F.lit(0.0), "bin_id": F.lit("b")})
    out = bf.pack_texts(df, capacity=64).collect()
    by = {}
    for x in out:
        by.setdefault(x["doc_id"], []).append(x)
    assert len(by[None]) == 70 and len(by[7]) == 30 and [x["n_tokens"] for x in by[8] + by[9]] == [1, 1]
    assert sum(x["n_tokens"] for x in by[10]) == 5001 and sorted(x["start"] for x in by[10]) == list(range(0, 5001, 64))
    assert len({x["bin_id"] for x in out if x["doc_id"] in (None, 7)}) == 100  # copies: one each
    assert len({x["bin_id"] >> 32 for x in out}) > 3  # repeated rows are not one shard
    assert bf.pack_texts(df.limit(0)).collect() == []

"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, pairs of neighbours and pairs with one word between. Training
takes a bounded sample of labelled rows, dealt to shards; every shard runs FTRL-proximal (a learning rate per
coordinate, L1 for sparse weights) from the shared state, and the shards' states are averaged by coordinate in Spark
after each round. The state of every touched coordinate is kept from round to round, at most ``2 ** BITS`` of them. Of
the weights nearly all are zero; the others are broadcast to score every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._base import Scratch, append_columns, labelled_sample
from tidemark.llm._words import Words, chunks, mix

BITS = 20
#: Bound of the training sample in labelled rows, and how it is dealt: a shard for so many rows, up to so many shards.
SAMPLE_ROWS = 24_000
SHARD_ROWS, SHARDS = 1_000, 6
ROUNDS = 2
ALPHA, BETA, L1, L2 = 0.3, 1.0, 3.0, 0.05
_ONE, _TWO, _SKIP = (np.uint64(x) for x in (0x9AE16A3B2F90404F, 0xC949D7C7509E6557, 0xFF51AFD7ED558CCD))


def features(texts: list, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, coordinate) pairs of a list of texts, in that order; only coordinates that ``keep`` marks."""
    w = Words(texts)
    doc = np.repeat(np.arange(w.n_docs), w.counts)
    docs, coords = [], []
    for step, salt in ((0, _ONE), (1, _TWO), (2, _SKIP)):
        n = len(w.hash) - step
        if n <= 0:
            continue
        h = mix(w.hash * salt) if step == 0 else mix(w.hash[:n] * salt + w.hash[step:])
        c = (h >> np.uint64(64 - BITS)).astype(np.int64)
        ok = doc[:n] == doc[step:]
        if keep is not None:
            ok &= keep[c]
        docs.append(doc[:n][ok])
        coords.append(c[ok])
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.concatenate(docs) << BITS | np.concatenate(coords))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The closed form of FTRL-proximal: exactly zero where |z| is at most L1."""
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _epoch(texts: list, labels: np.ndarray, z: np.ndarray, n: np.ndarray, bias: np.ndarray, weight_of_one: float) -> None:
    """One pass over a shard, updating z, n and the bias pair (z, n) in place. The bias has no L1."""
    for lo, hi in chunks(texts):
        doc, coord = features(texts[lo:hi])
        limits = np.searchsorted(doc, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            c = coord[limits[i] : limits[i + 1]]
            w = weights(z[c], n[c])
            b = -bias[0] / ((BETA + np.sqrt(bias[1])) / ALPHA)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - labels[lo + i]
            g *= weight_of_one if labels[lo + i] else 1.0
            sigma = (np.sqrt(n[c] + g * g) - np.sqrt(n[c])) / ALPHA
            z[c] += g - sigma * w
            n[c] += g * g
            bias[0] += g - (np.sqrt(bias[1] + g * g) - np.sqrt(bias[1])) / ALPHA * b
            bias[1] += g * g


class Model:
    """Sparse weights: ``coord`` ascending, ``weight``; and the bias."""

    def __init__(self, coord: np.ndarray, weight: np.ndarray, bias: float):
        self.coord, self.weight, self.bias = coord, weight, bias

    def score(self, texts: list) -> np.ndarray:
        keep = np.zeros(1 << BITS, bool)
        keep[self.coord] = True
        dense = np.zeros(1 << BITS)
        dense[self.coord] = self.weight
        doc, coord = features(texts, keep)
        logit = np.full(len(texts), self.bias)
        np.add.at(logit, doc, dense[coord])
        return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> Model:
    """Fit on the texts of at most about ``SAMPLE_ROWS`` of ``labels(key, label)``; a document labelled more than once
    counts once, with its largest label. With one class or none, every score is the smoothed rate of label 1."""
    spark = docs.sparkSession
    sample, total, ones = labelled_sample(Scratch(spark, "toxicity"), docs, labels, SAMPLE_ROWS, text, key)
    if not 0 < ones < total:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((ones + 0.5) / (total - ones + 0.5))))
    n_shards = max(1, min(SHARDS, min(total, SAMPLE_ROWS) // SHARD_ROWS))
    weight_of_one = float(np.sqrt((total - ones) / ones))  # half way to balanced classes
    shards = sample.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(n_shards))).repartition(n_shards, "shard").sortWithinPartitions("shard", "h")
    z, n, bias = np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(2)
    for _ in range(ROUNDS):
        at = np.flatnonzero(n)
        state = spark.sparkContext.broadcast((at, z[at], n[at], bias.copy()))

        def run(frames: Iterator[pd.DataFrame], state=state) -> Iterator[pd.DataFrame]:
            at, z0, n0, bias0 = state.value
            z1, n1, b1 = np.zeros(1 << BITS), np.zeros(1 << BITS), bias0.copy()
            z1[at], n1[at] = z0, n0
            seen = 0
            for pdf in frames:
                _epoch(pdf["t"].tolist(), pdf["y"].to_numpy(), z1, n1, b1, weight_of_one)
                seen += len(pdf)
            if seen:
                c = np.flatnonzero(n1)
                yield pd.DataFrame({"c": np.append(c, -1), "z": np.append(z1[c], b1[0]), "n": np.append(n1[c], b1[1])})

        # a coordinate that a shard never saw stays as it was there; the mean is over the shards that moved it
        states = shards.select("t", "y").mapInPandas(run, "c long, z double, n double")
        mean = states.groupBy("c").agg(F.avg("z").alias("z"), F.avg("n").alias("n")).toArrow()  # 2 ** BITS + 1 rows at most
        c, z_mean, n_mean = (mean.column(k).to_numpy() for k in ("c", "z", "n"))
        z[:], n[:] = 0, 0
        z[c[c >= 0]], n[c[c >= 0]] = z_mean[c >= 0], n_mean[c >= 0]
        bias[:] = z_mean[c < 0][0], n_mean[c < 0][0]
        state.unpersist()
    w = weights(z, n)
    coord = np.flatnonzero(w)
    return Model(coord, w[coord].astype(np.float32), float(-bias[0] / ((BETA + np.sqrt(bias[1])) / ALPHA)))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row with ``score`` (0 to 1) and ``predicted`` (1 if the score is at least 0.5).

    A null or empty text has no features and gets the bias alone. Whole texts are used, whatever their length; repeated
    rows score alike. Columns of these names are replaced; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list) -> tuple:
        s = sent.value.score(texts)
        return s, (s >= 0.5).astype(np.int32)

    return append_columns(docs, [text], "score double, predicted int", run)

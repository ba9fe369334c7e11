"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

1. A logistic model over a dozen text measures, fitted on a bounded sample of labelled rows, gives each document a
   probability of being good, and with the sample's rate a likelihood ratio.
2. Those probabilities of all documents are summed by (host, path) and by host. A host's rate is shrunk towards the
   global one and a path's towards its host's, with prior strengths estimated from the spread between groups (method
   of moments): a site of two pages stays near its parent, one of a thousand keeps its own rate.
3. A document's posterior odds are its likelihood ratio times the odds of its path, from which its own probability is
   left out.

Texts are measured once: the rows are written with their probability, and the sums and the result are made from that.
The sums have map-side combine, so a hot host costs a row per task; the table of paths is broadcast only after its
rows are counted, else it is a skewed sort-merge join.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._base import Scratch, append_columns, free_name, labelled_sample, lookup_join
from tidemark.llm._words import Words

#: Bound of the training sample in labelled rows.
SAMPLE_ROWS = 30_000
MEASURES = 12
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:?'\"()-"]] = True


def measures(texts: list) -> np.ndarray:
    """Measures of each text, shape (texts, MEASURES); rates are on a log scale, so that a few per cent of junk show."""
    w = Words(texts)
    raw = np.frombuffer(b"\x00".join(t.encode("utf-8", "surrogatepass") if t else b"" for t in texts), np.uint8)
    size, n = np.diff(w.begin) - 1, w.counts
    out = np.zeros((w.n_docs, MEASURES))

    def per_doc(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[w.begin[1:] - 1] - total[w.begin[:-1]]  # without the mark between texts

    chars, words = np.maximum(size, 1), np.maximum(n, 1)
    bang, bar, line = raw == 33, raw == 124, raw == 10
    ascii_symbol = (raw > 32) & (raw < 127) & ~((raw >= 48) & (raw <= 57)) & ~_UPPER[raw] & ~((raw >= 97) & (raw <= 122)) & ~_STOP[raw] & ~bang & ~bar
    repeat = np.append(False, w.hash[1:] == w.hash[:-1]) if len(w.hash) else np.zeros(0, bool)
    total = np.concatenate(([0], np.cumsum(repeat, dtype=np.int64)))
    again = total[w.first[1:]] - total[w.first[:-1]]
    runs, limits = w.grams(3)
    distinct, distinct_runs = np.zeros(w.n_docs), np.zeros(w.n_docs)
    for d in np.flatnonzero(n):
        distinct[d] = len(np.unique(w.hash[w.first[d] : w.first[d + 1]]))
        distinct_runs[d] = len(np.unique(runs[limits[d] : limits[d + 1]])) / (limits[d + 1] - limits[d])
    rate = lambda x, of: np.log1p(100 * x / of)
    out[:, 0] = rate(per_doc(_UPPER[raw]), chars)
    out[:, 1] = rate(per_doc(bang), words)
    out[:, 2] = rate(per_doc(bar), words)
    out[:, 3] = rate(per_doc(ascii_symbol), chars)
    out[:, 4] = rate(per_doc((raw >= 48) & (raw <= 57)), chars)
    out[:, 5] = rate(again, words)
    out[:, 6] = np.log1p(n)
    out[:, 7] = per_doc(~_SPACE[raw]) / words / 10
    out[:, 8] = rate(per_doc(_STOP[raw]), words)
    out[:, 9] = rate(per_doc(line), words)
    out[:, 10] = np.log(np.maximum(distinct, 1)) - 0.8 * np.log1p(n)
    out[:, 11] = 1 - distinct_runs
    return out


class Model:
    """Logistic weights over standardised measures, and the rate of good rows they were fitted at."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray, rate: float):
        self.mean, self.scale, self.weight, self.rate = mean, scale, weight, rate

    def probability(self, texts: list) -> np.ndarray:
        x = (measures(texts) - self.mean) / self.scale
        p = 1 / (1 + np.exp(-np.clip(x @ self.weight[1:] + self.weight[0], -30, 30)))
        return np.clip(p, 1e-4, 1 - 1e-4)


def _constant(rate: float) -> Model:
    return Model(np.zeros(MEASURES), np.ones(MEASURES), np.append(np.log(rate / (1 - rate)), np.zeros(MEASURES)), rate)


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", ridge: float = 1.0) -> Model:
    """Fit on the texts of at most about ``SAMPLE_ROWS`` of ``labels(key, label)``. With one class or none, every
    document gets the smoothed rate of good ones."""
    sample, total, good = labelled_sample(Scratch(docs.sparkSession, "quality"), docs, labels, SAMPLE_ROWS, text, key)
    if not 0 < good < total:
        return _constant((good + 1) / (total + 2))
    data = append_columns(sample, ["t"], "m array<double>", lambda texts: (list(measures(texts)),)).select("h", "y", "m").toPandas().sort_values("h")
    if data["y"].nunique() < 2:
        return _constant((good + 1) / (total + 2))
    x, y = np.stack(data["m"].to_list()), data["y"].to_numpy().astype(float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = np.column_stack((np.ones(len(x)), (x - mean) / scale))
    w, keep = np.zeros(x.shape[1]), np.diag([0.0] + [ridge] * MEASURES)
    for _ in range(25):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Model(mean, scale, w, float(y.mean()))


def _strength(groups: DataFrame, parent: str) -> float:
    """Prior strength from the spread of group rates around their parents', beyond what sampling explains."""
    big = groups.where("n >= 2")
    r = big.agg(
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col(parent), F.lit(2))).alias("spread"),
        F.sum(F.col(parent) * (1 - F.col(parent))).alias("noise"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col(parent) * (1 - F.col(parent))).alias("pq"),
    ).first()
    if not r["n"]:
        return 100.0
    between = (r["spread"] - r["noise"]) / r["n"]
    return float(np.clip(r["pq"] / r["n"] / max(between, 1e-9) - 1, 1.0, 1e4))


def _site(host: str, path: str):
    """Null-safe key of a host and a path."""
    part = lambda c, n: (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n), F.col(c).isNull().alias(n + "n"))
    return F.struct(*part(host, "h"), *part(path, "p"))


def site_rates(scratch: Scratch, scored: DataFrame, host: str, path: str) -> tuple[DataFrame, float, float, float]:
    """Sums by (host, path) with their host's sums, and the global rate and both prior strengths."""
    paths = scratch.save(scored.select(_site(host, path).alias("_site"), "p_doc").groupBy("_site").agg(F.count("*").alias("n"), F.sum("p_doc").alias("s")), "paths")
    top = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    rate = (top["s"] + 1) / (top["n"] + 2) if top["n"] else 0.5
    hosts = paths.groupBy("_site.h", "_site.hn").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    m_host = _strength(hosts.withColumn("parent", F.lit(rate)), "parent")
    both = paths.select("_site", "n", "s", F.col("_site.h").alias("h"), F.col("_site.hn").alias("hn")).join(hosts.select("h", "hn", F.col("n").alias("host_n"), F.col("s").alias("host_s")).hint("shuffle_hash"), ["h", "hn"])
    m_path = _strength(both.withColumn("parent", (F.col("host_s") + m_host * rate) / (F.col("host_n") + m_host)), "parent")
    return both.select("_site", "n", "s", "host_n", "host_s"), rate, m_host, m_path


def classify(docs: DataFrame, model: Model, text: str = "text", host: str = "source", path: str = "lang", keep_text: bool = True) -> DataFrame:
    """Every row with ``p_doc``, ``p_host``, ``p_path`` (rates without the row itself), ``p_good`` and ``predicted``.

    Null hosts are one host, null paths one path of theirs. A null or empty text is measured as a text without
    characters. Repeated rows count and are judged one by one. Columns of these names are replaced; an empty table
    gives an empty result. Without ``keep_text`` the column ``text`` is left out, and not written.
    """
    names = ["p_doc", "p_host", "p_path", "p_good", "predicted"]
    base = docs.drop(*names)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    scratch = Scratch(docs.sparkSession, "quality")
    scored = append_columns(base, [text], "p_doc double", lambda texts: (sent.value.probability(texts),), without=() if keep_text else (text,))
    scored = scratch.save(scored, "scored")
    table, rate, m_host, m_path = site_rates(scratch, scored, host, path)
    site, sums = free_name(base, "_site"), free_name(base, "_sums")
    table = table.select(F.col("_site").alias(site), F.struct("n", "s", "host_n", "host_s").alias(sums))
    j = lookup_join(scored.withColumn(site, _site(host, path)), table, [site])
    p, g = F.col("p_doc"), F.col(sums)
    p_host = (g["host_s"] - p + m_host * rate) / (g["host_n"] - 1 + m_host)
    p_path = (g["s"] - p + m_path * F.col("p_host")) / (g["n"] - 1 + m_path)
    safe = lambda c: F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), c))
    j = j.withColumn("p_host", safe(p_host)).withColumn("p_path", safe(p_path))
    logit = lambda c: F.log(c / (1 - c))
    odds = logit(p) - float(np.log(model.rate / (1 - model.rate))) + logit(F.col("p_path"))
    j = j.withColumn("p_good", 1 / (1 + F.exp(-odds))).withColumn("predicted", (F.col("p_good") >= 0.5).cast("int"))
    return j.select(*[F.col(f"`{c}`") for c in base.columns if keep_text or c.lower() != text.lower()], *names)

"""URL filter: rules first, else the ratio of two character language models.

Urls that a rule decides train two variable-order Markov models, one of accepted and one of rejected urls. A model
predicts a character from its longest known context of up to ``ORDER - 1`` characters; each order is smoothed into the
next shorter one in proportion to how often the context was seen (Dirichlet prior), down to the uniform distribution.
Counts are exact: windows of ``ORDER`` characters are numbered without a hash and counted by Spark in a table that grows
with the urls, from which the shorter n-grams are summed. The log-likelihood difference per character is compared with a
threshold calibrated on a fifth of the ruled urls that the counts leave out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import _base
from tidemark.llm._base import Scratch, lookup_join

ORDER = 6
PRIOR = 2.0
#: The end of a url, and each of the 256 bytes
SYMBOLS = 257
#: Symbols and the mark before the begin
BASE = SYMBOLS + 1
#: Urls that are cut into windows at once
CHUNK = 20_000
#: Windows with more than one in so many of all places are joined by broadcast
HOT = 2000
BINS = 2048
RANGE = 4.0
#: (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_and_path(url: str) -> tuple:
    """Columns of a url column: host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return low(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1)), F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_columns(host, path, rules: list[tuple] = RULES) -> tuple:
    """The rule that decides (like ``net/``) and its verdict, or nulls. A rule fits its host and all subdomains if the
    path begins with its own; of several the one with the longest host and path wins."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0], r[1])):
        fits = ((host == F.lit(h)) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _windows(urls: list) -> tuple[np.ndarray, np.ndarray]:
    """For every byte (and an end mark) of the urls: the url, and the byte with the ``ORDER - 1`` before it as
    a number of ``ORDER`` digits in base ``BASE``. The n-grams that end there are its last digits, so nothing is hashed."""
    raw = [(u or "").encode("utf-8", "replace") for u in urls]
    size = np.array([len(r) for r in raw], np.int64)
    flat = np.frombuffer(b"".join(raw), np.uint8)
    sym = flat.astype(np.int64) + 1
    owner = np.repeat(np.arange(len(raw)), size + 1)
    limits = np.concatenate(([0], np.cumsum(size + 1)))
    seq = np.zeros(int(limits[-1]), np.int64)  # 0 ends a url
    seq[np.delete(np.arange(len(seq)), limits[1:] - 1)] = sym
    place = np.arange(len(seq)) - limits[owner]
    out = seq.copy()
    for k in range(1, ORDER):  # one more character to the left; before the begin stands a mark
        back = np.where(place >= k, np.concatenate((np.zeros(min(k, len(seq)), np.int64), seq[: max(0, len(seq) - k)])), SYMBOLS)
        out += back * BASE**k
    return owner, out


def _spread(urls: DataFrame) -> DataFrame:
    """``(uid, w)`` for every window of the urls ``(uid, u)``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for a in range(0, len(pdf), CHUNK):
                part = pdf.iloc[a : a + CHUNK]
                owner, w = _windows(part["u"].tolist())
                yield pd.DataFrame({"uid": part["uid"].to_numpy()[owner], "w": w})

    return urls.select("uid", "u").mapInPandas(run, "uid long, w long")


def _count(urls: DataFrame) -> DataFrame:
    """``(w, n, n0, n1)`` for every window of the urls ``(u, n0, n1)``: the urls it is in (once per place), and its
    counts in rejected and accepted ones. Summed within a batch first; the table grows with the distinct windows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for a in range(0, len(pdf), CHUNK):
                part = pdf.iloc[a : a + CHUNK]
                owner, w = _windows(part["u"].tolist())
                yield pd.DataFrame({"w": w, "n": 1, "n0": part["n0"].to_numpy()[owner], "n1": part["n1"].to_numpy()[owner]}).groupby("w", as_index=False).sum()

    found = urls.select("u", "n0", "n1").mapInPandas(run, "w long, n long, n0 long, n1 long")
    return found.groupBy("w").agg(*[F.sum(c).alias(c) for c in ("n", "n0", "n1")])


def _log_ratios(windows: DataFrame) -> DataFrame:
    """``(w, n, lr)``: log P(accepted) - log P(rejected) of the last character of each window ``(w, n, n0, n1)``.

    An order has one row per distinct n-gram, summed from the windows that end in it. At most ``BASE`` n-grams share a
    context, and as many share the next shorter n-gram, so no join or window here has a hot key.
    """
    scored = None
    for k in range(ORDER):
        g = windows.groupBy((F.col("w") % F.lit(BASE ** (k + 1))).alias("g")).agg(F.sum("n").alias("n"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        if k == 0:  # BASE rows at most
            g = g.crossJoin(F.broadcast(g.agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1")))).withColumns({"q0": F.lit(1.0 / BASE), "q1": F.lit(1.0 / BASE)})
        else:
            same = Window.partitionBy(F.expr(f"g div {BASE}"))
            g = g.withColumns({"c0": F.sum("n0").over(same), "c1": F.sum("n1").over(same), "_s": F.col("g") % F.lit(BASE**k)})
            g = g.join(scored.select(F.col("g").alias("_s"), F.col("p0").alias("q0"), F.col("p1").alias("q1")), "_s")
        smooth = lambda y: ((F.col(f"n{y}") + PRIOR * F.col(f"q{y}")) / (F.col(f"c{y}") + PRIOR)).alias(f"p{y}")
        scored = g.select("g", "n", smooth(0), smooth(1))
    return scored.select(F.col("g").alias("w"), "n", (F.log("p1") - F.log("p0")).alias("lr"))


def _mean_ratios(scratch: Scratch, urls: DataFrame, windows: DataFrame) -> DataFrame:
    """``(u, llr)`` of the distinct urls ``(uid, u)``, all of whose windows are in ``windows``; a written table.

    A small table of windows is broadcast. Beyond that the hot ones, of which there are at most ``HOT``, are broadcast
    and the others joined by a shuffle, where no window has more than a ``HOT``-th of the rows.
    """
    table = scratch.save(_log_ratios(windows), "ratios")
    each = _spread(urls)
    sums = lambda d: d.groupBy("uid").agg(F.sum("lr").alias("s"), F.count("*").alias("c"))
    size = table.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    if size["rows"] <= _base.BROADCAST_ROWS:
        parts = sums(each.join(F.broadcast(table.select("w", "lr")), "w"))
    else:
        hot = F.col("n") * HOT > F.lit(size["n"])
        often, rare = table.where(hot).select("w", "lr"), table.where(~hot).select("w", "lr")
        cold = each.join(F.broadcast(often.select("w")), "w", "left_anti").join(rare.hint("merge"), "w")
        parts = sums(each.join(F.broadcast(often), "w")).union(sums(cold)).groupBy("uid").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    return scratch.save(urls.select("uid", "u").join(parts.hint("merge"), "uid").select("u", (F.col("s") / F.col("c")).alias("llr")), "urls")


class Model:
    """Exact counts of windows in rejected and accepted urls as a written table (none if a class is missing), and the
    threshold of the ratio."""

    def __init__(self, spark: SparkSession, windows: DataFrame | None, threshold: float = 0.0):
        self.spark, self.windows, self.threshold = spark, windows, threshold

    def ratio(self, urls: list) -> np.ndarray:
        """Mean over characters of log P(accepted) - log P(rejected), for a list of urls on the driver."""
        df = self.spark.createDataFrame([(u or "",) for u in urls], "u string")
        got = {r["u"]: r["llr"] for r in _ratios(self, df).collect()}
        return np.array([got[u or ""] for u in urls])


def _distinct(scratch: Scratch, urls: DataFrame) -> DataFrame:
    """The distinct urls of ``(u, y)`` as a written table ``(uid, u, m0, m1, held)`` with their rows of either class."""
    d = urls.where(F.col("u").isNotNull()).groupBy("u").agg(F.count_if(F.col("y") == 0).alias("m0"), F.count_if(F.col("y") == 1).alias("m1"))
    return scratch.save(d.select(F.monotonically_increasing_id().alias("uid"), "u", "m0", "m1", (F.crc32(F.col("u").cast("binary")) % 5 == 0).alias("held")), "distinct")


def _ratios(model: Model, urls: DataFrame) -> DataFrame:
    """``(u, llr)`` for the distinct urls of ``urls(u)`` by a model that may not have seen their windows."""
    scratch = Scratch(model.spark, "urls")
    d = _distinct(scratch, urls.select("u", F.lit(None).cast("int").alias("y")))
    if model.windows is None:
        return d.select("u", F.lit(0.0).alias("llr"))
    new = _count(d.select("u", F.lit(0).cast("long").alias("n0"), F.lit(0).cast("long").alias("n1")))
    both = model.windows.select("w", F.lit(0).cast("long").alias("n"), "n0", "n1").union(new)
    return _mean_ratios(scratch, d, scratch.save(both.groupBy("w").agg(*[F.sum(c).alias(c) for c in ("n", "n0", "n1")]), "windows"))


def _fit(rows: DataFrame) -> tuple[Model, DataFrame]:
    """The model of all ruled urls among ``(u, y)``, y null where no rule decides, and ``(u, llr)`` of all urls."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "urls")
    d = _distinct(scratch, rows)
    seen = d.agg(F.max("m0").alias("m0"), F.max("m1").alias("m1")).first()
    if not seen["m0"] or not seen["m1"]:
        return Model(spark, None), d.select("u", F.lit(0.0).alias("llr"))
    train = lambda m: F.when(F.col("held"), F.lit(0)).otherwise(F.col(m)).cast("long")
    windows = scratch.save(_count(d.select("u", train("m0").alias("n0"), train("m1").alias("n1"))), "windows")
    model, llr = Model(spark, windows), _mean_ratios(scratch, d, windows)
    held = d.where("held and m0 + m1 > 0").select("u", "m0", "m1").join(llr.hint("merge"), "u")
    bins = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("llr") + RANGE) / (2 * RANGE) * BINS))).cast("int")
    hist = np.zeros((2, BINS + 1))
    for r in held.groupBy(bins.alias("b")).agg(F.sum("m0").alias("m0"), F.sum("m1").alias("m1")).collect():
        hist[:, r["b"]] = r["m0"], r["m1"]
    if hist.sum(axis=1).min() > 0:
        below = np.cumsum(hist, axis=1) / hist.sum(axis=1, keepdims=True)
        gain = below[0] - below[1]  # rejected below the cut, less accepted below it
        best = np.flatnonzero(gain >= gain.max() - 1e-12)
        model.threshold = float((best[len(best) // 2] + 1) / BINS * 2 * RANGE - RANGE)
    return model, llr


def learn(ruled: DataFrame, url: str = "url", verdict: str = "verdict") -> Model:
    """Counts over all ruled urls but the calibration fifth (crc32 of the url mod 5 is 0), then the threshold with
    the best balanced accuracy on that fifth, from a histogram of its ratios.

    Without urls of both classes the ratio is 0 everywhere and the threshold 0, so that everything is allowed.
    """
    return _fit(ruled.where(F.col(verdict).isNotNull()).select(F.col(url).alias("u"), (F.col(verdict) == "allow").cast("int").alias("y")))[0]


def judge(pages: DataFrame, url: str = "url", rules: list[tuple] = RULES) -> DataFrame:
    """Every row with ``host``, ``path``, ``rule``, ``verdict`` and ``llr``: the rule's verdict, else allow if the
    ratio is at or above the calibrated threshold.

    A null url has no host, path and rule and a ratio of 0. Repeated urls are judged alike. Columns of these names are
    replaced. An empty table gives an empty result.
    """
    host, path = host_and_path(url)
    base = pages.drop("host", "path", "rule", "verdict", "llr").withColumns({"host": host, "path": path})
    name, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    ruled = base.withColumns({"rule": name, "verdict": verdict})
    model, llr = _fit(ruled.select(F.col(url).alias("u"), (F.col("verdict") == "allow").cast("int").alias("y")))
    by_ratio = F.when(F.col("llr") >= F.lit(model.threshold), "allow").otherwise("block")
    out = lookup_join(ruled, llr.withColumnRenamed("u", url), [url]).withColumn("llr", F.coalesce("llr", F.lit(0.0)))
    return out.withColumn("verdict", F.coalesce("verdict", by_ratio))

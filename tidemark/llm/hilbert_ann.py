"""Approximate nearest neighbours by shifted space-filling curves.

Each of ``CURVES`` orderings projects the vectors on a few random orthogonal directions, shifts them and sorts them by
their place on a Hilbert curve; the sort is a range partitioning in Spark. A curve is cut into blocks of ``BLOCK``
neighbours in key order. A query goes to its own block and ``reach`` blocks on either side, on every curve; each block
is scored as a matrix product, ``ASKED`` queries or so in a task, and the best of all blocks are merged and reranked by
their exact inner product, first those of some blocks beside each other, then the rest, so that no list grows with all
blocks at once.

``reach`` is calibrated: a bounded sample of queries is compared with all rows, and the smallest reach with a recall
of ``TARGET`` on it is taken. Data with structure need a few blocks; uniform directions in many dimensions have none,
and then the windows grow until the target is met rather than the answers getting worse.

Exact copies of a vector are one row of the curves, with the smallest ids of the copies (as many as a result can hold),
so that thousands of copies don't fill the windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._base import Scratch, importable, shuffle_width
from tidemark.operators.ranks import numbered

CURVES = 8
DIRECTIONS, DEPTH = 6, 6
BLOCK = 1024
TARGET = 0.96
SAMPLE_QUERIES = 96
SALTS = 16
#: Queries that a task scores against a block at once
ASKED = 8192


def hilbert_key(points: np.ndarray, depth: int) -> np.ndarray:
    """Place on the Hilbert curve of points with integer coordinates below ``2 ** depth``; shape (points, axes).

    From the highest bit down, every axis whose bit is set turns the lower bits of the first axis over, and every
    other swaps them with its own; the Gray code of what results, read across the axes, is the key.
    """
    x = points.T.astype(np.int64).copy()
    n = len(x)
    for level in range(depth - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            turned = ((x[i] >> level) & 1).astype(bool)
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(depth - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> level) & 1, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for level in range(depth - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def _usable(vectors: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int]:
    """Ids and vectors that take part: finite, not zero, without nulls; shorter ones filled up with zeros, which add
    nothing to an inner product."""
    v = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.where(ok)
    d = v.agg(F.max(F.size("v"))).first()[0] or 0
    return v.select("id", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(d) - F.size("v"))).alias("v")), d


def _collapse(v: DataFrame, keep: int) -> DataFrame:
    """One row per distinct vector: ``rep`` (its number in the order of smallest ids), ``ids`` (the ``keep`` smallest),
    ``v``; in three steps, so that a vector with very many copies is never gathered in one place."""

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            keys = pdf["v"].map(lambda x: x.tobytes())
            for _, g in pdf.assign(k=keys).groupby("k", sort=False):
                yield pd.DataFrame({"ids": [np.unique(g["id"].to_numpy())[:keep]], "salt": [int(g["id"].iloc[0]) % SALTS], "v": [g["v"].iloc[0]]})

    def small(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buffer: list = []
        for f in part(frames):
            buffer.append(f)
            if len(buffer) >= 2000:
                yield pd.concat(buffer)
                buffer = []
        if buffer:
            yield pd.concat(buffer)

    lowest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids")
    parts = v.mapInPandas(small, "ids array<long>, salt int, v array<double>")
    salted = parts.groupBy("v", "salt").agg(lowest)
    one = salted.groupBy("v").agg(lowest).select(F.col("ids")[0].alias("first"), "ids", "v")
    return numbered(one, ["first", "v"], "rep").drop("first")


class _Curves:
    """Projections and shifts of all curves, and the box of the projected data."""

    def __init__(self, d: int, low: np.ndarray, high: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        k = min(DIRECTIONS, d)
        self.axes = [np.linalg.qr(rng.standard_normal((d, d)))[0][:, :k] for _ in range(CURVES)]
        self.shift = [rng.uniform(0, 1, k) for _ in range(CURVES)]
        self.low, self.high = low, high  # per curve and direction

    def keys(self, c: int, v: np.ndarray) -> np.ndarray:
        y = (v @ self.axes[c] - self.low[c]) / np.maximum(self.high[c] - self.low[c], 1e-12)
        cells = 1 << DEPTH
        return hilbert_key(np.clip((y * (cells - 2) + self.shift[c] * 2), 0, cells - 1).astype(np.int64), DEPTH)


def nearest(vectors: DataFrame, queries, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", target: float = TARGET) -> DataFrame:
    """The ``k`` nearest other rows of each query row by inner product: ``query_id, rank, vec_id, score``.

    ``queries`` is a condition on the column ``id``. Vectors that are null, zero, or hold
    a null or non-finite component take no part; nor do rows with a null id. Shorter vectors have zeros at their end. Ties
    go to the smaller id. Rows that share an id and a vector are one candidate; rows of one id with other vectors are
    candidates of each other like any. With fewer than ``k`` candidates all
    are returned; an empty table gives an empty result. Other columns are not used.
    """
    spark = vectors.sparkSession
    importable(spark)
    scratch = Scratch(spark, "hilbert")
    schema = "query_id long, rank int, vec_id long, score double"
    v, d = _usable(vectors, vec_id, vector)
    if not d:
        return spark.createDataFrame([], schema)
    width = shuffle_width(spark)
    rows = scratch.save(v, "vectors")
    reps = scratch.save(_collapse(rows, k + 1), "distinct")
    n = reps.count()
    asked = scratch.save(rows.where(queries).select(F.col("id").alias("query_id"), "v").join(reps.select("v", "rep").hint("merge"), "v").select("query_id", "rep"), "queries")
    wanted = asked.select("rep").distinct()
    marked = reps.join(wanted.withColumn("q", F.lit(True)).hint("merge"), "rep", "left").withColumn("q", F.coalesce("q", F.lit(False)))

    # the box of the projections, from a bounded sample
    sample = np.array([r["v"] for r in reps.orderBy(F.xxhash64("rep")).limit(4096).collect()])
    curves = _Curves(d, np.zeros((CURVES, 1)), np.ones((CURVES, 1)))
    proj = [sample @ a for a in curves.axes]
    spread = [p.std(axis=0) + 1e-12 for p in proj]
    curves.low = np.array([p.mean(axis=0) - 3 * s for p, s in zip(proj, spread, strict=True)])
    curves.high = np.array([p.mean(axis=0) + 3 * s for p, s in zip(proj, spread, strict=True)])
    sent = spark.sparkContext.broadcast(curves)

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            x = np.stack(pdf["v"].to_list()) if len(pdf) else np.zeros((0, d))
            for c in range(CURVES if len(pdf) else 0):
                yield pd.DataFrame({"curve": c, "key": sent.value.keys(c, x), "rep": pdf["rep"], "q": pdf["q"], "v": pdf["v"]})

    def placed_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), {}
        for pdf in frames:
            for c, g in pdf.groupby("curve"):
                first = at.get(c, 0)
                at[c] = first + len(g)
                yield pd.DataFrame({"part": part, "curve": c, "place": np.arange(first, first + len(g)), "rep": g["rep"], "q": g["q"], "v": g["v"]})

    on_curves = marked.mapInPandas(keyed, "curve int, key long, rep long, q boolean, v array<double>")
    ordered = on_curves.repartitionByRange(width, "curve", "key", "rep").sortWithinPartitions("curve", "key", "rep")
    placed = scratch.save(ordered.mapInPandas(placed_rows, "part int, curve int, place long, rep long, q boolean, v array<double>"), "curves")
    # rows of each curve in each task: at most tasks + curves numbers
    counts = placed.groupBy("curve", "part").agg(F.count("*").alias("n")).collect()
    starts, upto = [], {}
    for r in sorted(counts, key=lambda r: (r["curve"], r["part"])):
        starts.append((r["curve"], r["part"], upto.get(r["curve"], 0)))
        upto[r["curve"]] = upto.get(r["curve"], 0) + r["n"]
    first = spark.createDataFrame(starts, "curve int, part int, first long")
    rank = placed.join(F.broadcast(first), ["curve", "part"]).withColumn("at", F.col("first") + F.col("place"))
    blocks = -(-n // BLOCK)

    reach = _calibrate(scratch, reps, wanted, rank, k, blocks, target)
    # about how many queries reach a block, and so into how many parts they are dealt
    parts = max(1, -(-wanted.count() * (2 * reach + 1) // (max(1, blocks) * ASKED)))
    beside = max(1, round((2 * reach + 1) ** 0.5))
    every = F.array(*[F.lit(i) for i in range(parts)])
    cells = rank.select("curve", F.floor(F.col("at") / BLOCK).cast("long").alias("block"), "rep", "q", "v")
    near = F.sequence(F.greatest(F.lit(0), F.col("block") - reach), F.least(F.lit(blocks - 1), F.col("block") + reach))
    seekers = cells.where("q").select("curve", F.explode(near).alias("b"), F.pmod(F.xxhash64("rep"), F.lit(parts)).cast("int").alias("p"), F.col("rep").alias("r"), F.col("v").alias("w")).select(F.col("curve").alias("c"), "b", "p", "r", "w")
    dealt = cells.select("curve", "block", F.explode(every).alias("part"), "rep", "v")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"rep": pd.Series(dtype="int64"), "beside": pd.Series(dtype="int64"), "hits": pd.Series(dtype=object)})
        left = left.sort_values("rep")
        ids, x, q = left["rep"].to_numpy(), np.stack(left["v"].to_list()), np.stack(right["w"].to_list())
        out = []
        for a in range(0, len(q), 512):
            s = q[a : a + 512] @ x.T
            m = min(k + 4, s.shape[1])
            top = np.argpartition(-s, m - 1, axis=1)[:, :m]
            for i, (row, query) in enumerate(zip(top, q[a : a + 512], strict=True)):
                cut = s[i, row].min() - 1e-9  # what ties with the last stays in
                near = row if (s[i] >= cut).sum() <= m else np.flatnonzero(s[i] >= cut)
                exact = (x[near] * query).sum(axis=1)
                order = np.lexsort((ids[near], -exact))[: k + 1]
                out.append([{"s": float(-exact[j]), "id": int(ids[near[j]])} for j in order])
        return pd.DataFrame({"rep": right["r"].to_numpy(), "beside": int(left["block"].iloc[0]) // beside, "hits": out})

    found = dealt.groupBy("curve", "block", "part").cogroup(seekers.groupBy("c", "b", "p")).applyInPandas(best, "rep long, beside long, hits array<struct<s:double,id:long>>")
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))), 1, k + 1).alias("hits")
    merged = scratch.save(found.groupBy("rep", "beside").agg(least).groupBy("rep").agg(least), "found")

    # copies of the representatives found, then of the query's own
    flat = merged.select("rep", F.explode("hits").alias("h")).select("rep", F.col("h.s").alias("s"), F.col("h.id").alias("hit"))
    members = flat.join(reps.select(F.col("rep").alias("hit"), "ids").hint("merge"), "hit")
    lists = members.groupBy("rep").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("s"), i.alias("id"), F.col("hit").alias("hit")))))), 1, k + 1).alias("near"))
    answer = asked.join(scratch.save(lists, "lists").hint("merge"), "rep")
    own = F.slice(F.filter("near", lambda h: (h["id"] != F.col("query_id")) | (h["hit"] != F.col("rep"))), 1, k)
    return answer.select("query_id", F.posexplode(own).alias("p", "h")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("h.id").alias("vec_id"), F.negative(F.col("h.s")).alias("score"))


def _calibrate(scratch: Scratch, reps: DataFrame, wanted: DataFrame, rank: DataFrame, k: int, blocks: int, target: float) -> int:
    """The smallest reach with the target recall on a bounded sample of queries, each compared with all rows."""
    spark = reps.sparkSession
    sample = reps.join(wanted.orderBy(F.xxhash64("rep")).limit(SAMPLE_QUERIES).hint("broadcast"), "rep", "left_semi").select("rep", "v").collect()
    if not sample:
        return 0
    sent = spark.sparkContext.broadcast((np.array([r["rep"] for r in sample]), np.array([r["v"] for r in sample])))

    def top(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = sent.value
        for pdf in frames:
            x, cand = np.stack(pdf["v"].to_list()), pdf["rep"].to_numpy()
            s = q @ x.T
            s[ids[:, None] == cand[None, :]] = -np.inf
            m = min(k, s.shape[1])
            near = np.argpartition(-s, m - 1, axis=1)[:, :m]
            yield pd.DataFrame({"rep": ids, "hits": [[{"s": float(-s[i, j]), "id": int(cand[j])} for j in row if s[i, j] > -np.inf] for i, row in enumerate(near)]})

    hits = reps.select("rep", "v").mapInPandas(top, "rep long, hits array<struct<s:double,id:long>>").groupBy("rep").agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k).alias("hits")).collect()
    truth = {r["rep"]: [h["id"] for h in r["hits"]] for r in hits}
    needed = spark.createDataFrame([(int(i),) for i in {*truth, *(x for t in truth.values() for x in t)}], "rep long")
    at: dict = {}
    for r in rank.join(F.broadcast(needed), "rep", "left_semi").select("curve", "rep", F.floor(F.col("at") / BLOCK).alias("b")).collect():
        at.setdefault(r["rep"], {})[r["curve"]] = r["b"]
    apart = [min(abs(at[x][c] - at[q][c]) for c in at[q]) for q, t in truth.items() for x in t]
    return int(np.quantile(apart, target, method="higher")) if apart else 0

"""Operators on series: rows of a key in the order of an index.

Every function takes column names. ``key`` partitions and ``idx`` (0, 1, 2, ...) orders; all windows are partitioned by
the key, so one shuffle on the key serves a chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def over(key: str = "k", idx: str = "i"):
    return Window.partitionBy(key).orderBy(idx)


def whole(key: str = "k"):
    return Window.partitionBy(key)


def number_rows(df: DataFrame, key: str, *order: str, name: str = "i") -> DataFrame:
    """Add the 0-based place of each row of a series."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))


def window_edges(lengths: DataFrame, size: int, stride: int, keep_short: bool = False) -> DataFrame:
    """Left edges of the windows of each series ``(k, n)``. A series shorter than ``size`` has none, or with
    ``keep_short`` one whole window, flagged partial."""
    full = lengths.where(F.col("n") >= size).select("k", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - size, F.lit(stride).cast("long"))).alias("win", "start"))
    out = full.select("k", "win", "start", F.lit(size).cast("long").alias("len"), F.lit(False).alias("partial"))
    if keep_short:
        short = lengths.where((F.col("n") < size) & (F.col("n") > 0)).select("k", F.lit(0).alias("win"), F.lit(0).cast("long").alias("start"), F.col("n").alias("len"), F.lit(True).alias("partial"))
        out = out.unionByName(short)
    return out


def resample(df: DataFrame, src_fps: float, dst_fps: float, max_frames: int | None = None) -> DataFrame:
    """Nearest-neighbour resampling of ``(k, i, ...)`` to another rate; ``j`` is the new index."""
    n = df.groupBy("k").agg(F.count("*").alias("n"))
    count = F.greatest(F.lit(1.0), F.rint(F.col("n") / F.lit(float(src_fps)) * F.lit(float(dst_fps))))
    if max_frames is not None:
        count = F.least(count, F.lit(float(max_frames)))
    grid = n.select("k", "n", F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)).alias("j"))
    source = F.least(F.rint(F.col("j") / F.lit(float(dst_fps)) * F.lit(float(src_fps))).cast("long"), F.col("n") - 1)
    return grid.select("k", "j", source.alias("i")).join(df.hint("merge"), ["k", "i"])


def interpolate(df: DataFrame, value: str, max_gap: int | None, key: str = "k", idx: str = "i") -> DataFrame:
    """Fill nulls between known rows linearly where at most ``max_gap`` rows are missing in a row; longer gaps and the
    ends stay null. Adds ``filled`` and ``valid``."""
    w = over(key, idx)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.col(idx))
    i0, i1 = F.last(known, True).over(before), F.first(known, True).over(after)
    v0, v1 = F.last(value, True).over(before), F.first(value, True).over(after)
    x = df.withColumns({"_i0": i0, "_i1": i1, "_v0": v0, "_v1": v1})
    ok = F.col("_i0").isNotNull() & F.col("_i1").isNotNull()
    if max_gap is not None:
        ok = ok & (F.col("_i1") - F.col("_i0") - 1 <= max_gap)
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col(idx) - F.col("_i0")) / (F.col("_i1") - F.col("_i0"))
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(ok, line)
    return x.withColumn("filled", filled).withColumn("valid", F.col("filled").isNotNull()).drop("_i0", "_i1", "_v0", "_v1")


def carry_forward(value: str, key: str = "k", idx: str = "i") -> Column:
    """Last known value at or before the row."""
    return F.last(value, True).over(over(key, idx).rowsBetween(Window.unboundedPreceding, 0))


def moving_average(value: Column | str, k: int, key: str = "k", idx: str = "i") -> Column:
    """Centred mean of ``k`` rows with the end values held outside the series.

    A frame of a window shrinks at the ends; what is missing there counts as copies of the first or last value.
    """
    v = F.col(value) if isinstance(value, str) else value
    if k <= 1:
        return v
    lo, hi = k // 2, k - 1 - k // 2
    w, p = over(key, idx), whole(key)
    n = F.count(F.lit(1)).over(p)
    first = F.first(v).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = F.last(v).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    inside = F.sum(v).over(w.rowsBetween(-lo, hi))
    under = F.greatest(F.lit(0), F.lit(lo) - F.col(idx))
    beyond = F.greatest(F.lit(0), F.col(idx) + hi - (n - 1))
    return (inside + first * under + last * beyond) / k


def rolling_std(value: str, half: int, key: str = "k", idx: str = "i") -> Column:
    """Population deviation over ``half`` rows on both sides, fewer at the ends."""
    return F.stddev_pop(value).over(over(key, idx).rowsBetween(-half, half))


def held_frame(value: str, half: int, key: str = "k", idx: str = "i") -> Column:
    """Array of the ``2 half + 1`` values around a row, ends held."""
    w = over(key, idx)
    got = F.collect_list(value).over(w.rowsBetween(-half, half))
    n = F.count(F.lit(1)).over(whole(key))
    under = F.greatest(F.lit(0), F.lit(half) - F.col(idx)).cast("int")
    beyond = F.greatest(F.lit(0), F.col(idx) + half - (n - 1)).cast("int")
    return F.concat(F.array_repeat(F.element_at(got, 1), under), got, F.array_repeat(F.element_at(got, -1), beyond))


def median_of(values: Column) -> Column:
    """Median of an array of odd length."""
    return F.element_at(F.array_sort(values), ((F.size(values) + 1) / 2).cast("int"))


def weighted(values: Column, weights: list[float]) -> Column:
    """Sum of products of an array and fixed weights."""
    return F.aggregate(F.zip_with(values, F.array(*[F.lit(w) for w in weights]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def band_energy(df: DataFrame, value: str, fast: int, slow: int, window: int) -> DataFrame:
    """Rolling root mean square of a fast mean less a slow one: what goes back and forth. Adds ``energy``."""
    x = df.withColumn("_band", moving_average(value, fast) - moving_average(value, slow))
    x = x.withColumn("_sq", F.col("_band") * F.col("_band"))
    return x.withColumn("energy", F.sqrt(F.greatest(F.lit(0.0), moving_average("_sq", window)))).drop("_band", "_sq")


def fold_long(df: DataFrame, make, values: str | list[str] = "v", out: str = "y double", key: str = "k", idx: str = "i") -> DataFrame:
    """A recursive filter: ``make(*arrays) -> array or arrays`` on the values of one series in order, as ``out``.

    It runs on numpy arrays in Arrow batches, one series at a time; a series must fit a task, and time is linear in its
    length. See ``filters`` for what to put in.
    """
    names = [values] if isinstance(values, str) else values
    columns = [c.split()[0] for c in out.split(",")]

    def run(pdf):
        pdf = pdf.sort_values(idx)
        made = make(*[pdf[c].to_numpy() for c in names])
        return pdf[[key, idx]].assign(**dict(zip(columns, made if isinstance(made, tuple) else (made,), strict=True)))

    kind = dict(df.dtypes)
    return df.select(key, idx, *names).groupBy(key).applyInPandas(run, f"{key} {kind[key]}, {idx} {kind[idx]}, {out}")


def runs(df: DataFrame, on: str, key: str = "k", idx: str = "i") -> DataFrame:
    """Maximal runs of rows where ``on`` holds: ``k, lo, hi`` (half open), ``len``; gaps and islands."""
    marked = df.withColumn("_g", F.col(idx) - F.row_number().over(Window.partitionBy(key, on).orderBy(idx))).where(F.col(on))
    return marked.groupBy(key, "_g").agg(F.min(idx).alias("lo"), (F.max(idx) + 1).alias("hi"), F.count("*").alias("len")).drop("_g")


def robust_fire(value: str, k: float, floor: float, key: str = "k") -> tuple[Column, Column]:
    """Median of the series, and its scaled median absolute deviation, which needs the median as column ``_med``."""
    return F.median(value).over(whole(key)), F.greatest(F.median(F.abs(F.col(value) - F.col("_med"))).over(whole(key)) * F.lit(1.4826), F.lit(floor))


def range_evidence(value: str, key: str = "k") -> Column:
    """Excursion above the series' median as a share of its own p95 - p50; 0 where that range is not positive."""
    med, top = F.median(value).over(whole(key)), F.percentile(value, F.lit(0.95)).over(whole(key))
    return F.when(top - med > 0, F.greatest(F.lit(0.0), (F.col(value) - med) / (top - med))).otherwise(F.lit(0.0))

"""The ten features of a series of two coordinates, over whole series or over windows as series of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import series as S

#: The names and their order
FEATURES = ["speed", "peak_speed", "amplitude", "volume", "repetition", "pause_fraction", "pause_mean", "jerk", "sign_count", "active_fraction"]


def ten_features(df: DataFrame, rate: float = 24.0, slow: float = 200.0, least: int = 6, most: int = 40, above: float = 0.15) -> DataFrame:
    """``k``, ``FEATURES``, ``n_frames`` and ``seconds`` of every series ``(k, i, v, p)``.

    ``speed`` and ``peak_speed`` of steps (the first is 0); ``amplitude``, the diagonal, and ``volume``, the area of the box that
    holds the series; ``repetition``, the peaks above ``above`` of the speed's autocorrelation between two lags;
    ``pause_fraction`` of rows at most ``slow`` fast and ``pause_mean``, the mean seconds of their runs (0: none);
    ``jerk``, the mean third difference by time (0: fewer than four rows); ``sign_count``, the runs of faster rows, and
    ``active_fraction``, their share. One shuffle by series: lags and leads are columns of one window, and a series is a row
    after one aggregation.
    """
    w = S.over()
    step = F.sqrt(F.pow(F.col("v") - F.lag("v").over(w), F.lit(2)) + F.pow(F.col("p") - F.lag("p").over(w), F.lit(2)))
    third = lambda c: F.col(c) - 3 * F.lag(c, 1).over(w) + 3 * F.lag(c, 2).over(w) - F.lag(c, 3).over(w)
    d = df.select("k", "i", "v", "p", (F.coalesce(step, F.lit(0.0)) * rate).alias("sp"), F.hypot(third("v"), third("p")).alias("j"))
    d = d.withColumns({"on_": F.col("sp") > slow, "x": F.col("sp") - F.avg("sp").over(S.whole())})
    lags = range(least, most + 1)
    d = d.withColumns({"was": F.lag("on_").over(w), **{f"x{n}": F.lead("x", n).over(w) for n in lags}})
    begins = lambda c: F.count_if(c & (F.col("was").isNull() | (F.col("was") != F.col("on_"))))
    g = d.groupBy("k").agg(
        F.avg("sp").alias("speed"), F.max("sp").alias("peak_speed"), (F.max("v") - F.min("v")).alias("dv"), (F.max("p") - F.min("p")).alias("dp"),
        F.avg((~F.col("on_")).cast("double")).alias("pause_fraction"), F.count_if(~F.col("on_")).alias("still"), begins(~F.col("on_")).alias("pauses"), begins(F.col("on_")).alias("sign_count"),
        F.coalesce(F.avg("j"), F.lit(0.0)).alias("j"), F.count("*").alias("n_frames"), F.sum(F.col("x") * F.col("x")).alias("q"), *[F.sum(F.col("x") * F.col(f"x{n}")).alias(f"s{n}") for n in lags],
    )
    at = lambda n: F.when(F.col("q") > 1e-12, F.col(f"s{n}") / F.col("q")) if n in lags else F.lit(None).cast("double")
    peak = lambda n: F.coalesce(((at(n) > above) & (at(n) >= at(n - 1)) & (at(n) > at(n + 1))).cast("int"), F.lit(0))
    out = {
        "speed": F.col("speed"), "peak_speed": F.col("peak_speed"), "amplitude": F.hypot("dv", "dp"), "volume": F.col("dv") * F.col("dp"), "repetition": sum((peak(n) for n in lags), F.lit(0)).cast("long"),
        "pause_fraction": F.col("pause_fraction"), "pause_mean": F.coalesce(F.col("still") / F.nullif(F.col("pauses"), F.lit(0)) / rate, F.lit(0.0)), "jerk": F.col("j") * rate**3,
        "sign_count": F.col("sign_count"), "active_fraction": 1 - F.col("pause_fraction"),
    }
    return g.select("k", *[c.alias(n) for n, c in out.items()], "n_frames", (F.col("n_frames") / rate).alias("seconds"))

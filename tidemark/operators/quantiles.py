"""Exact quantiles of groups of any size: the interval that holds a rank is narrowed by counts, pass by pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import sized
from tidemark.operators.ranks import written

#: Bins of an interval, and rows of an interval that are ranked one by one
BINS = 1024
FEW = 20_000


def _same(by: list[str], a: str, b: str) -> Column:
    on = F.lit(True)
    for c in by:
        on = on & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return on


def exact_quantiles(rows: DataFrame, by: list[str], value: Column, shares: list[float], name: str = "q", bins: int = BINS, few: int = FEW) -> DataFrame:
    """``by`` and ``name``, an array with the quantile of ``value`` at each share, between neighbours in proportion.

    A quantile needs one or two ranks. All ranks begin with the whole range of their group; a pass counts the rows of
    each open interval in ``bins`` equal parts, with partial counts in every task, and goes on with the part that holds
    the rank, from its least to its greatest value. When an interval has at most ``few`` rows, or one value, its rows are
    counted by value and the rank is read off. So a task never holds more than ``few`` rows of an interval, however
    large the group, and nothing but counts and those rows is shuffled. Nulls, NaN and infinite values are left out;
    a group without any other value has a null.
    """
    x = written(rows.select(*by, value.cast("double").alias("_x")))
    good = x.where("_x > double('-infinity') and _x < double('infinity')")
    groups = good.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    places = F.transform(F.array(*[F.lit(float(s)) for s in shares]), lambda s: s * (F.col("_n") - 1))
    groups = written(groups.withColumn("_p", places))
    ranks = F.array_distinct(F.flatten(F.transform("_p", lambda p: F.array(F.floor(p), F.ceil(p)))))
    open_ = written(groups.select(*by, F.explode(ranks).alias("_rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_before"), F.col("_n").alias("_in")))
    done = []
    while True:
        small = (F.col("_in") <= few) | (F.col("_lo") == F.col("_hi"))
        done.append(open_.where(small))
        wide = open_.where(~small)
        if wide.isEmpty():
            break
        open_ = written(_narrowed(good, wide, by, bins))
    closed = done[0]
    for d in done[1:]:
        closed = closed.union(d)
    closed = written(closed)
    found = closed.where("_lo = _hi").select(*by, "_rank", F.col("_lo").alias("_v")).union(_read_off(good, closed.where("_lo < _hi"), by))
    values = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_m"))  # two ranks a share at most
    at = lambda p: F.element_at("_m", p)
    between = F.transform("_p", lambda p: F.when(F.ceil(p) == F.floor(p), at(F.floor(p))).otherwise((F.ceil(p) - p) * at(F.floor(p)) + (p - F.floor(p)) * at(F.ceil(p))))
    have = groups.alias("g").join(values.alias("v").hint("merge"), _same(by, "g", "v")).select(*[F.col(f"g.{c}").alias(c) for c in by], between.alias(name))
    if not by:
        return have
    every = x.select(*by).distinct()
    return every.alias("e").join(have.alias("h").hint("merge"), _same(by, "e", "h"), "left").select(*[F.col(f"e.{c}").alias(c) for c in by], f"h.{name}")


def _within(good: DataFrame, intervals: DataFrame, by: list[str]) -> DataFrame:
    """Rows with each interval of their group that holds them."""
    on = _same(by, "r", "i") & (F.col("r._x") >= F.col("i._lo")) & (F.col("r._x") <= F.col("i._hi"))
    return good.alias("r").join(sized(intervals).alias("i"), on).select(*[F.col(f"r.{c}").alias(c) for c in by], "r._x", "i._lo", "i._hi")


def _narrowed(good: DataFrame, wide: DataFrame, by: list[str], bins: int) -> DataFrame:
    """``wide`` with the interval, the rows before it and the rows in it of the part that holds each rank."""
    inside = _within(good, wide.select(*by, "_lo", "_hi").distinct(), by)
    part = F.least(F.lit(bins - 1), F.floor((F.col("_x") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * bins))
    counts = inside.groupBy(*by, "_lo", "_hi", part.alias("_b")).agg(F.count("*").alias("_c"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
    upto = Window.partitionBy(*by, "_lo", "_hi").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # ``bins`` rows
    counts = counts.withColumn("_below", F.coalesce(F.sum("_c").over(upto), F.lit(0)))
    left = F.col("w._rank") - F.col("w._before")
    on = _same(by, "w", "c") & (F.col("w._lo") == F.col("c._lo")) & (F.col("w._hi") == F.col("c._hi")) & (left >= F.col("c._below")) & (left < F.col("c._below") + F.col("c._c"))
    j = wide.alias("w").join(counts.alias("c").hint("merge"), on)
    return j.select(*[F.col(f"w.{c}").alias(c) for c in by], "w._rank", F.col("c._least").alias("_lo"), F.col("c._most").alias("_hi"), (F.col("w._before") + F.col("c._below")).alias("_before"), F.col("c._c").alias("_in"))


def _read_off(good: DataFrame, closed: DataFrame, by: list[str]) -> DataFrame:
    """``by, _rank, _v`` for ranks whose interval has few rows."""
    inside = _within(good, closed.select(*by, "_lo", "_hi").distinct(), by)
    counts = inside.groupBy(*by, "_lo", "_hi", "_x").agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*by, "_lo", "_hi").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_below", F.coalesce(F.sum("_c").over(upto), F.lit(0)))
    left = F.col("w._rank") - F.col("w._before")
    on = _same(by, "w", "c") & (F.col("w._lo") == F.col("c._lo")) & (F.col("w._hi") == F.col("c._hi")) & (left >= F.col("c._below")) & (left < F.col("c._below") + F.col("c._c"))
    return closed.alias("w").join(counts.alias("c").hint("merge"), on).select(*[F.col(f"w.{c}").alias(c) for c in by], "w._rank", F.col("c._x").alias("_v"))

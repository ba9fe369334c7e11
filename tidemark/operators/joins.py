"""Joins that audit themselves, range joins, nearest and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def audit_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: keys matched, only left, only right, and the matched share of the left ones. One shuffle: both sides'
    keys are counted together."""
    both = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).union(right.select(key, F.lit(0), F.lit(1)))
    k = both.groupBy(key).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return k.agg(F.count_if((F.col("l") > 0) & (F.col("r") > 0)).alias("matched"), F.count_if(F.col("r") == 0).alias("left_only"), F.count_if(F.col("l") == 0).alias("right_only"), F.round(F.count_if((F.col("l") > 0) & (F.col("r") > 0)) / F.count_if(F.col("l") > 0), 6).alias("share"))


def interval_rows(rows: DataFrame, spans: DataFrame, bucket: int, key: str = "k", idx: str = "i", lo: str = "lo", hi: str = "hi", select: Column | None = None) -> DataFrame:
    """Rows of a series with each span ``[lo, hi]`` of their key that holds them; of the spans, those that ``select``
    (a condition on their columns) takes.

    Spans are repeated once per bucket of ``bucket`` rows that they touch, so the join is an equi-join on key and
    bucket and a long series is spread over tasks; the range is a residual condition.
    """
    s = (spans if select is None else spans.where(select)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket))))
    r = rows.withColumn("_b", F.floor(F.col(idx) / bucket))
    on = (F.col(f"r.{key}") == F.col(f"s.{key}")) & (F.col("r._b") == F.col("s._b")) & F.col(f"r.{idx}").between(F.col(f"s.{lo}"), F.col(f"s.{hi}"))
    extra = [c for c in spans.columns if c != key]
    return r.alias("r").join(s.alias("s").hint("merge"), on).select("r.*", *[F.col(f"s.{c}") for c in extra]).drop("_b")


def nearest_match(cases: DataFrame, controls: DataFrame, group: str, covariates: list[str], caliper: float, order: str, scales: dict[str, float] | None = None) -> DataFrame:
    """For each case the nearest control of its group on z-scaled covariates within the caliper, with replacement;
    first on ties. Scales are pooled over both sides if not given. Cases and controls have ``group``, ``order`` and the covariates.

    Under a caliper two partners are at most one cell of the first covariate apart, so controls are repeated to three
    cells and joined by group and cell: exact, and not quadratic in a group.
    """
    both = cases.select(*covariates).union(controls.select(*covariates))
    sds = both.agg(*[(F.lit(scales[c]) if scales else F.stddev_pop(c)).alias(f"_sd_{c}") for c in covariates])
    z = lambda d: d.crossJoin(F.broadcast(sds)).withColumns({f"_z_{c}": F.col(c) / F.nullif(F.col(f"_sd_{c}"), F.lit(0.0)) for c in covariates}).withColumn("_cell", F.floor(F.coalesce(F.col(f"_z_{covariates[0]}"), F.lit(0.0)) / caliper))
    a = z(cases).alias("a")
    b = z(controls).withColumn("_cell", F.explode(F.array(F.col("_cell") - 1, F.col("_cell"), F.col("_cell") + 1))).alias("b")
    d2 = sum((F.pow(F.coalesce(F.col(f"a._z_{c}") - F.col(f"b._z_{c}"), F.lit(0.0)), F.lit(2)) for c in covariates), F.lit(0.0))
    j = a.join(b.hint("merge"), (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a._cell") == F.col("b._cell")) & (d2 <= caliper * caliper))
    return j.groupBy(F.col(f"a.{group}").alias(group), F.col(f"a.{order}").alias("case")).agg(F.min_by(F.col(f"b.{order}"), F.struct(F.round(d2, 12), F.col(f"b.{order}"))).alias("control"), F.sqrt(F.min(d2)).alias("dist"))


def as_of(rows: DataFrame, states: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each row with the latest state of its key at or before it: both sides in one ordered window, no range join."""
    u = rows.withColumns({"_s": F.lit(1), "_v": F.lit(None).cast(dict(states.dtypes)[value])}).unionByName(states.select(key, at, F.col(value).alias("_v"), F.lit(0).alias("_s")), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_s").rowsBetween(Window.unboundedPreceding, 0)
    return u.withColumn(value, F.last("_v", True).over(w)).where("_s = 1").drop("_s", "_v")


def within_relative(left: DataFrame, right: DataFrame, x: str, y: str, tol: float, out: Column) -> DataFrame:
    """Left rows with whether some right value lies within a relative tolerance of it.

    Values fall in logarithmic cells one tolerance wide; both sides are made distinct and the right ones repeated to the cells
    beside theirs, so this is an equi-join with a residual condition in which a number that many rows have is one row.
    """
    step = 2 * tol
    cell = lambda c: F.floor(F.log(F.col(c)) / step).cast("long")
    r = right.where(F.col(y) > 0).select(F.col(y).alias("_y")).distinct()
    r = r.withColumn("_c", F.explode(F.sequence(cell("_y") - 1, cell("_y") + 1)))
    numbers = left.where(F.col(x) > 0).select(F.col(x).alias("_x")).distinct().withColumn("_c", cell("_x"))
    near = (F.col("l._c") == F.col("r._c")) & (F.abs(F.col("_y") - F.col("_x")) <= F.lit(tol) * F.col("_x"))
    hit = numbers.alias("l").join(r.alias("r").hint("merge"), near, "left_semi").select("_x", F.lit(True).alias("_hit"))
    return left.join(hit.hint("merge"), F.col(x) == F.col("_x"), "left").withColumn("matched", F.coalesce("_hit", F.lit(False))).drop("_hit", "_x")


#: Rows up to which a table of keys and numbers is broadcast
SMALL_ROWS = 300_000


def sized(table: DataFrame) -> DataFrame:
    """``table`` marked for a broadcast if it is counted to be small, else for a merge join, whose hot keys adaptive
    execution splits. It should be written, as it is read twice."""
    return F.broadcast(table) if table.count() <= SMALL_ROWS else table.hint("merge")

"""Folds for leave-one-group-out evaluation, and statistics taken from training rows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def leave_one_group_out(rows: DataFrame, row: str, group: str) -> DataFrame:
    """``fold, row, role`` for every group held out once; the group after it in order validates, the others train.

    The list of groups is made distinct first; each row is repeated once per fold, so keep folds few.
    """
    groups = rows.select(F.col(group).alias("g")).distinct()
    ordered = groups.agg(F.array_sort(F.collect_list("g")).alias("gs"))  # one row: the groups
    d = rows.select(row, F.col(group).alias("g")).crossJoin(F.broadcast(ordered))
    d = d.select(row, "g", "gs", F.posexplode("gs").alias("p", "fold"))
    nxt = F.col("gs")[(F.col("p") + 1) % F.size("gs")]
    return d.select("fold", row, F.when(F.col("g") == F.col("fold"), "test").when(F.col("g") == nxt, "val").otherwise("train").alias("role"))


def fold_summary(rows: DataFrame, row: str, group: str) -> DataFrame:
    """A row per fold: its validating group, the rows that test, validate and train, whether it had to fall back on
    training without a group of its own (fewer than three groups), and whether no row has two roles."""
    roles = leave_one_group_out(rows, row, group).join(rows.select(row, F.col(group).alias("_g")).hint("merge"), row)
    n = lambda r: F.count_if(F.col("role") == r)
    per_row = roles.groupBy("fold", row).agg(F.count_distinct("role").alias("roles")).groupBy("fold").agg((F.max("roles") == 1).alias("disjoint"))
    s = roles.groupBy("fold").agg(F.max(F.when(F.col("role") == "val", F.col("_g"))).alias("val_group"), n("test").alias("test"), n("val").alias("validation"), n("train").alias("train"))
    groups = rows.select(group).distinct().agg(F.count("*").alias("_n"))
    return s.join(per_row.hint("merge"), "fold").crossJoin(F.broadcast(groups)).select("fold", "val_group", "test", "validation", "train", (F.col("_n") < 3).alias("fallback"), "disjoint")


def kfold(key: Column, k: int, seed: str = "k") -> Column:
    """Fold number of a key by seeded hash."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key.cast("string"))), 1, 8), 16, 10).cast("long") % k).cast("int")


def standardise(rows: DataFrame, fold: Column, values: list[str], folds: int) -> DataFrame:
    """Each row once per fold, scaled by mean and deviation of that fold's training rows; ``held`` marks the test rows."""
    d = rows.withColumn("_f", fold)
    f = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("held", F.col("_f") == F.col("fold"))
    stats = f.where("not held").groupBy("fold").agg(*[x for v in values for x in (F.avg(v).alias(f"_m_{v}"), F.stddev_pop(v).alias(f"_s_{v}"))])
    j = f.join(F.broadcast(stats), "fold")  # one row per fold
    return j.withColumns({v: (F.col(v) - F.col(f"_m_{v}")) / F.nullif(F.col(f"_s_{v}"), F.lit(0.0)) for v in values}).drop("_f", *[f"_{p}_{v}" for v in values for p in "ms"])


def standardise_vectors(rows: DataFrame, fold: Column, x: str, folds: int) -> DataFrame:
    """``standardise`` for all dimensions of a vector: one aggregation per fold and dimension, whose few rows (folds
    times dimensions, as arrays one row per fold) are broadcast."""
    d = rows.withColumn("_f", fold)
    f = d.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("held", F.col("_f") == F.col("fold"))
    flat = f.where("not held").select("fold", F.posexplode(x).alias("_j", "_e"))
    stats = flat.groupBy("fold", "_j").agg(F.avg("_e").alias("_m"), F.stddev_pop("_e").alias("_s"))
    lists = stats.groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("_j", "_m", "_s"))).alias("_st"))
    j = f.join(F.broadcast(lists), "fold")  # one row per fold
    return j.withColumn(x, F.zip_with(x, "_st", lambda e, s: (e - s["_m"]) / F.nullif(s["_s"], F.lit(0.0)))).drop("_f", "_st")

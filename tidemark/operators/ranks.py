"""Running sums and ranks over orders that no single task can hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.streaming.run import work_folder


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from a table in the shared folder, which is removed when the interpreter ends."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_sums(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Add for each ``name: value`` the sum of the values of all rows before this one in its group.

    Rows are range-partitioned by group and order and written, so a hot group lies in many parts; each part is summed
    for itself and what lies before it is added. Only a row for each group and part goes through one window. ``order``
    should make rows distinct within a group, else rows that are equal in it come in any order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, *order]
    parts = written(df.withColumns({f"_v{i}": v for i, v in enumerate(sums.values())}).repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))
    total = parts.groupBy(*by, "_part").agg(*[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(sums))])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = total.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("_p"), *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))])
    here = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = parts.withColumns({f"_r{i}": F.coalesce(F.sum(f"_v{i}").over(here), F.lit(0)) for i in range(len(sums))})
    on = F.col("_part") == F.col("_p")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = own.join(first.hint("merge"), on)
    return joined.withColumns({name: F.col(f"_r{i}") + F.col(f"_b{i}") for i, name in enumerate(sums)}).select(*df.columns, *sums)


def numbered(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Add the place from 0 of each row in an order, which should be without ties."""
    return running_sums(df, [], order, {name: F.lit(1).cast("long")})


def mean_ranks(df: DataFrame, by: list[str], value: str, weight: str, name: str) -> DataFrame:
    """``by, value, name``: the rank from 1 of each distinct value of a group, ties averaged; a row of ``df`` counts
    ``weight`` times."""
    g = df.groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    r = running_sums(g, by, [value], {"_below": F.col("_w")})
    return r.select(*by, value, (F.col("_below") + (F.col("_w") + 1) / 2).alias(name))

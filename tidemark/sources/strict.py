"""Strict reading: what the lenient sources count, these refuse, in the pass that carries the data."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.streaming.run import work_folder


def required(rows: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """``rows``; the first that breaks a rule fails the job, with the rule's name and the row's ``key`` in the message.

    The check is part of the key's column, so it is made where a row is read and needs no second pass; a plan that does
    not use the key checks nothing.
    """
    own = value = F.col(f"`{key}`")
    for name, good in reversed(rules.items()):
        says = F.concat(F.lit(f"{name}: {key} = "), F.coalesce(own.cast("string"), F.lit("null")))
        value = F.when(F.coalesce(good, F.lit(False)), value).otherwise(F.raise_error(says).cast(rows.schema[key].dataType))
    return rows.withColumn(key, value)


def parted(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rows`` with ``reason``, the first rule that a row breaks, or NULL: the lenient reading of the same rules."""
    reason = F.lit(None).cast("string")
    for name, good in reversed(rules.items()):
        reason = F.when(~F.coalesce(good, F.lit(False)), name).otherwise(reason)
    return rows.withColumn("reason", reason)


class Refused(ValueError):
    """A table that was read whole and does not keep what it must."""


def checked(rows: DataFrame, measures: dict[str, Column], judge: Callable[[dict], str | None]) -> DataFrame:
    """``rows`` from a written table, if ``judge(measures)`` has nothing against them, else ``Refused`` with what it says.

    The measures are observed while the rows are written, so a floor for a whole table costs no second scan. What was
    refused is removed.
    """
    spark, seen = rows.sparkSession, Observation(f"checked-{uuid.uuid4().hex}")
    folder = work_folder(spark)
    rows.observe(seen, *[c.alias(n) for n, c in measures.items()]).write.parquet(folder)
    if says := judge(seen.get):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        raise Refused(says)
    return spark.read.schema(rows.schema).parquet(folder)


def joined_above(left: DataFrame, right: DataFrame, key: str, floor: float) -> DataFrame:
    """Rows of ``left`` with their row of ``right``, which has one for a key, if at least ``floor`` of them have one."""
    met = right.withColumn("_met", F.lit(True))
    j = left.join(met.hint("merge"), key, "left")
    measures = {"rows": F.count(F.lit(1)), "met": F.count("_met"), "first": F.min(F.when(F.col("_met").isNull(), F.col(key).cast("string")))}

    def judge(m: dict) -> str | None:
        share = m["met"] / m["rows"] if m["rows"] else 1.0
        return None if share >= floor else f"{m['met']} of {m['rows']} rows matched on {key}, under {floor}; without a match: {m['first']}"

    return checked(j, measures, judge).where("_met").drop("_met")

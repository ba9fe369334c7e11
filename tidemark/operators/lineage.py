"""Chains of artifacts that replace one another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import written


def ends_of_chains(artifacts: DataFrame, name: str = "name", successor: str = "superseded_by") -> DataFrame:
    """``name, last, hops, fault``: where the chain of successors of each artifact ends, after how many steps.

    ``fault`` is ``dangling`` if the chain names an artifact that there is none of (``last`` is that name), ``cycle`` if
    it never ends (``last`` is NULL), else NULL. An artifact without a successor is its own end. Each name has one row.
    Every round looks up the successor of what was reached before, so the steps double and a chain of n artifacts takes
    log n joins; what has not ended when the steps exceed the number of artifacts goes round.
    """
    a = written(artifacts.select(F.col(name).alias("name"), F.col(successor).alias("to")))
    n = a.count()
    known = a.select(F.col("name").alias("at"), F.lit(True).alias("there"))
    # one step: to the successor if there is one, and whether the way ends there
    j = a.join(known.hint("merge"), F.col("to") == F.col("at"), "left")
    now = written(j.select("name", F.coalesce("to", "name").alias("last"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("hops"), F.col("to").isNull().alias("ended"), (F.col("to").isNotNull() & F.col("there").isNull()).alias("dangling")))
    steps = 1
    while steps <= n and not now.where("not ended and not dangling").isEmpty():
        far = now.select(F.col("name").alias("at"), F.col("last").alias("_last"), F.col("hops").alias("_hops"), F.col("ended").alias("_ended"), F.col("dangling").alias("_dangling"))
        moving = now.where("not ended and not dangling").join(far.hint("merge"), F.col("last") == F.col("at"))
        moved = moving.select("name", F.col("_last").alias("last"), (F.col("hops") + F.col("_hops")).alias("hops"), F.col("_ended").alias("ended"), F.col("_dangling").alias("dangling"))
        now = written(now.where("ended or dangling").union(moved))
        steps *= 2
    fault = F.when(F.col("dangling"), "dangling").when(~F.col("ended"), "cycle")
    ended = F.col("ended") | F.col("dangling")
    return now.select(F.col("name").alias(name), F.when(ended, F.col("last")).alias("last"), F.when(ended, F.col("hops")).alias("hops"), fault.alias("fault"))

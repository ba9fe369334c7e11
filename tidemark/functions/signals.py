"""Named signals of a series: what a detector can be chosen from.

A signal takes the rows ``(k, i, v, p)`` of all series and gives ``(k, i, score)``; a family is a set of signals that
answer one question. Names are checked when a signal is asked for, before anything runs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import filters as X
from tidemark.operators import series as S

Signal = Callable[[DataFrame], DataFrame]
FAMILIES: dict[str, dict[str, Signal]] = {}


def signal(family: str, name: str) -> Callable[[Signal], Signal]:
    """Register a signal under a name of its family; a name is given once."""

    def put(f: Signal) -> Signal:
        if name in FAMILIES.setdefault(family, {}):
            raise KeyError(f"{family} has a signal {name!r} already")
        FAMILIES[family][name] = f
        return f

    return put


def scores(df: DataFrame, family: str, names: list[str] | None = None) -> DataFrame:
    """``name, k, i, score`` of the signals of a family, or of some of them."""
    if family not in FAMILIES or (bad := set(names or []) - set(FAMILIES[family])):
        raise KeyError(f"no such signals: {family} {sorted(bad) if family in FAMILIES else ''}")
    out = None
    for name in names or sorted(FAMILIES[family]):
        part = FAMILIES[family][name](df).select(F.lit(name).alias("name"), "k", "i", "score")
        out = part if out is None else out.union(part)
    return out


def of_column(c) -> Signal:
    """A signal that is an expression of the row and its window."""
    return lambda df: df.select("k", "i", c().alias("score"))


signal("level", "value")(of_column(lambda: F.col("v")))
signal("level", "smoothed")(of_column(lambda: S.moving_average("v", 3)))
signal("level", "less the other axis")(of_column(lambda: F.col("v") - F.col("p")))
signal("movement", "rolling deviation")(of_column(lambda: S.rolling_std("v", 5)))
for _least in (15.0, 25.0, 40.0):
    signal("movement", f"turns of {_least:g}")(lambda df, least=_least: S.fold_long(df, lambda v: np.minimum(X.recent(X.turns(v, least, 0.0, float(v[0]))[0], np.arange(len(v)), 24, np.zeros(0))[0] / 3.0, 1.2)).withColumnRenamed("y", "score"))

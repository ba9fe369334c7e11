"""Stateful operators of live series on typed state: values, lists that only grow by what is new, and timers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidemark.streaming.run import Sink

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def typed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started in here keep their state in the store that typed state needs."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class Series(StatefulProcessor):
    """A causal operator with a few values and one list of recent numbers per key.

    ``step(values, recent, pdf) -> (values, added, frame)`` gets the values (None at first), the numbers that are still
    remembered and a key's rows of a batch in order; ``added`` numbers are appended, so a batch writes what is new and
    not the whole list. With ``span`` the numbers are times in microseconds and are forgotten when the watermark has passed
    them by ``span``, also for a key without new rows: a key has one timer, for the first number it remembers, which then
    forgets all that are due and sets the next, so a key costs a timer for each batch and not for each number. With ``keep`` the list is cut back to its last
    ``keep`` numbers whenever it has grown to twice as many.
    """

    def __init__(self, key: str, order: list[str], values: str, number: str, step: Callable, span: int | None = None, keep: int | None = None):
        self.key, self.order = key, order
        self.values, self.number = StructType.fromDDL(values), StructType.fromDDL(f"x {number}")  # the worker has no session
        self.step, self.span, self.keep = step, span, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", self.values)
        self.recent = handle.getListState("recent", self.number)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        pdf = (frames[0] if len(frames) == 1 else pd.concat(frames)).sort_values(self.order)
        before = self.now.get()
        held = [x[0] for x in self.recent.get()] if before is not None else []
        if self.keep is not None:
            held = held[-self.keep :]
        values, added, frame = self.step(before, np.array(held), pdf)
        self.now.update(values)
        added = [(x.item(),) for x in added]
        if self.keep is not None and len(held) + len(added) > 2 * self.keep:
            self.recent.put(([(x,) for x in held] + added)[-self.keep :])
        elif added:
            self.recent.appendList(added)
        if self.span is not None and added and not held:  # else there is one
            self._wake(added)
        yield frame.assign(**{self.key: key[0]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        left = [x for x in self.recent.get() if self._due(x[0]) > passed]
        if left:
            self.recent.put(left)
            self._wake(left)
        else:
            self.recent.clear()
        return iter(())

    def _due(self, number: int) -> int:
        return (number + self.span) // 1000 + 1

    def _wake(self, numbers: list[tuple]) -> None:
        self.handle.registerTimer(self._due(min(x[0] for x in numbers)))

    def close(self) -> None:
        pass


def series(stream: DataFrame, key: str, order: list[str], values: list[str], out: str, state: str, number: str, step: Callable, span: int | None = None, keep: int | None = None) -> DataFrame:
    """``key`` and the columns ``out`` of ``Series``; with ``span`` the stream must have a watermark. Start it inside
    ``typed_state``."""
    columns = list(dict.fromkeys([key, *order, *values]))
    names = [x.split()[0] for x in out.split(", ")]

    def ordered(before, held, pdf):
        now, added, frame = step(before, held, pdf)
        return now, added, frame[names]

    processor = Series(key, order, state, number, ordered, span, keep)
    kind = dict(stream.dtypes)[key]
    return stream.select(*columns).groupBy(key).transformWithStateInPandas(processor, f"{out}, {key} {kind}", "Append", "EventTime" if span is not None else "None")


def remembered(sink: Sink, name: str) -> DataFrame:
    """What the keys of a stream of ``series`` remember: ``name`` is ``now`` or ``recent``."""
    reader = sink.spark.read.format("statestore").option("stateVarName", name)
    return reader.load(f"{sink.folder}/state")

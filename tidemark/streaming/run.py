"""Running streams to completion over stored tables, and the stateful operators of live series."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession) -> str:
    """A new folder for state and results where all executors see it: in ``spark.checkpoint.dir``. A local one takes its
    place only if that is unset and all executors are in this process (tests). It goes when the interpreter ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    folder = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may be gone when the interpreter ends
        pass


def read_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A stored table as a file stream with its own schema; naive timestamps become instants, as watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    s = spark.readStream.schema(schema).parquet(f"{sf_dir}/{table}.parq*et")
    return s.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


#: Tables by name, and what of a batch goes to each
Routes = dict[str, Callable[[DataFrame], DataFrame]]


class Sink:
    """A stream's work folder: state, and results under the number of their batch, so that a batch that is run again
    replaces itself."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or work_folder(spark)

    def run(self, stream: DataFrame, mode: str = "append", routes: Routes | None = None) -> None:
        """Run to the end of what is available; a second run goes on where the first ended. The last batch is one
        without data, in which the final watermark closes windows and timers.

        With ``routes`` a batch goes to several tables, each what its function makes of the batch. The batch is computed
        once; every table replaces what the same batch has written before, so that a batch that ended between two tables
        is whole after it is run again.
        """

        def put(df: DataFrame, batch: int) -> None:
            if routes is None:
                df.write.mode("overwrite").parquet(f"{self.folder}/out/{'all' if mode == 'complete' else f'batch={batch}'}")
                return
            df.persist()
            try:
                for name, pick in routes.items():
                    pick(df).write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")
            finally:
                df.unpersist()

        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).foreachBatch(put).start()
        q.awaitTermination()
        if q.exception():
            raise q.exception()

    def results(self, stream: DataFrame, mode: str = "append") -> DataFrame:
        return self.spark.read.schema(stream.schema).parquet(f"{self.folder}/out/{'all' if mode == 'complete' else 'batch=*'}")

    def table(self, name: str, stream: DataFrame, routes: Routes) -> DataFrame:
        """What a route has written so far."""
        return self.spark.read.schema(routes[name](stream).schema).parquet(f"{self.folder}/{name}/batch=*")

    def open_state(self) -> DataFrame:
        """What the keys of a ``per_key`` operator remember at the end: their key and the columns of their state."""
        rows = self.spark.read.format("statestore").load(f"{self.folder}/state")
        return rows.select("key.*", "value.groupState.*")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is available and return what it wrote. ``complete`` keeps the last full result."""
    sink = Sink(stream.sparkSession)
    sink.run(stream, mode)
    return sink.results(stream, mode)


def arrivals(rows: DataFrame, batch: Column, batches: int, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``build(stream)`` writes for a table that arrives in parts; see ``arrive``."""
    sink, stream = arrive(rows, batch, batches, build)
    return sink.results(stream)


def arrive(rows: DataFrame, batch: Column, batches: int, build: Callable[[DataFrame], DataFrame], routes: Routes | None = None) -> tuple[Sink, DataFrame]:
    """Run ``build(stream)`` over a table that arrives in ``batches`` parts: rows with ``batch`` = 0 first, and so on.

    Each part is written to the watched folder by one job and taken in by one run, so it may be of any size, and its
    rows meet the watermark that all parts before it have left.
    """
    spark = rows.sparkSession
    sink = Sink(spark)
    naive = [f.name for f in rows.schema if f.dataType.typeName() == "timestamp_ntz"]
    rows = rows.withColumns({c: F.col(c).cast("timestamp") for c in naive})
    stream = build(spark.readStream.schema(rows.schema).parquet(f"{sink.folder}/in/part=*"))
    for b in range(batches):
        rows.where(batch == b).write.parquet(f"{sink.folder}/in/part={b}")
        sink.run(stream, routes=routes)
    return sink, stream


def per_key(stream: DataFrame, key: str, order: list[str], values: list[str], out: str, state: str, step: Callable, expire: Callable | None = None) -> DataFrame:
    """A causal operator with state per key: ``step(state, pdf) -> (state, frame, until)``.

    ``pdf`` has a key's rows of a batch in the order of ``order``, ``state`` is None at first, else a tuple of the types
    in ``state``; ``frame`` has the columns in ``out``, which follow the key. Batches of a key must come in order, as
    for any causal operator. With ``expire(state) -> (state, frame)`` a key is visited again once the watermark, which
    the stream must have, passes ``until`` (milliseconds, or None for never).
    """
    kind = dict(stream.dtypes)[key]
    names = [key, *[c.strip().split()[0] for c in out.split(",")]]

    def run(k: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            s, made = expire(held.get)
            held.update(s)
        else:
            s, made, until = step(held.get if held.exists else None, pd.concat(list(frames)).sort_values(order))
            held.update(s)
            if expire and until is not None:
                held.setTimeoutTimestamp(max(until, held.getCurrentWatermarkMs() + 1))
        yield made.assign(**{key: k[0]})[names]

    columns = list(dict.fromkeys([key, *order, *values]))
    return stream.select(*columns).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {out}", state, "append", "EventTimeTimeout" if expire else "NoTimeout")

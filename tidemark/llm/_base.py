"""Helpers that the operators of this subpackage share: scratch tables, checked joins, components."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table may be broadcast when it has at most so many rows (keys and a few numbers each).
BROADCAST_ROWS = 300_000
#: and its texts and arrays have at most so many bytes
BROADCAST_BYTES = 32_000_000
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if _ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, have) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. A local one takes its place only if that is unset and
    all executors are in this process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _delete_quietly(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session may be gone when the interpreter ends
        pass


#: Folders of scratch tables opened inside the innermost ``own_tables`` of this thread or task
_OWNED: contextvars.ContextVar[list | None] = contextvars.ContextVar("owned", default=None)


@contextlib.contextmanager
def own_tables(spark: SparkSession) -> Iterator[None]:
    """The scratch tables opened inside are removed at the end: once a result that was made from them is written, nothing
    reads them any more. Tables of other threads, and those opened outside, stay."""
    mine: list[str] = []
    token = _OWNED.set(mine)
    try:
        yield
    finally:
        _OWNED.reset(token)
        for path in mine:
            _delete(spark, path)


class Scratch:
    """Tables written to the shared folder, to cut lineage where a job must survive lost executors. They stay until the
    interpreter ends, or the ``own_tables`` that they are opened in."""

    def __init__(self, spark: SparkSession, label: str):
        importable(spark)
        self.spark, self.path = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        if (mine := _OWNED.get()) is not None:
            mine.append(self.path)
        atexit.register(_delete_quietly, spark, self.path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.path}/{self._n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        for t in tables:
            _delete(self.spark, t._scratch_path)  # type: ignore[attr-defined]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with marks before it the first that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def beside(docs: DataFrame, names: list[str], step) -> DataFrame:
    """``step(docs)`` with only the columns of ``docs``, where ``step`` adds or replaces the columns ``names``: own
    columns of those names are put aside for it and come back as they were."""
    moved = {c: free_name(docs, f"_own_{c}") for c in docs.columns if c.lower() in {n.lower() for n in names}}
    out = step(docs.withColumnsRenamed(moved) if moved else docs)
    return out.select(*[F.col(f"`{moved.get(c, c)}`").alias(c) for c in docs.columns])


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lookup_join(left: DataFrame, table: DataFrame, on: list[str], how: str = "left", size: int | None = None) -> DataFrame:
    """Join a table with one row per key to ``left``, whose keys may be hot.

    The table's rows and bytes are counted first (or ``size`` bounds the rows, of keys and numbers alone). Up to
    ``BROADCAST_ROWS`` and ``BROADCAST_BYTES`` it is broadcast; beyond that
    both sides are shuffled, and adaptive execution splits a hot key of the left side, since the other side has one
    row for it. Null keys don't match.
    """
    small = size <= BROADCAST_ROWS if size is not None else fits_broadcast(table)
    return left.join(F.broadcast(table) if small else table.hint("merge"), on, how)


def fits_broadcast(table: DataFrame) -> bool:
    """Whether a table is counted to be within both bounds of a broadcast."""
    size = F.lit(0).cast("long")
    for f in table.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind == "array":
            size = size + 24 * F.coalesce(F.array_size(c), F.lit(0))
    got = table.agg(F.count("*").alias("n"), F.sum(size).alias("size")).first()
    return got["n"] <= BROADCAST_ROWS and (got["size"] or 0) <= BROADCAST_BYTES


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(id, class_id)``, class_id the smallest id of the component.

    Alternating large-star and small-star steps until every component is a star around its smallest id: each step is a
    join and two aggregations over the edges, which are written out after each round; only a count of the ids that
    break the star comes to the driver. The least neighbours are a written table with one row per id: broadcast while it
    is small, else joined by a plain shuffle, so that adaptive execution can split the links of a hub.
    """
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _is_star(now):
        both = now.union(now.select("v", "u"))
        low = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = lookup_join(both, low, ["u"], "inner").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.save(large, "large")
        low2 = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = lookup_join(large, low2, ["u"], "inner").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = scratch.save(small, "edges")
        scratch.drop(now, low, large, low2)
        now = new
    return now.select(F.col("u").alias("id"), F.col("v").alias("class_id")).union(now.select("v", "v").distinct())


def _is_star(edges: DataFrame) -> bool:
    """Whether every id has one smaller neighbour, which itself has none."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("to")), F.struct(F.col("v").alias("id"), F.lit(None).cast("long").alias("to")))).alias("e")).select("e.*")
    seen = ends.groupBy("id").agg(F.min("to").alias("lo"), F.max("to").alias("hi"), F.max(F.col("to").isNull().cast("int")).alias("root"))
    return seen.where("lo <> hi or (root = 1 and lo is not null)").isEmpty()


def append_columns(df: DataFrame, inputs: list[str], fields: str, make, texts_in: int = 0, part: int = 1_000_000, without: tuple[str, ...] = ()) -> DataFrame:
    """All rows and columns of ``df`` with new ones computed in Python from the columns ``inputs``.

    ``make`` gets one list per input and returns one list or numpy array per new column. Batches are split so that the
    texts of input number ``texts_in`` hold about ``part`` characters at once. Columns of ``df`` that have the name of
    a new one are replaced, those ``without`` names are left out.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    from tidemark.llm._words import chunks

    importable(df.sparkSession)
    new = StructType.fromDDL(fields)
    gone = {f.name.lower() for f in new} | {c.lower() for c in without}
    kept = [f for f in df.schema if f.name.lower() not in gone]
    schema = StructType([*kept, *new])
    new_arrow = to_arrow_schema(new)
    names = [f.name for f in kept]

    def run(batches):
        for b in batches:
            lists = [b.column(b.schema.get_field_index(c)).to_pylist() for c in inputs]
            for lo, hi in chunks(lists[texts_in], part):
                made = make(*[x[lo:hi] for x in lists])
                own = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [own.column(own.schema.get_field_index(n)) for n in names] + [x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for x, f in zip(made, new_arrow, strict=True)],
                    names=names + new_arrow.names,
                )

    needed = list(dict.fromkeys([*names, *inputs]))
    return df.select(*[F.col(f"`{c}`") for c in needed]).mapInArrow(run, schema)


def labelled_sample(scratch: Scratch, docs: DataFrame, labels: DataFrame, rows: int, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, int, int]:
    """At most about ``rows`` labelled texts, drawn by the hash of their key, as a written table ``(h, t, y)``; and the
    numbers of all labels and of labels 1.

    ``labels(key, label)`` is sampled first; what is left has a fixed bound and is broadcast, so the texts are filtered
    where they are read and none but the sample is written. Null labels, keys and texts are left out. Repeated labels of
    a key are one, the largest; rows of documents that share a key are rows of their own, and are thinned at random
    where they break the bound.
    """
    lab = labels.where(F.col("label").isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(F.col("label").cast("int")).alias("y"))
    lab = lab.withColumn("h", F.xxhash64(F.col("_k").cast("string")))
    stats = lab.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
    total, ones = stats["n"], int(stats["p"] or 0)
    drawn = lab.where(F.pmod("h", F.lit(1 << 30)) < int(min(1.0, rows / max(1, total)) * (1 << 30)))
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.col(text).alias("t"))
    sample = scratch.save(texts.join(F.broadcast(drawn), "_k").select("h", "t", "y"), "sample")
    if (n := sample.count()) > 2 * rows:
        sample = scratch.save(sample.where(F.rand(7) < rows / n), "sample")
    return sample, total, ones

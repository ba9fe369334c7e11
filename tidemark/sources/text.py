"""Lines of text files with their numbers, and numbers in nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import sized
from tidemark.operators.ranks import written


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, line`` of all text files below ``path``; numbers begin at 1 in each file.

    A large file is read in blocks by many tasks. A line's number is its place in its block, which is the order in which
    a task reads it, plus the lines of the file's earlier blocks: one row for each block goes through a window.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    own = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"))
    lines = written(own)
    blocks = lines.groupBy("file", "block").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = written(blocks.withColumn("before", before).drop("n"))
    return lines.join(sized(blocks), ["file", "block"]).select("file", (F.col("place") - F.col("first") + F.col("before") + 1).alias("line_no"), "line")


#: Levels of JSON that are taken apart before rows are written
STEPS = 8


def numeric_leaves(rows: DataFrame, key: str, json: str, deepest: int = 64) -> DataFrame:
    """``key, path, num`` for every finite number in the JSON texts of ``rows``, at any depth of objects and arrays; paths
    read like ``$.a[0].b``. Booleans, texts and nulls are no numbers; a text that is no JSON has none.

    Texts are taken apart by ``STEPS`` levels in one pass, in which what is no object or array stays as it is. Only numbers
    are written then, and what is still an object or an array, which goes on until none is left (or ``deepest`` levels are
    passed, which is an error).
    """
    level = rows.select(F.col(key).alias("_id"), F.lit("$").alias("path"), F.try_parse_json(json).alias("v"), F.lit(True).alias("open")).where("v is not null")
    found, left = None, deepest - 1
    while True:
        steps = min(STEPS, left)
        left -= steps
        for _ in range(steps):
            inner = level.select("_id", "path", F.col("v").alias("whole")).lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("whole").outer()))
            step = F.when(F.col("key").isNull(), F.format_string("[%d]", F.col("pos"))).otherwise(F.concat(F.lit("."), F.col("key")))
            opened = F.col("pos").isNotNull()
            level = inner.select("_id", F.when(opened, F.concat("path", step)).otherwise(F.col("path")).alias("path"), F.when(opened, F.col("value")).otherwise(F.col("whole")).alias("v"), opened.alias("open"))
        level = level.withColumn("kind", F.schema_of_variant("v"))
        number = F.when(F.col("kind").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get("v", "$", "double"))
        nested = F.when(F.col("open") & F.col("kind").rlike("^(OBJECT|ARRAY)"), F.col("v"))
        level = written(level.select(F.col("_id"), "path", number.alias("num"), nested.alias("v")).where("v is not null or num > double('-infinity') and num < double('infinity')"))
        here = level.where("num is not null").select(F.col("_id").alias(key), "path", "num")
        found = here if found is None else found.union(here)
        level = level.where("v is not null").select("_id", "path", "v", F.lit(True).alias("open"))
        if level.isEmpty():
            return found
        if not left:
            raise ValueError(f"JSON deeper than {deepest} levels")

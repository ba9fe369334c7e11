"""Sources that keep a ledger: what could not be read is counted by reason, never dropped in silence."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def split_lenient(line: Column) -> Column:
    """Fields of a delimited line whose quotes open only after a delimiter and close only before one; quotes inside a
    field are data."""
    parts = F.regexp_extract_all(line, F.lit(r'(?:^|,)(?:"(.*?)"(?=,|\s*$)|([^,]*))'), 0)
    bare = F.transform(parts, lambda x: F.regexp_replace(x, "^,", ""))
    # the first field has no delimiter to strip; a field that begins with one is empty before it
    return F.transform(bare, lambda x: F.when(x.rlike(r'^".*"\s*$'), F.regexp_replace(x, r'^"|"\s*$', "")).otherwise(x))


def read_lenient(lines: DataFrame, names: list[str], kinds: dict[str, str], required: list[str]) -> DataFrame:
    """Rows of text lines ``(line_no, line)`` as columns, with ``reason`` NULL for good rows, else why it was rejected:
    malformed_width, empty_<column>, or cast_<column>."""
    d = lines.withColumn("_f", split_lenient(F.col("line")))
    wide = F.size("_f") == len(names)
    cols = {n: F.when(wide, F.try_element_at("_f", F.lit(i + 1))) for i, n in enumerate(names)}
    d = d.withColumns(cols)
    reason = F.when(~wide, "malformed_width")
    for n in required:
        reason = reason.when(F.trim(F.col(n)) == "", f"empty_{n}")
    for n, kind in kinds.items():
        reason = reason.when(F.col(n).try_cast(kind).isNull() & (F.trim(F.col(n)) != ""), f"cast_{n}")
    d = d.withColumn("reason", reason)
    return d.withColumns({n: F.col(n).try_cast(k) for n, k in kinds.items()}).drop("_f", "line")


def ledger(rows: DataFrame, examples: int = 20) -> DataFrame:
    """Per reason the number of rejected rows and the first line numbers, in one aggregation: the examples are the least
    numbers by tasks' own ranks first, so a hot reason costs ``examples`` rows a task."""
    bad = rows.where("reason is not null").select("reason", "line_no")
    first = first_of_each(bad, "reason", "line_no", examples)
    lists = first.groupBy("reason").agg(F.array_sort(F.collect_list("line_no")).alias("lines"))
    return bad.groupBy("reason").agg(F.count("*").alias("n")).join(lists.hint("merge"), "reason")


def first_of_each(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The ``n`` rows of each group that come first. A ranked window with a bound: Spark keeps ``n`` rows of a group in
    each task before it shuffles."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def text_map(line: Column) -> Column:
    """``key: token token`` as a struct of key and tokens."""
    parts = F.split(line, ":", 2)
    return F.struct(F.trim(parts[0]).alias("key"), F.filter(F.split(F.trim(parts[1]), r"\s+"), lambda x: x != "").alias("tokens"))


def payload_kind(head: Column) -> Column:
    """What a payload is by its first bytes, not its name."""
    return F.when(head.isNull() | (head == ""), "empty").when(head.rlike(r"(?i)^\s*<!doctype html|^\s*<html"), "html").when(head.rlike(r"(?i)^\s*<\?xml"), "xml").otherwise("other")


def best_file(files: DataFrame, key: str, is_bad: str, is_part: str, name: str) -> DataFrame:
    """One file per key: real ones before placeholders, complete before partial, then by name; a bad one if it is alone.
    ``substituted`` tells that a bad or partial file was passed over."""
    w = Window.partitionBy(key).orderBy(is_bad, is_part, name)
    whole = Window.partitionBy(key)
    d = files.withColumn("_r", F.row_number().over(w)).withColumn("_first", F.min(name).over(whole))
    return d.where("_r = 1").withColumn("substituted", F.col(name) != F.col("_first")).drop("_r", "_first")


def hash_rank(key: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), key.cast("string")))


def verify_sample(df: DataFrame, key: str, n: int, seed: str = "v") -> DataFrame:
    """Mark the ``n`` rows with the smallest seeded hash ``verified``, all others ``unchecked``. The sample is a top-k
    (bounded), joined back by its threshold."""
    h = df.withColumn("_h", hash_rank(F.col(key), seed))
    limit = h.select("_h").orderBy("_h").limit(n).agg(F.max("_h").alias("_t"))
    return h.crossJoin(F.broadcast(limit)).withColumn("status", F.when(F.col("_h") <= F.col("_t"), "verified").otherwise("unchecked")).drop("_h", "_t")


def stratified_sample(df: DataFrame, key: str, group: str, n: int, groups: int, seed: str = "g") -> DataFrame:
    """``n // groups`` rows of each group by seeded hash, topped up to ``n`` from the rest in the same order."""
    h = df.withColumn("_h", hash_rank(F.col(key), seed))
    ranked = h.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("_h"))).where(F.col("_r") <= n)  # no group gives more
    return ranked.orderBy(F.col("_r") > n // groups, "_h").limit(n).drop("_h", "_r")


#: Files up to this length are hashed as one value; longer ones are read in pieces, as a value ends at 2 GB
WHOLE, PIECE = 1 << 30, 1 << 22


def inventory(spark: SparkSession, folder: str, pattern: str = "*.parquet", whole: int = WHOLE) -> DataFrame:
    """Files of a folder with length and SHA-256 of their content. A task reads a file from its beginning to its end, as
    SHA-256 goes through it in order, but holds no more than ``whole`` bytes of it."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", r"([^/]+(?:/part-[^/]+)?)$", 1).alias("name")
    short = f.where(F.col("length") <= whole).select(name, "length", F.sha2("content", 256).alias("sha256"))
    long = f.where(F.col("length") > whole).select("path", "length").mapInArrow(_hashed, "path string, length long, sha256 string")
    return short.union(long.select(name, "length", "sha256"))


def _hashed(batches):
    for batch in batches:
        found = []
        for path in batch.column(0).to_pylist():
            scheme, _, rest = path.partition(":")
            h = hashlib.sha256()
            with open("/" + rest.lstrip("/"), "rb") if scheme == "file" else _remote(path) as file:
                while piece := file.read(PIECE):
                    h.update(piece)
            found.append(h.hexdigest())
        yield pa.record_batch({"path": batch.column(0), "length": batch.column(1), "sha256": pa.array(found, pa.string())})


def _remote(path: str):
    fs, place = FileSystem.from_uri(path)
    return fs.open_input_stream(place)


def verify(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Status of each manifest row: missing_or_empty (Spark's file sources skip empty files), size, checksum, ok."""
    j = manifest.alias("m").join(found.alias("f"), F.col("m.name") == F.col("f.name"), "left")
    status = F.when(F.col("f.name").isNull(), "missing_or_empty").when(F.col("f.length") != F.col("m.length"), "size").when(F.col("f.sha256") != F.col("m.sha256"), "checksum").otherwise("ok")
    return j.select(F.col("m.name").alias("name"), status.alias("status"))


def write_report(rows: DataFrame, folder: str, order: str) -> None:
    """A small report as JSON lines, as CSV with a header and as a Markdown table, each a folder with one file."""
    one = rows.coalesce(1).sortWithinPartitions(order)
    one.write.json(f"{folder}/json")
    one.write.option("header", "true").csv(f"{folder}/csv")
    row = lambda cells: "| " + " | ".join(cells) + " |"
    cells = F.concat(F.lit("| "), F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]), " | "), F.lit(" |"))
    body = one.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), cells.alias("l")))), lambda s: s["l"]), "\n").alias("b"))
    body.select(F.concat_ws("\n", F.lit(row(rows.columns)), F.lit(row(["-"] * len(rows.columns))), "b").alias("value")).write.text(f"{folder}/markdown")


def write_run(df: DataFrame, folder: str) -> str:
    """Write under a run id made from the content, and refuse to overwrite; a row in ``_latest`` points to it."""
    rows = df.select(F.md5(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))).alias("h"))
    run = rows.agg(F.md5(F.concat(F.count("*").cast("string"), F.lit(":"), F.sum(F.conv(F.substring("h", 1, 12), 16, 10).cast("decimal(38,0)")).cast("string"))).alias("r")).first()["r"]
    df.withColumn("run_id", F.lit(run)).write.partitionBy("run_id").mode("append").parquet(f"{folder}/runs") if not _has_run(df.sparkSession, folder, run) else None
    df.sparkSession.range(1).select(F.lit(run).alias("run_id")).write.mode("overwrite").parquet(f"{folder}/_latest")
    return run


def _has_run(spark: SparkSession, folder: str, run: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/runs/run_id={run}")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_xml_tiers(spark: SparkSession, path: str) -> DataFrame:
    """Hierarchical annotation XML, one row per label: attributes of the tier are inherited by its utterances and labels;
    wrapping quotes are stripped; a file that can't be parsed gives one row with ``corrupt``."""
    label = "struct<_LABEL:string,_VALUE:string,_START:long,_END:long>"
    schema = f"`SEGMENT-TIER` array<struct<_PARTICIPANT:string,UTTERANCE:array<struct<_ID:string,_START_FRAME:long,_END_FRAME:long,`NON-MANUAL`:array<{label}>>>>>, _corrupt_record string"
    raw = spark.read.format("xml").option("recursiveFileLookup", "true").option("rowTag", "COLLECTION").option("mode", "PERMISSIVE").schema(schema).load(path).select("*", F.col("_metadata.file_name").alias("file"))
    strip = lambda c: F.regexp_replace(F.trim(c), r"^'|'\z", "")
    tiers = raw.select("file", F.col("_corrupt_record").isNotNull().alias("corrupt"), F.explode_outer("SEGMENT-TIER").alias("t"))
    utt = tiers.select("file", "corrupt", strip(F.col("t._PARTICIPANT")).alias("participant"), F.explode_outer("t.UTTERANCE").alias("u"))
    lab = utt.select("file", "corrupt", "participant", F.col("u._ID").alias("utterance"), F.col("u._START_FRAME").alias("start_frame"), F.col("u._END_FRAME").alias("end_frame"), F.explode_outer("u.NON-MANUAL").alias("n"))
    return lab.select("file", "corrupt", "participant", "utterance", "start_frame", "end_frame", strip(F.col("n._LABEL")).alias("label"), strip(F.col("n._VALUE")).alias("value"), F.col("n._START").alias("lo"), F.col("n._END").alias("hi"))


def annotation_report(rows: DataFrame, mapped: list[str]) -> DataFrame:
    """One row over the label rows of ``read_xml_tiers``: files' records that can't be parsed, participants, utterances,
    labels, how many have a label that is not ``mapped`` and how many different (label, value) pairs those are, and the
    frames that labels cover."""
    good, lost = ~F.col("corrupt"), ~F.col("label").isin(mapped)
    return rows.agg(
        F.count_if("corrupt").alias("unparseable"), F.count_distinct(F.when(good, F.col("participant"))).alias("participants"),
        F.count_distinct(F.when(good, F.struct("participant", "utterance"))).alias("utterances"), F.count_if(good & F.col("label").isNotNull()).alias("labels"),
        F.count_if(good & lost).alias("unmapped"), F.count_distinct(F.when(good & lost, F.struct("label", "value"))).alias("unmapped_pairs"), F.sum(F.when(good, F.col("hi") - F.col("lo") + 1)).alias("frames"),
    )

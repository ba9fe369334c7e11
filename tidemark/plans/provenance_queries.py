"""Queries on text files, strict reading, nested numbers and chains of artifacts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import lineage as K
from tidemark.plans.ingest_queries import customer_lines
from tidemark.plans.registry import query
from tidemark.sources import ingest as I
from tidemark.sources import strict as X
from tidemark.sources import text as T
from tidemark.streaming.run import work_folder

NAMES, KINDS = ["custkey", "name", "acctbal", "segment"], {"custkey": "bigint", "acctbal": "double"}

A01_SQL = """
WITH r AS (
  SELECT c_custkey, c_name, c_acctbal, c_mktsegment, c_custkey % 3 AS part, row_number() OVER (PARTITION BY c_custkey % 3 ORDER BY c_custkey) AS line_no,
    CASE WHEN c_custkey % 7 = 2 THEN 'malformed_width' WHEN c_custkey % 13 = 5 THEN 'empty_segment' WHEN c_custkey % 11 = 3 THEN 'cast_acctbal' END AS reason
  FROM customer)
SELECT part, line_no, reason, CASE WHEN reason IS NULL THEN c_custkey END AS custkey, CASE WHEN reason IS NULL THEN c_acctbal END AS acctbal,
  CASE WHEN reason IS NULL THEN c_mktsegment END AS segment
FROM r
"""


@query("a01_delimited_files", A01_SQL)
def a01_files(t):
    """Three text files of delimited lines, read with the line numbers of each: good rows, and the reason beside others."""
    folder = f"{work_folder(t.spark)}/lines"
    lines = customer_lines(t).withColumn("part", (F.col("line_no") - 1) % 3)
    lines.repartition(3, "part").sortWithinPartitions("part", "line_no").select("line", "part").write.partitionBy("part").text(folder)
    read = T.numbered_lines(t.spark, folder).withColumn("part", F.regexp_extract("file", r"part=(\d+)/", 1).cast("long"))
    p = I.read_lenient(read, NAMES, KINDS, ["segment"])
    return p.select("part", "line_no", "reason", *[F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in ("custkey", "acctbal", "segment")])


@query("a07_strict_labels", "SELECT doc_id, quality, lang FROM labels JOIN documents USING (doc_id)")
def a07_strict(t):
    """Labels that must all be in range and have their document; the first that does not fails the job by name."""
    docs = t("documents").select("doc_id", "lang", F.lit(True).alias("there"))
    j = t("labels").select("doc_id", "quality").join(docs.hint("merge"), "doc_id", "left")
    rules = {"unmapped label": F.col("there"), "label out of range": F.col("quality").between(0, 1)}
    return X.required(j, rules, "doc_id").drop("there")


A10_SQL = """
WITH m AS (SELECT label, count(*) AS frames FROM embeddings GROUP BY 1)
SELECT vec_id, e.label, frames, CASE WHEN len(embedding) <> 64 THEN 'width' WHEN list_bool_or([NOT isfinite(x) FOR x IN embedding]) THEN 'finite' END AS reason
FROM embeddings e JOIN m USING (label)
"""


def framed(t):
    """Vectors with the number of frames that their series has by its count."""
    e = t("embeddings")
    meta = e.groupBy("label").agg(F.count("*").alias("frames"))
    return e.join(meta.hint("merge"), "label")


def frame_rules():
    return {"width": F.size("embedding") == 64, "finite": F.forall("embedding", lambda x: F.abs(x) < float("inf"))}


@query("a10_series_with_meta", A10_SQL)
def a10_meta(t):
    """Every vector with its series' own count, and the rule it breaks, so that broken ones can be set aside."""
    return X.parted(framed(t), frame_rules()).select("vec_id", "label", "frames", "reason")


@query("a10_strict_series", "SELECT vec_id, label, count(*) OVER (PARTITION BY label) AS frames FROM embeddings")
def a10_strict(t):
    """The same, strictly: a vector of another width or with a number that is not finite fails the job by its id."""
    return X.required(framed(t), frame_rules(), "vec_id").select("vec_id", "label", "frames")


@query("c01_join_above_a_floor", "SELECT doc_id, quality, source FROM labels JOIN documents USING (doc_id)")
def c01_floor(t):
    """Labels with their documents, if at least 98 % have one; matches are counted while the rows are written."""
    return X.joined_above(t("labels").select("doc_id", "quality"), t("documents").select("doc_id", "source"), "doc_id", 0.98)


B26_SQL = """
WITH i AS (
  SELECT l_orderkey, CAST('[' || string_agg(CAST(json_object('n', l_linenumber, 'flags', json_array(l_returnflag, l_quantity, json_array(l_tax, true, NULL))) AS VARCHAR), ',' ORDER BY l_linenumber, l_returnflag, l_quantity, l_tax) || ']' AS JSON) AS items
  FROM lineitem GROUP BY 1),
j AS (
  SELECT o_orderkey, json_object('order', json_object('total', o_totalprice, 'status', o_orderstatus, 'open', o_orderstatus = 'O', 'items', items)) AS doc
  FROM orders JOIN i ON l_orderkey = o_orderkey)
SELECT o_orderkey, fullkey AS path, round(CAST(atom AS DOUBLE), 6) AS num
FROM (SELECT o_orderkey, unnest(array(SELECT {'fullkey': fullkey, 'atom': atom, 'type': type} FROM json_tree(doc)), recursive := true) FROM j)
WHERE type IN ('BIGINT', 'UBIGINT', 'DOUBLE')
"""


@query("b26_nested_numbers", B26_SQL)
def b26_nested(t):
    """All numbers of orders as JSON of five levels, with the path of each."""
    inner = F.concat(F.lit('["'), "l_returnflag", F.lit('",'), F.col("l_quantity").cast("string"), F.lit(",["), F.col("l_tax").cast("string"), F.lit(",true,null]]"))
    item = F.concat(F.lit('{"n":'), F.col("l_linenumber").cast("string"), F.lit(',"flags":'), inner, F.lit("}"))
    items = t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_quantity", "l_tax", item.alias("j")))), lambda s: s["j"]), ",").alias("items"))
    o = t("orders").join(items.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    doc = F.concat(
        F.lit('{"order":{"total":'), F.col("o_totalprice").cast("string"), F.lit(',"status":"'), "o_orderstatus", F.lit('","open":'), (F.col("o_orderstatus") == "O").cast("string"),
        F.lit(',"items":['), "items", F.lit("]}}"),
    )
    return T.numeric_leaves(o.select("o_orderkey", doc.alias("doc")), "o_orderkey", "doc").select("o_orderkey", "path", F.round("num", 6).alias("num"))


#: Orders of a customer as artifacts: each is replaced by the customer's next one, the last of some by the first (a cycle) or
#: by one that there is none of
D22_SQL = """
WITH RECURSIVE a AS (
  SELECT o_orderkey AS name, o_custkey, lead(o_orderkey) OVER w AS nxt, first_value(o_orderkey) OVER w AS first FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
b AS (SELECT name, coalesce(nxt, CASE o_custkey % 5 WHEN 0 THEN first WHEN 1 THEN -o_custkey END) AS nxt FROM a),
c(name, place, hops, seen, fault) AS (
  SELECT name, name, 0, [name], NULL::VARCHAR FROM b
  UNION ALL
  SELECT c.name, b.nxt, c.hops + 1, list_append(c.seen, b.nxt), CASE WHEN list_contains(c.seen, b.nxt) THEN 'cycle' WHEN b.nxt NOT IN (SELECT name FROM b) THEN 'dangling' END
  FROM c JOIN b ON b.name = c.place WHERE c.fault IS NULL AND b.nxt IS NOT NULL),
e AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY hops DESC) AS r FROM c)
SELECT name, CASE WHEN fault = 'cycle' THEN NULL ELSE place END AS last, CASE WHEN fault = 'cycle' THEN NULL ELSE CAST(hops AS BIGINT) END AS hops, fault FROM e WHERE r = 1
"""


@query("d22_supersession_chains", D22_SQL)
def d22_chains(t):
    """What counts in place of each artifact: the end of its chain of successors."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = t("orders").select(F.col("o_orderkey").alias("name"), "o_custkey", F.lead("o_orderkey").over(w).alias("nxt"), F.first("o_orderkey").over(w).alias("first"))
    last = F.when(F.col("o_custkey") % 5 == 0, F.col("first")).when(F.col("o_custkey") % 5 == 1, -F.col("o_custkey"))
    return K.ends_of_chains(o.select("name", F.coalesce("nxt", last).alias("superseded_by")))

"""Source, ledger and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.ranks import written
from tidemark.plans.registry import query
from tidemark.sources import ingest as I


def customer_lines(t):
    """Delimited lines with inner quotes and commas, some of them broken."""
    k = F.col("c_custkey")
    name = F.concat(F.lit('"'), "c_name", F.lit('"ok, hey"'))
    bal = F.when(k % 11 == 3, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string"))
    seg = F.when(k % 13 == 5, F.lit('""')).otherwise(F.concat(F.lit('"'), "c_mktsegment", F.lit('"')))
    line = F.concat_ws(",", F.concat(F.lit('"'), k.cast("string"), F.lit('"')), name, bal, seg)
    return t("customer").select((k + 1).alias("line_no"), F.when(k % 7 == 2, F.concat_ws(",", k.cast("string"), name)).otherwise(line).alias("line"))


def parsed(t):
    return I.read_lenient(customer_lines(t), ["custkey", "name", "acctbal", "segment"], {"custkey": "bigint", "acctbal": "double"}, ["segment"])


_REASON = "CASE WHEN c_custkey % 7 = 2 THEN 'malformed_width' WHEN c_custkey % 13 = 5 THEN 'empty_segment' WHEN c_custkey % 11 = 3 THEN 'cast_acctbal' END"


@query("a01_lenient_delimited_read", f"""
SELECT c_custkey + 1 AS line_no, c_custkey AS custkey, c_name || '\"ok, hey' AS name, c_acctbal AS acctbal, c_mktsegment AS segment
FROM customer
WHERE {_REASON} IS NULL
""")
def a01(t):
    return parsed(t).where("reason is null").drop("reason")


@query("a02_reject_ledger", f"""
WITH r AS (SELECT {_REASON} AS reason, c_custkey + 1 AS line_no FROM customer)
SELECT reason, count(*) AS n, list_sort(list(line_no ORDER BY line_no))[1:20] AS lines
FROM r
WHERE reason IS NOT NULL
GROUP BY 1
""")
def a02(t):
    return I.ledger(parsed(t))


def flattened(orders, lines):
    """One JSON text per order with its lines nested, and the lines flattened out of it again."""
    item = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"))
    docs = orders.join(lines.groupBy("l_orderkey").agg(F.collect_list(item).alias("instances")).hint("shuffle_hash"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.to_json(F.struct("o_orderkey", "instances")).alias("json"))
    j = docs.select(F.from_json("json", "o_orderkey long, instances array<struct<n:int,part:long,flag:string>>").alias("j"))
    return j.select("j.o_orderkey", F.explode("j.instances").alias("i")).select("o_orderkey", F.col("i.n").alias("instance"), "i.part", F.coalesce("i.flag", F.lit("?")).alias("flag"))


_FLAT = """
SELECT o_orderkey, l_linenumber AS instance, l_partkey AS part, coalesce(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END, '?') AS flag
FROM orders
JOIN lineitem ON l_orderkey = o_orderkey
"""


@query("a05_nested_json_flatten", _FLAT)
@query("a05_nested_json_flatten_whole", _FLAT)
def a05(t):
    """All orders and all their lines (under both of the names it has had)."""
    return flattened(t("orders"), t("lineitem"))


@query("a06_text_map", r"""
SELECT conv_id, turn, role AS key, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS tokens
FROM conversations
""")
def a06(t):
    line = F.concat("role", F.lit(":  "), "text")
    return t("conversations").select("conv_id", "turn", I.text_map(line).alias("m")).select("conv_id", "turn", "m.*")


@query("a07_validated_labels", """
SELECT d.doc_id, coalesce(CAST(quality AS VARCHAR), 'unlabelled') AS quality, CASE WHEN l.doc_id IS NULL THEN 'unmapped' WHEN quality NOT BETWEEN 0
  AND 1 THEN 'range' ELSE 'ok' END AS status
FROM documents d
LEFT JOIN labels l USING (doc_id)
""")
def a07(t):
    l = t("labels").select("doc_id", "quality", F.lit(True).alias("_m"))
    j = t("documents").select("doc_id").join(l.hint("shuffle_hash"), "doc_id", "left")
    return j.select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("unlabelled")).alias("quality"), F.when(F.col("_m").isNull(), "unmapped").when(~F.col("quality").between(0, 1), "range").otherwise("ok").alias("status"))


_SKIP = "CASE WHEN html IS NULL THEN 'missing' WHEN length(html) < 1000 THEN 'tiny' WHEN NOT regexp_matches(html, '(?i)^<!doctype') THEN 'undecodable' WHEN url NOT LIKE 'https%' THEN 'bad_scheme' END"


@query("a08_scan_with_skip_reasons", f"SELECT coalesce({_SKIP}, 'used') AS reason, count(*) AS n FROM pages GROUP BY 1")
def a08(t):
    h = F.col("html")
    reason = F.when(h.isNull(), "missing").when(F.length(h) < 1000, "tiny").when(~h.rlike("(?i)^<!doctype"), "undecodable").when(~F.startswith("url", F.lit("https")), "bad_scheme").otherwise("used")
    return t("pages").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("a08_pruned_scan_with_limit", """
WITH u AS (SELECT page_id, url, regexp_extract(url, '://([^/?#]+)', 1) AS shard FROM pages WHERE page_id >= 20 AND url LIKE 'http%')
SELECT page_id, url, shard
FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY page_id) AS r FROM u)
WHERE r <= 25
""")
def a08_limit(t):
    """Two of the columns, rows above an id by the file's statistics, and the first 25 usable rows of each shard: the
    limit is applied in every task before the shuffle, so a hot shard costs 25 rows a task."""
    return I.first_of_each(t("pages").where("page_id >= 20 and url like 'http%'").select("page_id", "url", F.regexp_extract("url", "://([^/?#]+)", 1).alias("shard")), "shard", "page_id", 25)


@query("a10_series_contract", """
WITH f AS (SELECT label, count(*) AS frames, count(*) FILTER (WHERE len(embedding) <> 64) AS bad_width FROM embeddings GROUP BY 1)
SELECT label, frames, bad_width, CASE WHEN bad_width > 0 THEN 'width' WHEN frames < 48 THEN 'short' ELSE 'ok' END AS status
FROM f
""")
def a10(t):
    f = t("embeddings").groupBy("label").agg(F.count("*").alias("frames"), F.count_if(F.size("embedding") != 64).alias("bad_width"))
    return f.withColumn("status", F.when(F.col("bad_width") > 0, "width").when(F.col("frames") < 48, "short").otherwise("ok"))


@query("a12_payload_kind", r"""
SELECT CASE WHEN regexp_matches(substr(html, 1, 256), '(?i)^\s*<!doctype html|^\s*<html') THEN 'html' ELSE 'other' END AS kind, count(*) AS n
FROM (SELECT CASE WHEN page_id % 5 = 0 THEN substr(html, 40) ELSE html END AS html FROM pages)
GROUP BY 1
""")
def a12(t):
    h = F.when(F.col("page_id") % 5 == 0, F.expr("substring(html, 40)")).otherwise(F.col("html"))
    return t("pages").groupBy(I.payload_kind(F.substring(h, 1, 256)).alias("kind")).agg(F.count("*").alias("n"))


@query("a13_bind_best_file", r"""
WITH f AS (SELECT regexp_extract(url, '://([^/]+)', 1) AS host, page_id % 3 = 0 AS bad, url LIKE '%?%' AS part, url FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY bad, part, url) AS r, min(url) OVER (PARTITION BY host) AS first FROM f)
SELECT host, bad, part, url, url <> first AS substituted
FROM r
WHERE r = 1
""")
def a13(t):
    f = t("pages").select(F.regexp_extract("url", "://([^/]+)", 1).alias("host"), (F.col("page_id") % 3 == 0).alias("bad"), F.contains("url", F.lit("?")).alias("part"), "url")
    return I.best_file(f, "host", "bad", "part", "url")


@query("a14_verify_a_sample", """
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('v:' || doc_id)) <= 100 THEN 'verified' ELSE 'unchecked' END AS status
FROM documents
""")
def a14(t):
    return I.verify_sample(t("documents").select("doc_id"), "doc_id", 100)


@query("a15_stratified_sample", """
WITH r AS (SELECT doc_id, lang, md5('g:' || doc_id) AS h, row_number() OVER (PARTITION BY lang ORDER BY md5('g:' || doc_id)) AS r FROM documents)
SELECT doc_id, lang
FROM r
ORDER BY r > 50 // 4, h LIMIT 50
""")
def a15(t):
    return I.stratified_sample(t("documents").select("doc_id", "lang"), "doc_id", "lang", 50, 4)


@query("a16_resumable_work_list", """
SELECT o_orderkey, o_orderpriority
FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
""")
def a16(t):
    done = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t("orders").select("o_orderkey", "o_orderpriority").join(done, "o_orderkey", "left_anti")


@query("a17_content_run_id", """
SELECT md5(count(*) || ':' || CAST(sum(('0x' || substr(md5(o_orderkey || '|' || o_orderstatus), 1, 12))::BIGINT) AS VARCHAR)) AS run_id, count(*) AS n
FROM orders
""")
def a17(t):
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus")), 1, 12), 16, 10).cast("decimal(20,0)")
    return t("orders").agg(F.md5(F.concat_ws(":", F.count("*").cast("string"), F.sum(h).cast("string"))).alias("run_id"), F.count("*").alias("n"))


_RUN = """
g AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1),
h AS (SELECT md5(count(*) || ':' || sum(('0x' || substr(md5(to_json({n: n, o_orderstatus: o_orderstatus})), 1, 12))::BIGINT)) AS run_id FROM g)
"""


@query("a17_run_scoped_write", f"WITH {_RUN} SELECT g.*, run_id, true AS latest FROM g, h")
def a17_write(t):
    """A report written under the id of its content, twice: the second write finds the run there and changes nothing."""
    from tidemark.streaming.run import work_folder

    g, folder = t("orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")), work_folder(t.spark)
    runs = {I.write_run(g, folder) for _ in range(2)}
    latest = t.spark.read.parquet(f"{folder}/_latest").first()["run_id"]
    return t.spark.read.parquet(f"{folder}/runs").select("o_orderstatus", "n", "run_id", F.col("run_id").isin(latest, *runs).alias("latest"))


@query("a18_report_as_text", """
SELECT string_agg('| ' || o_orderstatus || ' | ' || n || ' |', chr(10) ORDER BY o_orderstatus) AS markdown
FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)
""")
def a18(t):
    g = t("orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    line = F.concat(F.lit("| "), "o_orderstatus", F.lit(" | "), F.col("n").cast("string"), F.lit(" |"))
    return g.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderstatus", line.alias("l")))), lambda s: s["l"]), "\n").alias("markdown"))


@query("a18_report_sinks", """WITH g AS (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1) SELECT 'json' AS sink, '{"status":"' || status || '","n":' || n || '}' AS line FROM g UNION ALL SELECT 'csv', 'status,n' UNION ALL SELECT 'csv', status || ',' || n FROM g UNION ALL SELECT 'markdown', '| ' || status || ' | ' || n || ' |' FROM g UNION ALL SELECT 'markdown', unnest(['| status | n |', '| - | - |'])""")
def a18_sinks(t):
    """A report written as JSON lines, CSV with a header and a Markdown table, and the lines of all three files."""
    from tidemark.streaming.run import work_folder

    g, folder = t("orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")), work_folder(t.spark)
    I.write_report(g, folder, "status")
    lines = t.spark.read.format("text").load([f"{folder}/{k}" for k in ("json", "csv", "markdown")]).select(F.regexp_extract("_metadata.file_path", "/(json|csv|markdown)/[^/]*$", 1).alias("sink"), F.col("value").alias("line"))
    return lines


def annotation_files(t):
    """All conversations written as annotation XML, one collection each, with a file among them that is cut short."""
    from tidemark.streaming.run import work_folder

    quoted = lambda x: F.concat(F.lit("'"), x, F.lit("'"))
    lo = F.col("turn") * 10
    label = F.struct(F.col("role").alias("_LABEL"), quoted(F.col("text")).alias("_VALUE"), lo.alias("_START"), (lo + F.length("role")).alias("_END"))
    utt = F.struct(F.col("turn").cast("string").alias("_ID"), lo.alias("_START_FRAME"), (lo + 9).alias("_END_FRAME"), F.array(label).alias("NON-MANUAL"))
    tiers = t("conversations").groupBy("conv_id").agg(F.collect_list(utt).alias("UTTERANCE")).select(F.array(F.struct(quoted(F.col("conv_id").cast("string")).alias("_PARTICIPANT"), "UTTERANCE")).alias("SEGMENT-TIER"))
    folder = work_folder(t.spark)
    tiers.write.format("xml").option("rootTag", "EXPORT").option("rowTag", "COLLECTION").save(f"{folder}/good")
    cut = "<EXPORT><COLLECTION><SEGMENT-TIER PARTICIPANT='cut'><UTTERANCE ID='1'></SEGMENT-TIER></COLLECTION></EXPORT>"
    t.spark.createDataFrame([(cut,)], "value string").coalesce(1).write.text(f"{folder}/cut")
    return folder


#: Line ends and tabs in an attribute are blanks to an XML parser
_XV = "trim(regexp_replace(text, '[\n\r\t]', ' ', 'g'))"


@query("a03_xml_tiers", f"""
SELECT conv_id::VARCHAR AS participant, turn::VARCHAR AS utterance, turn * 10 AS start_frame, turn * 10 + 9 AS end_frame, role AS label,
{_XV} AS value, turn * 10 AS lo, turn * 10 + length(role) AS hi
FROM conversations
""")
def a03(t):
    """Conversations written as annotation XML, one collection each, and read back as label rows."""
    rows = I.read_xml_tiers(t.spark, annotation_files(t))
    return rows.where("not corrupt").select("participant", "utterance", "start_frame", "end_frame", "label", F.trim(F.regexp_replace("value", "[\n\r\t]", " ")).alias("value"), "lo", "hi")


@query("a04_annotation_corpus_report", f"""
WITH x AS (SELECT conv_id, turn, role, {_XV} AS v FROM conversations)
SELECT 1::BIGINT AS unparseable, count(DISTINCT conv_id) AS participants, count(DISTINCT (conv_id, turn)) AS utterances, count(*) AS labels, count(*)
  FILTER (WHERE role <> 'user') AS unmapped, count(DISTINCT CASE WHEN role <> 'user' THEN (role, v) END) AS unmapped_pairs,
  sum(length(role) + 1)::BIGINT AS frames
FROM x
""")
def a04(t):
    """One row over all files of a folder: what was read, which (label, value) pairs no rule maps, and how many
    files could not be parsed, which is counted and stops nothing."""
    rows = I.read_xml_tiers(t.spark, annotation_files(t)).withColumn("value", F.trim(F.regexp_replace("value", "[\n\r\t]", " ")))
    return I.annotation_report(rows, ["user"])


@query("a11_file_inventory")
def a11(t):
    """Inventory of the table files, verified against a manifest that expects one file more."""
    found = written(I.inventory(t.spark, t.sf_dir))  # files are read once
    manifest = found.union(found.limit(1).select(F.lit("gone.parquet"), "length", "sha256"))
    return I.verify(manifest, found)

"""Line dedup by site-relative frequency.

For each host the share of its pages that contain a line is computed over all pages; lines above ``ratio`` are
boilerplate of that host and are cut from its pages. A host of a few pages says little by itself, so its share is shrunk
towards the line's share of all other hosts' pages, as if ``evidence / ratio`` of those had been read with it: a line must be on many
pages of a large host, and on most of those of a small one unless it is common everywhere. Everything is built-in column
functions: distinct line hashes of a page are made inside the row, counted with map-side combine on (host, hash), and
the few hashes that exceed the ratio (at most the mean lines per page divided by the ratio, for any host) come back as
one array per host.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._base import Scratch, free_name, lookup_join

RATIO = 0.05
#: Pages that a line must be on beyond its share, unless other hosts' pages have it
EVIDENCE = 4.0


def _key(line):
    # two independent hashes: 96 bits for a line
    return F.struct(F.xxhash64(F.trim(line)).alias("a"), F.hash(F.trim(line)).alias("b"))


def boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, evidence: float = EVIDENCE) -> DataFrame:
    """Per host with any (null is a host of its own): ``_h``, its null-safe key, and ``_lines``, an array of the keys of
    lines above the ratio. Every row is a page, whatever its id."""
    p = pages.select(F.col(host).alias("_host"), F.split(F.col(text), "\n").alias("_l"))
    totals = p.groupBy("_host").agg(F.count("*").alias("_total"))
    lines = p.select("_host", F.explode(F.array_distinct(F.transform(F.filter("_l", lambda x: F.trim(x) != ""), _key))).alias("_k"))
    scratch, prior = Scratch(pages.sparkSession, "lines"), evidence / ratio
    sums = totals.agg(F.sum("_total").alias("n"), F.max("_total").alias("most")).first()
    all_pages, fewest_others = sums["n"] or 0, max(1, (sums["n"] or 0) - (sums["most"] or 0))
    counts = scratch.save(lines.groupBy("_host", "_k").agg(F.count("*").alias("_n")), "counts")
    # a line's pages anywhere; fewer than these can't lift the share of any host above the ratio
    corpus = counts.groupBy("_k").agg(F.sum("_n").alias("_g")).where(F.col("_g") * F.lit(1 + prior / fewest_others) > F.lit(ratio * prior * 0.999))
    counts = lookup_join(counts, scratch.save(corpus, "corpus"), ["_k"], "inner")
    # null-safe key for the join of two small tables; both are shuffled, never broadcast by a guess
    a, b = counts.withColumn("_h", F.struct(F.col("_host").isNull(), F.coalesce("_host", F.lit("")))), totals.select(F.struct(F.col("_host").isNull(), F.coalesce("_host", F.lit(""))).alias("_h"), "_total")
    elsewhere = F.when(F.col("_total") < all_pages, F.lit(float(prior)) * (F.col("_g") - F.col("_n")) / (F.lit(all_pages) - F.col("_total"))).otherwise(0.0)
    over = a.join(b.hint("shuffle_hash"), "_h").where(F.col("_n") + elsewhere > F.lit(float(ratio)) * (F.col("_total") + F.lit(float(prior))))
    return scratch.save(over.groupBy("_h").agg(F.collect_list("_k").alias("_lines")), "boilerplate")


def drop_site_lines(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, evidence: float = EVIDENCE) -> DataFrame:
    """Every row of ``pages`` with boilerplate lines of its host cut from ``text``, plus ``n_lines`` and ``n_dropped``.

    Lines are compared after trimming spaces; blank lines are kept and never counted. A null text stays null with 0
    lines; a text that is all boilerplate becomes empty; rows are never removed. Pages with a null host form one host.
    A line twice on a page counts one page and is cut twice; rows with one id are pages of their own. Lines and texts may
    be of any length. An empty table gives an empty result. Columns named ``n_lines`` and ``n_dropped`` are replaced.
    """
    base = pages.drop("n_lines", "n_dropped")
    own_key, own_lines = free_name(base, "_h"), free_name(base, "_lines")
    table = boilerplate(pages, host, text, ratio, evidence).select(F.col("_h").alias(own_key), F.col("_lines").alias(own_lines))
    joined = lookup_join(base.withColumn(own_key, F.struct(F.col(host).isNull(), F.coalesce(F.col(host).cast("string"), F.lit("")))), table, [own_key])
    lines = F.split(F.col(text), "\n")
    kept = F.filter(lines, lambda x: ~(F.array_contains(F.col(own_lines), _key(x)) & (F.trim(x) != "")))
    any_bad, none = F.col(own_lines).isNotNull(), F.lit(0).cast("long")
    n_lines = F.when(F.col(text).isNotNull(), F.size(lines)).otherwise(none).cast("long")
    n_dropped = F.when(any_bad & F.col(text).isNotNull(), F.size(lines) - F.size(kept)).otherwise(none).cast("long")
    new = F.when(any_bad, F.array_join(kept, "\n")).otherwise(F.col(text))
    return joined.withColumns({"n_lines": n_lines, "n_dropped": n_dropped}).withColumn(text, new).drop(own_key, own_lines)

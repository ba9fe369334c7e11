"""Aggregations and reports: vocabularies, agreement, contingency, latency, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.inference import chi_square_tail
from tidemark.operators.ranks import numbered


def vocabulary(tokens: DataFrame, token: str, min_count: int = 1) -> DataFrame:
    """Tokens with count and rank id (most frequent first, then by name).

    The ids are running counts over the distinct tokens, in parts by range of count, so a vocabulary of any size will do.
    """
    c = tokens.groupBy(F.col(token).alias("token")).agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    return numbered(c.withColumn("_down", -F.col("n")), ["_down", "token"]).drop("_down")


def kappa(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Cohen's kappa of two boolean ratings with a verdict; undefined where chance agreement is 1."""
    one = df.agg(F.count("*").alias("n"), F.count_if(a & b).alias("yy"), F.count_if(~a & ~b).alias("nn"), F.count_if(a).alias("a"), F.count_if(b).alias("b"))
    po = (F.col("yy") + F.col("nn")) / F.col("n")
    pa, pb = F.col("a") / F.col("n"), F.col("b") / F.col("n")
    pe = pa * pb + (1 - pa) * (1 - pb)
    k = F.when(pe < 1, (po - pe) / (1 - pe))
    return one.select("n", F.round(po, 6).alias("observed"), F.round(pe, 6).alias("chance"), F.round(k, 6).alias("kappa"), F.when(k.isNull(), "undefined").when(k < 0.1, "useless").when(k < 0.4, "weak").otherwise("usable").alias("verdict"))


def fleiss_kappa(ratings: DataFrame, item: str, category: str) -> DataFrame:
    """Fleiss' kappa for items rated by the same number of raters."""
    c = ratings.groupBy(item, category).agg(F.count("*").alias("c"))
    per = c.groupBy(item).agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("q"))
    p = per.agg(F.avg((F.col("q") - F.col("m")) / (F.col("m") * (F.col("m") - 1))).alias("po"), F.sum("m").alias("total"), F.count("*").alias("items"))
    cat = ratings.groupBy(category).agg(F.count("*").alias("c"))
    pe = cat.crossJoin(F.broadcast(p)).agg(F.sum(F.pow(F.col("c") / F.col("total"), F.lit(2))).alias("pe"), F.first("po").alias("po"), F.first("items").alias("items"))
    return pe.select("items", F.round("po", 6).alias("observed"), F.round("pe", 6).alias("chance"), F.round((F.col("po") - F.col("pe")) / (1 - F.col("pe")), 6).alias("kappa"))


def contingency(df: DataFrame, a: Column, b: Column, by: list[str] | None = None) -> DataFrame:
    """2 x 2 counts, agreement, lift, chi-square without correction and its p value, of all rows or of every group. Where a
    row or column of the table is empty, lift, chi-square and p are NULL."""
    c = df.groupBy(*(by or [])).agg(F.count_if(a & b).alias("n11"), F.count_if(a & ~b).alias("n10"), F.count_if(~a & b).alias("n01"), F.count_if(~a & ~b).alias("n00"))
    n = F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")
    ra, rb = F.col("n11") + F.col("n10"), F.col("n11") + F.col("n01")
    det = F.col("n11") * F.col("n00") - F.col("n10") * F.col("n01")
    den = F.nullif(ra.cast("double") * rb * (n - ra) * (n - rb), F.lit(0.0))
    some = lambda x: F.nullif(x, F.lit(0))
    chi2 = n * F.pow(det.cast("double"), F.lit(2)) / den
    own = c.withColumn("_chi2", chi2)
    return own.select(
        *(by or []), "n11", "n10", "n01", "n00", n.alias("n"), F.round((F.col("n11") + F.col("n00")) / some(n), 6).alias("agreement"), F.round(F.col("n11") * n / some(ra * rb), 6).alias("lift"),
        F.round("_chi2", 6).alias("chi2"), chi_square_tail(F.col("_chi2")).alias("p"),
    )


def readiness(declared: DataFrame, found: DataFrame) -> DataFrame:
    """``name, state, files, probed, decoded, owner, blocker, gate_open`` for every declared resource.

    ``declared(name, licensed, owner, required, expected)`` says what there should be, ``found(name, files, chars, broken,
    probed, decoded)`` what was counted and how many of the probed files could be read. The first rule that holds is the
    state: blocked, missing, undecodable, corrupt, short, else ready. The gate is one for the table: open if every required
    resource is ready and every blocker has an owner.
    """
    j = declared.join(found.withColumn("_seen", F.lit(True)).hint("merge"), "name", "left")
    short = (F.col("chars") < 0.98 * F.col("expected")) & (F.col("expected") - F.col("chars") > 5000)
    state = F.when(~F.col("licensed"), "blocked").when(F.col("_seen").isNull(), "missing").when(F.col("decoded") < F.col("probed"), "undecodable").when(F.col("broken") > 3, "corrupt").when(short, "short").otherwise("ready")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    s = j.select("name", state.alias("state"), "owner", "required", none("files"), none("probed"), none("decoded"))
    lost = F.concat((F.col("probed") - F.col("decoded")).cast("string"), F.lit(" of "), F.col("probed").cast("string"), F.lit(" unreadable"))
    s = s.withColumn("blocker", F.when(F.col("state") == "blocked", "terms not established").when(F.col("state") == "missing", "nothing found").when(F.col("state") == "undecodable", lost))
    waiting, unowned = F.count_if(F.col("required") & (F.col("state") != "ready")), F.count_if(F.col("blocker").isNotNull() & F.col("owner").isNull())
    gate = s.agg(((waiting == 0) & (unowned == 0)).alias("gate_open"))
    return s.crossJoin(F.broadcast(gate)).select("name", "state", "files", "probed", "decoded", "owner", "blocker", "gate_open")  # one row


def by_levels(df: DataFrame, levels: list[str], *aggs: Column) -> DataFrame:
    """Aggregates at every prefix of the levels and in total, with the depth of each row."""
    return df.rollup(*levels).agg(*aggs, F.grouping_id().alias("_g")).withColumn("depth", (F.lit(len(levels)) - F.bit_count("_g")).cast("int")).drop("_g")

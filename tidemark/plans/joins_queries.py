"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import joins as J
from tidemark.operators import series as S
from tidemark.plans.registry import query
from tidemark.plans.windows_queries import EM, EV, em, ev, r6, windowed


@query("c01_audited_join", """
WITH k AS (SELECT coalesce(d.doc_id, l.doc_id) AS k, d.doc_id AS a, l.doc_id AS b FROM (SELECT doc_id FROM documents WHERE doc_id % 10 <> 0) d FULL
  JOIN labels l ON d.doc_id = l.doc_id)
SELECT count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS matched, count(*) FILTER (WHERE b IS NULL) AS left_only, count(*) FILTER
  (WHERE a IS NULL) AS right_only, round(count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) / count(*) FILTER (WHERE a IS NOT NULL)::DOUBLE, 6)
  AS share
FROM k
""")
def c01(t):
    return J.audit_join(t("documents").where("doc_id % 10 <> 0"), t("labels"), "doc_id")


@query("c01_audited_join_whole", """
WITH k AS (SELECT d.doc_id AS a, l.doc_id AS b FROM (SELECT doc_id FROM documents) d FULL JOIN labels l ON d.doc_id = l.doc_id)
SELECT count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS matched, count(*) FILTER (WHERE b IS NULL) AS left_only, count(*) FILTER
  (WHERE a IS NULL) AS right_only, round(count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) / count(*) FILTER (WHERE a IS NOT NULL)::DOUBLE, 6)
  AS share
FROM k
""")
def c01_whole(t):
    """All documents and all labels: the unmatched counts are those of the tables."""
    return J.audit_join(t("documents"), t("labels"), "doc_id")


@query("c02_lookup_with_default", """
SELECT d.doc_id, coalesce(quality, 0) AS quality, CASE WHEN l.doc_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS confidence
FROM documents d
LEFT JOIN labels l USING (doc_id)
""")
def c02(t):
    j = t("documents").select("doc_id").join(t("labels").withColumn("c", F.lit(1.0)).hint("shuffle_hash"), "doc_id", "left")
    return j.select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("c", F.lit(0.0)).alias("confidence"))


SPANS = """
sp AS (SELECT k, greatest(0, CAST(floor(i - v / 40.0) AS BIGINT)) AS lo, least(n - 1, CAST(ceil(i + v / 40.0) AS BIGINT)) AS hi, i AS id FROM
  (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM s) WHERE e = 'error')
"""


def spans(t):
    """A span of frames around each error, widened outward and clipped to the series."""
    d = ev(t).withColumn("n", F.count(F.lit(1)).over(S.whole())).where("e = 'error'")
    lo, hi = F.floor(F.col("i") - F.col("v") / 40.0), F.ceil(F.col("i") + F.col("v") / 40.0)
    return d.select("k", F.greatest(F.lit(0), lo).cast("long").alias("lo"), F.least(F.col("n") - 1, hi).cast("long").alias("hi"), F.col("i").alias("id"))


@query("c03_interval_mask", f"WITH {EV}, {SPANS} SELECT s.k, s.i, EXISTS (SELECT 1 FROM sp WHERE sp.k = s.k AND s.i BETWEEN lo AND hi) AS inside FROM s")
def c03(t):
    rows = ev(t).select("k", "i")
    hit = J.interval_rows(rows, spans(t), 64).select("k", "i").distinct().withColumn("inside", F.lit(True))
    return rows.join(hit.hint("merge"), ["k", "i"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


@query("c04_span_mask", f"""
WITH {EV},
b AS (SELECT k, min(i) AS lo, max(i) AS hi FROM s WHERE e = 'signup' GROUP BY k)
SELECT s.k, i, coalesce(i BETWEEN lo AND hi, false) AS inside
FROM s
LEFT JOIN b USING (k)
""")
def c04(t):
    at = F.when(F.col("e") == "signup", F.col("i"))
    w = S.whole()
    return ev(t).select("k", "i", F.coalesce(F.col("i").between(F.min(at).over(w), F.max(at).over(w)), F.lit(False)).alias("inside"))


@query("c05_slice_join", f"""
WITH {EV},
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
c AS (SELECT k, i AS id, i + 1 AS a, i + 1 + CAST(floor(v / 4) AS BIGINT) AS b FROM s WHERE e = 'click')
SELECT c.k, c.id, CASE WHEN b > n THEN 'overshoot' WHEN b - a < 3 THEN 'short' ELSE 'ok' END AS reason, CASE WHEN b <= n AND b - a >= 3 THEN
  (SELECT count(*) FROM s WHERE s.k = c.k AND s.i + 1 BETWEEN a AND b) ELSE 0 END AS frames
FROM c
JOIN n USING (k)
""")
def c05(t):
    d = ev(t).withColumn("n", F.count(F.lit(1)).over(S.whole()))
    c = d.where("e = 'click'").select("k", F.col("i").alias("id"), "n", (F.col("i") + 1).alias("lo"), (F.col("i") + 1 + F.floor(F.col("v") / 4)).cast("long").alias("hi"))
    c = c.withColumn("reason", F.when(F.col("hi") > F.col("n"), "overshoot").when(F.col("hi") - F.col("lo") < 3, "short").otherwise("ok"))
    rows = ev(t).select("k", (F.col("i") + 1).alias("i"))
    got = J.interval_rows(rows, c.where("reason = 'ok'").select("k", "id", "lo", "hi"), 64).groupBy("k", "id").agg(F.count("*").alias("frames"))
    return c.select("k", "id", "reason").join(got.hint("merge"), ["k", "id"], "left").withColumn("frames", F.coalesce("frames", F.lit(0)))


WINDOWS = """
wn AS (SELECT wd.k, CAST(lo // 8 AS BIGINT) AS win, avg(v) AS amp, avg(p) AS pace, avg(CASE WHEN e = 'error' THEN 1.0 ELSE 0 END) AS y,
  avg(CASE WHEN e = 'signup' THEN 1.0 ELSE 0 END) >= 0.25 AS marked FROM (SELECT k, unnest(range(0, n - 15, 8)) AS lo FROM
  (SELECT k, count(*) AS n FROM s GROUP BY k) WHERE n >= 16) wd JOIN s ON s.k = wd.k AND s.i >= lo AND s.i < lo + 16 GROUP BY wd.k, lo)
"""
PAIRS = """
sd AS (SELECT stddev_pop(amp) AS sa, stddev_pop(pace) AS sp FROM wn),
pr AS (SELECT a.k, a.win AS c, b.win AS d, round(pow((a.amp - b.amp) / sa, 2) + pow((a.pace - b.pace) / sp, 2), 12) AS d2, a.y - b.y AS diff FROM wn a
  JOIN wn b ON a.k = b.k AND a.marked AND NOT b.marked JOIN sd ON true WHERE pow((a.amp - b.amp) / sa, 2) + pow((a.pace - b.pace) / sp, 2) <= 1),
mt AS (SELECT k, c, arg_min(d, (d2, d)) AS d, min(d2) AS d2, arg_min(diff, (d2, d)) AS diff FROM pr GROUP BY k, c)
"""


def audit_windows(t):
    """Windows of a series with covariates, an outcome share and a marker flag."""
    g = windowed(ev(t), 16, 8).groupBy("k", F.col("win").cast("long").alias("win"))
    return g.agg(F.avg("v").alias("amp"), F.avg("p").alias("pace"), F.avg((F.col("e") == "error").cast("double")).alias("y"), (F.avg((F.col("e") == "signup").cast("double")) >= 0.25).alias("marked"))


def matched(t, w=None):
    w = audit_windows(t) if w is None else w
    return J.nearest_match(w.where("marked"), w.where("not marked"), "k", ["amp", "pace"], 1.0, "win")


@query("c06_nearest_match_caliper", f"WITH {EV}, {WINDOWS}, {PAIRS} SELECT k, c AS \"case\", d AS control, round(sqrt(d2), 5) AS dist FROM mt")
def c06(t):
    return matched(t).select("k", "case", "control", F.round("dist", 5).alias("dist"))


@query("c07_two_version_compare", f"""
WITH {EM},
b AS (SELECT k, i, list_transform(x, lambda e: CASE WHEN i % 5 = 0 THEN e + 0.01 ELSE e END) AS x FROM m WHERE i % 17 <> 3),
j AS (SELECT m.k, m.i, b.k IS NULL AS gone, list_max(list_transform(list_zip(m.x, b.x), lambda z: abs(z[1] - z[2]))) AS ch FROM m LEFT JOIN b ON b.k =
  m.k AND b.i = m.i)
SELECT k, count(*) AS n, count(*) FILTER (WHERE gone) AS missing, count(*) FILTER (WHERE ch > 0) AS changed, round(max(ch), 6) AS largest
FROM j
GROUP BY k
""")
def c07(t):
    a = em(t).select("k", "i", "x")
    b = a.where("i % 17 <> 3").select("k", "i", F.when(F.col("i") % 5 == 0, F.transform("x", lambda e: e + 0.01)).otherwise(F.col("x")).alias("y"))
    ch = F.array_max(F.zip_with("x", "y", lambda p, q: F.abs(p - q)))
    j = a.join(b.hint("merge"), ["k", "i"], "full_outer").select("k", F.col("y").isNull().alias("gone"), F.when(F.col("y").isNotNull(), ch).alias("ch"))
    return j.groupBy("k").agg(F.count("*").alias("n"), F.count_if("gone").alias("missing"), F.count_if(F.col("ch") > 0).alias("changed"), r6(F.max("ch"), "largest"))


@query("c08_coincident_slots", f"""
WITH {EM} SELECT k, count(*) AS n, count(*) FILTER (WHERE abs(x[1] - x[2]) + abs(x[3] - x[4]) < 0.1) AS coincident
FROM m
WHERE x[1] <> 0 AND x[2] <> 0
GROUP BY k
""")
def c08(t):
    x = F.col("x")
    d = em(t).where((x[0] != 0) & (x[1] != 0))
    return d.groupBy("k").agg(F.count("*").alias("n"), F.count_if(F.abs(x[0] - x[1]) + F.abs(x[2] - x[3]) < 0.1).alias("coincident"))


_NUMS = r"nm AS (SELECT DISTINCT doc_id, CAST(unnest(regexp_extract_all(text, '\d+(?:\.\d+)?')) AS DOUBLE) AS num FROM documents)"


@query("c09_citation_trace", f"""
WITH {_NUMS} SELECT doc_id, num, EXISTS (SELECT 1 FROM events WHERE value > 0 AND abs(value - num) <= 0.005 * num) AND num > 0 AS matched
FROM nm
""")
def c09(t):
    nums = t("documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\d+(?:\.\d+)?"), 0)).alias("num")).select("doc_id", F.col("num").cast("double").alias("num")).distinct()
    return J.within_relative(nums, t("events"), "num", "value", 0.005, F.lit(True))


@query("c10_as_of_latest_state", """
SELECT e.event_id, (SELECT s.value FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'signup' AND s.ts <= e.ts ORDER BY s.ts DESC,
  s.event_id DESC LIMIT 1) AS state
FROM events e
WHERE e.event_type = 'purchase'
""")
def c10(t):
    e = t("events")
    rows = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    states = e.where("event_type = 'signup'").select("user_id", "ts", F.col("value").alias("state"))
    return J.as_of(rows, states, "user_id", "ts", "state").select("event_id", "state")


@query("c11_semi_and_anti", """
SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS usable
FROM customer
WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 0)
""")
def c11(t):
    c = t("customer").join(F.broadcast(t("nation").where("n_regionkey = 0")), F.col("c_nationkey") == F.col("n_nationkey"), "left_anti")  # nations are fixed
    used = t("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("usable", F.lit(True))
    return c.select("c_custkey").join(used.hint("merge"), "c_custkey", "left").withColumn("usable", F.coalesce("usable", F.lit(False)))


@query("c12_pair_arms_into_trials", """
SELECT conv_id, list(turn ORDER BY turn) AS arms, CASE WHEN count(*) = 2 THEN 'ok' WHEN count(*) < 2 THEN 'single' ELSE 'extra' END AS status
FROM conversations
WHERE role = 'assistant'
GROUP BY 1
""")
def c12(t):
    g = t("conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("arms"))
    return g.withColumn("status", F.when(F.size("arms") == 2, "ok").when(F.size("arms") < 2, "single").otherwise("extra"))


@query("u01_selected_intervals", f"""
WITH {EV},
{SPANS} SELECT s.k, s.i, count(*) AS spans
FROM s
JOIN sp ON sp.k = s.k AND s.i BETWEEN lo AND hi
WHERE hi - lo >= 2 AND sp.id % 3 <> 0
GROUP BY 1, 2
""")
def u01(t):
    """Rows inside the intervals that a predicate, any column expression, selects."""
    chosen = (F.col("hi") - F.col("lo") >= 2) & (F.col("id") % 3 != 0)
    return J.interval_rows(ev(t).select("k", "i"), spans(t), 64, select=chosen).groupBy("k", "i").agg(F.count("*").alias("spans"))

"""Aggregation and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import reports as R
from tidemark.operators import series as S
from tidemark.operators.inference import spearman
from tidemark.operators.quantiles import exact_quantiles
from tidemark.plans.registry import query
from tidemark.plans.scalars_queries import _TOK, TYPES
from tidemark.plans.windows_queries import EM, EV, em, ev, r6
from tidemark.sources.ingest import first_of_each


@query("d01_status_counts", """
SELECT o_orderstatus AS status, count(*) AS n, count(DISTINCT CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey END) AS groups
FROM orders
GROUP BY 1
""")
def d01(t):
    return t("orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_custkey"))).alias("groups"))


@query("d02_zero_filled_distribution", f"""
WITH c(t) AS (SELECT unnest({TYPES + ['other']!r})),
u AS (SELECT user_id % 3 AS g, event_type FROM events WHERE value > 200)
SELECT g.g, t AS category, (SELECT count(*) FROM u WHERE u.g = g.g AND u.event_type = t) AS n
FROM (SELECT DISTINCT user_id % 3 AS g FROM events) g, c
""")
def d02(t):
    e = t("events").select((F.col("user_id") % 3).alias("g"), F.col("event_type").alias("category"), (F.col("value") > 200).alias("on_"))
    grid = e.select("g").distinct().withColumn("category", F.explode(F.array(*[F.lit(x) for x in [*TYPES, "other"]])))
    n = e.groupBy("g", "category").agg(F.count_if("on_").alias("n"))
    return grid.join(n.hint("merge"), ["g", "category"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("d03_one_row_corpus_report", """
SELECT count(*) AS n, count(DISTINCT event_type) AS types, count(DISTINCT user_id) AS groups, round(avg(CASE WHEN event_type <> 'signup' THEN 1.0 ELSE
  0 END), 6) AS mapped, (SELECT list(user_id ORDER BY n DESC, user_id) FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'signup'
  GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10)) AS top_unmapped
FROM events
""")
def d03(t):
    e = t("events")
    top = e.where("event_type = 'signup'").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)
    lst = top.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.negative("n").alias("m"), "user_id"))), lambda s: s["user_id"]).alias("top_unmapped"))
    one = e.agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("types"), F.count_distinct("user_id").alias("groups"), r6(F.avg((F.col("event_type") != "signup").cast("double")), "mapped"))
    return one.crossJoin(F.broadcast(lst))  # one row each


_WORDS = _TOK + """
,
w AS (SELECT conv_id, turn, unnest(tk) AS token FROM k),
v AS (SELECT token, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS id FROM w GROUP BY 1 HAVING count(*) >= 2)
"""


def words(t, places: bool = False):
    """Tokens of all texts, with their places if asked."""
    tk = C.tokens_without_asides(F.regexp_replace("text", r"[()\[\]]", " "), "que")
    one = F.posexplode(tk).alias("i", "token") if places else F.explode(tk).alias("token")
    return t("conversations").select("conv_id", "turn", one)


@query("d04_vocabulary_rank_ids", f"""
WITH {_TOK},
w AS (SELECT conv_id, turn, token FROM (SELECT conv_id, turn, unnest(tk) AS token FROM k)),
v AS (SELECT token, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, token) - 1 AS id FROM w GROUP BY 1 HAVING count(*) >= 2)
SELECT conv_id, turn, count(*) AS n, sum(CASE WHEN id IS NULL THEN 1 ELSE 0 END)::BIGINT AS oov, max(coalesce(id, -1)) AS top
FROM w
LEFT JOIN v USING (token)
GROUP BY 1, 2
""")
def d04(t):
    w = words(t)
    v = R.vocabulary(w, "token", 2)
    j = w.join(v.select("token", "id").hint("merge"), "token", "left")
    return j.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.count_if(F.col("id").isNull()).alias("oov"), F.max(F.coalesce("id", F.lit(-1))).alias("top"))


@query("d05_counts_per_participant", "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{x}') AS {x}" for x in TYPES) + " FROM events GROUP BY 1")
def d05(t):
    return t("events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == x).alias(x) for x in TYPES])


@query("d06_alignment_report", f"""
WITH {EV},
c AS (SELECT k, i + CAST(floor(v / 4) AS BIGINT) AS hi, count(*) OVER (PARTITION BY k) AS n, v, CASE WHEN least(abs(v - 24), abs(v - 30), abs(v - 60))
  = abs(v - 24) THEN 24 WHEN least(abs(v - 30), abs(v - 60)) = abs(v - 30) THEN 30 ELSE 60 END AS rate FROM s)
SELECT rate, count(*) AS n, count(*) FILTER (WHERE hi < n) AS in_range, count(*) FILTER (WHERE hi >= n) AS overshoot, round(median(v / rate), 6) AS
  ratio, avg(CASE WHEN hi < n THEN 1.0 ELSE 0 END) >= 0.8 AS aligned
FROM c
GROUP BY 1
""")
def d06(t):
    v = F.col("v")
    gap = lambda r: F.abs(v - r)
    rate = F.when(F.least(gap(24), gap(30), gap(60)) == gap(24), 24).when(F.least(gap(30), gap(60)) == gap(30), 30).otherwise(60)
    d = ev(t).select(rate.alias("rate"), "v", (F.col("i") + F.floor(v / 4)).alias("hi"), F.count(F.lit(1)).over(S.whole()).alias("m"))
    ok = F.col("hi") < F.col("m")
    g = d.groupBy("rate").agg(F.count("*").alias("n"), F.count_if(ok).alias("in_range"), F.count_if(~ok).alias("overshoot"), (F.avg(ok.cast("double")) >= 0.8).alias("aligned"))
    mid = exact_quantiles(d, ["rate"], v / F.col("rate"), [0.5])
    return g.join(mid.hint("merge"), "rate").select("rate", "n", "in_range", "overshoot", r6(F.col("q")[0], "ratio"), "aligned")


@query("d07_detection_gate", f"""
WITH {EM},
q AS (SELECT k, j, stddev_pop(x[j]) AS sd FROM m, range(1, 65) r(j) GROUP BY k, j),
g AS (SELECT k, count(*) FILTER (WHERE sd > 0.12) AS active, max(sd) AS top FROM q GROUP BY k)
SELECT k, active, round(top, 6) AS top, concat_ws(',', CASE WHEN active < 32 THEN 'few_active' END, CASE WHEN top < 0.15 THEN 'flat' END) AS reasons
FROM g
""")
def d07(t):
    q = em(t).select("k", F.posexplode("x").alias("j", "e")).groupBy("k", "j").agg(F.stddev_pop("e").alias("sd"))
    g = q.groupBy("k").agg(F.count_if(F.col("sd") > 0.12).alias("active"), F.max("sd").alias("top"))
    return g.select("k", "active", r6("top", "top"), F.concat_ws(",", F.when(F.col("active") < 32, "few_active"), F.when(F.col("top") < 0.15, "flat")).alias("reasons"))


@query("d08_dead_columns", f"""
WITH {EM},
q AS (SELECT k, j, stddev_pop(CASE WHEN j IN (3, 9) THEN 1.0::DOUBLE ELSE x[j] END) AS sd FROM m, range(1, 65) r(j) GROUP BY k, j)
SELECT CAST(j - 1 AS INTEGER) AS dim, count(*) FILTER (WHERE sd = 0) AS dead_in
FROM q
GROUP BY j
HAVING count(*) FILTER (WHERE sd = 0) > 0
""")
def d08(t):
    e = em(t).select("k", F.posexplode("x").alias("dim", "e")).withColumn("e", F.when(F.col("dim").isin(2, 8), 1.0).otherwise(F.col("e")))
    q = e.groupBy("k", "dim").agg((F.min("e") == F.max("e")).alias("dead"))  # merged deviations of equal values need not be 0
    return q.groupBy("dim").agg(F.count_if("dead").alias("dead_in")).where("dead_in > 0")


@query("d09_usable_band", f"""
WITH {EV},
c AS (SELECT e, k, avg(CASE WHEN v > 100 THEN 1.0 ELSE 0 END) AS rate FROM s GROUP BY 1, 2)
SELECT e AS marker, round(avg(rate), 6) AS firing, round(avg(CASE WHEN rate > 0 THEN 1.0 ELSE 0 END), 6) AS prevalence, CASE WHEN avg(rate) > 0.6 THEN
  'degenerate' WHEN avg(rate) < 0.05 THEN 'too_rare' ELSE 'usable' END AS band
FROM c
GROUP BY 1
""")
def d09(t):
    c = ev(t).groupBy("e", "k").agg(F.avg((F.col("v") > 100).cast("double")).alias("rate"))
    g = c.groupBy(F.col("e").alias("marker")).agg(F.avg("rate").alias("f"), r6(F.avg((F.col("rate") > 0).cast("double")), "prevalence"))
    return g.select("marker", r6("f", "firing"), "prevalence", F.when(F.col("f") > 0.6, "degenerate").when(F.col("f") < 0.05, "too_rare").otherwise("usable").alias("band"))


@query("d10_blindness", """
WITH q AS (SELECT event_type AS e, avg(CASE WHEN value < 10 THEN 1.0 ELSE 0 END) AS z, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr,
  median(value) AS m FROM events GROUP BY 1)
SELECT e AS signal, round(z, 6) AS zero_fraction, round(iqr, 6) AS iqr, z > 0.6 OR iqr < 1e-9 OR iqr < 0.05 * m AS blind
FROM q
""")
def d10(t):
    e = t("events").withColumnRenamed("event_type", "signal")
    z = e.groupBy("signal").agg(F.avg((F.col("value") < 10).cast("double")).alias("z"))
    p = exact_quantiles(e, ["signal"], F.col("value"), [0.25, 0.5, 0.75], "p")
    q = z.join(p.hint("merge"), "signal").select("signal", "z", (F.col("p")[2] - F.col("p")[0]).alias("q"), F.col("p")[1].alias("m"))
    return q.select("signal", r6("z", "zero_fraction"), r6("q", "iqr"), ((F.col("z") > 0.6) | (F.col("q") < 1e-9) | (F.col("q") < 0.05 * F.col("m"))).alias("blind"))


@query("d11_class_means_by_flag", f"""
WITH {EM} SELECT CAST(j - 1 AS INTEGER) AS dim, round(avg(x[j]) FILTER (WHERE k < 5), 6) AS mean_on, round(avg(x[j]) FILTER (WHERE k >= 5), 6) AS
  mean_off, count(*) FILTER (WHERE k < 5) AS n_on
FROM m, range(1, 65) r(j)
GROUP BY j
""")
def d11(t):
    e = em(t).select((F.col("k") < 5).alias("on_"), F.posexplode("x").alias("dim", "e"))
    return e.groupBy("dim").agg(r6(F.avg(F.when(F.col("on_"), F.col("e"))), "mean_on"), r6(F.avg(F.when(~F.col("on_"), F.col("e"))), "mean_off"), F.count_if("on_").alias("n_on"))


_LAB = """
lj AS (SELECT l.doc_id, lang, source, n_chars, quality, toxic, quality = 1 AS q, toxic = 1 AS x, regexp_matches(text, '[#$%&*]{3}|!!|\\|') AS r FROM
  labels l JOIN documents USING (doc_id))
"""


def labelled(t):
    d = t("documents").select("doc_id", "lang", "source", "n_chars", F.col("text").rlike(r"[#$%&*]{3}|!!|\|").alias("r"))
    return t("labels").join(d.hint("shuffle_hash"), "doc_id").withColumns({"q": F.col("quality") == 1, "x": F.col("toxic") == 1})


@query("d12_contingency", f"""
WITH {_LAB},
c AS (SELECT count(*) FILTER (WHERE q AND r) AS n11, count(*) FILTER (WHERE q AND NOT r) AS n10, count(*) FILTER (WHERE NOT q AND r) AS n01, count(*)
  FILTER (WHERE NOT q AND NOT r) AS n00, count(*) AS n FROM lj)
SELECT n11, n10, n01, n00, round((n11 + n00) / n::DOUBLE, 6) AS agreement, round(n11 * n / ((n11 + n10) * (n11 + n01))::DOUBLE, 6) AS lift,
  round(n * pow(n11 * n00 - n10 * n01, 2) / ((n11 + n10)::DOUBLE * (n11 + n01) * (n01 + n00) * (n10 + n00)), 6) AS chi2
FROM c
""")
def d12(t):
    return R.contingency(labelled(t), F.col("q"), F.col("r")).drop("n", "p")


D12_SQL = f"""
WITH {_LAB},
c AS (SELECT lang, count(*) FILTER (WHERE q AND r) AS n11, count(*) FILTER (WHERE q AND NOT r) AS n10, count(*) FILTER (WHERE NOT q AND r) AS n01, count(*) FILTER (WHERE NOT q AND NOT r) AS n00, count(*) AS n FROM lj GROUP BY lang),
x AS (SELECT lang, n, n * pow(n11 * n00 - n10 * n01, 2) / nullif((n11 + n10)::DOUBLE * (n11 + n01) * (n01 + n00) * (n10 + n00), 0) AS chi2 FROM c),
z AS (SELECT *, chi2 / 2 AS h FROM x)
SELECT lang, n, round(chi2, 6) AS chi2,
  round(CASE WHEN h > 25 THEN 0 ELSE 1 - 2 / sqrt(pi()) * exp(-h) * sqrt(h) * (1 + list_sum([exp(i * ln(2 * h) - list_sum([ln(2 * j + 1) FOR j IN range(1, i + 1)])) FOR i IN range(1, 120)])) END, 6) AS p
FROM z
"""


@query("d12_contingency_with_p", D12_SQL)
def d12_p(t):
    """Chi-square of quality against symbols in each language, with its p value."""
    return R.contingency(labelled(t), F.col("q"), F.col("r"), ["lang"]).select("lang", "n", r6("chi2", "chi2"), r6("p", "p"))


@query("d13_cohens_kappa", f"""
WITH {_LAB},
c AS (SELECT count(*) AS n, avg(CASE WHEN q = NOT r THEN 1.0 ELSE 0 END) AS po, avg(q::INT) AS pa, avg((NOT r)::INT) AS pb FROM lj),
e AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM c)
SELECT n, round(po, 6) AS observed, round(pe, 6) AS chance, round((po - pe) / (1 - pe), 6) AS kappa, CASE WHEN (po - pe) / (1 - pe) < 0.1 THEN
  'useless' WHEN (po - pe) / (1 - pe) < 0.4 THEN 'weak' ELSE 'usable' END AS verdict
FROM e
""")
def d13(t):
    return R.kappa(labelled(t), F.col("q"), ~F.col("r"))


@query("d14_fleiss_kappa", f"""
WITH {_LAB},
rt AS (SELECT doc_id, q AS y FROM lj UNION ALL SELECT doc_id, NOT r FROM lj UNION ALL SELECT doc_id, NOT x FROM lj),
it AS (SELECT doc_id, count(*) FILTER (WHERE y) AS a, count(*) FILTER (WHERE NOT y) AS b FROM rt GROUP BY 1),
z AS (SELECT count(*) AS items, avg((a * a + b * b - 3) / 6.0::DOUBLE) AS po, pow(sum(a) / (3.0::DOUBLE * count(*)), 2) +
  pow(sum(b) / (3.0::DOUBLE * count(*)), 2) AS pe FROM it)
SELECT items, round(po, 6) AS observed, round(pe, 6) AS chance, round((po - pe) / (1 - pe), 6) AS kappa
FROM z
""")
def d14(t):
    d = labelled(t).select("doc_id", F.explode(F.array("q", ~F.col("r"), ~F.col("x"))).alias("y"))
    return R.fleiss_kappa(d, "doc_id", "y")


_FACTS = "CASE WHEN count(*) < 100 THEN 'too_few_samples' WHEN n.noise > 0.5 THEN 'noisy' WHEN quantile_cont(value, 0.99) > 10 * median(value) THEN 'long_tail' ELSE 'reportable' END"


@query("d15_latency_summary", f"""
WITH r AS (SELECT event_type AS e, avg(value) AS m FROM events GROUP BY event_type, user_id),
n AS (SELECT e, stddev_pop(m) / avg(m) AS noise FROM r GROUP BY 1)
SELECT event_type AS module, count(*) AS samples, min(value) AS fastest, round(avg(value), 6) AS mean, round(median(value), 6) AS p50,
  round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(1000 / avg(value), 6) AS rate, round(n.noise, 6) AS
  noise,
{_FACTS} AS verdict
FROM events
JOIN n ON n.e = event_type
GROUP BY event_type, n.noise
""")
def d15(t):
    e = t("events").withColumnRenamed("event_type", "module")
    noise = e.groupBy("module", "user_id").agg(F.avg("value").alias("m")).groupBy("module").agg((F.stddev_pop("m") / F.avg("m")).alias("noise"))
    s = e.groupBy("module").agg(F.count("*").alias("samples"), F.min("value").alias("fastest"), F.avg("value").alias("a"))
    s = s.join(exact_quantiles(e, ["module"], F.col("value"), [0.5, 0.95, 0.99], "p").hint("merge"), "module")
    p = F.col("p")
    verdict = F.when(F.col("samples") < 100, "too_few_samples").when(F.col("noise") > 0.5, "noisy").when(p[2] > 10 * p[0], "long_tail").otherwise("reportable")
    return s.join(noise.hint("merge"), "module").select("module", "samples", "fastest", r6("a", "mean"), *[r6(p[i], n) for i, n in enumerate(("p50", "p95", "p99"))], r6(1000 / F.col("a"), "rate"), r6("noise", "noise"), verdict.alias("verdict"))


_SHARES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


@query("d16_percentiles_and_extremes", f"""
SELECT l_returnflag AS flag, list_transform(quantile_cont(l_extendedprice, {_SHARES!r}), lambda x: round(x, 6)) AS percentiles,
  list_sort(list(l_extendedprice ORDER BY l_extendedprice))[1:5] AS lowest, list_reverse_sort(list(l_extendedprice ORDER BY l_extendedprice
  DESC))[1:5] AS highest
FROM lineitem
GROUP BY 1
""")
def d16_extremes(t):
    """Percentiles of a group, and its five least and greatest values, of which each task keeps its own five."""
    d = t("lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("x"), "l_orderkey", "l_linenumber")
    p = exact_quantiles(d, ["flag"], F.col("x"), _SHARES).select("flag", F.transform("q", lambda x: F.round(x, 6)).alias("percentiles"))
    low = first_of_each(d, "flag", "x", 5).groupBy("flag").agg(F.array_sort(F.collect_list("x")).alias("lowest"))
    high = first_of_each(d.withColumn("y", -F.col("x")), "flag", "y", 5).groupBy("flag").agg(F.reverse(F.array_sort(F.collect_list("x"))).alias("highest"))
    return p.join(low.hint("merge"), "flag").join(high.hint("merge"), "flag")


@query("d16_fixed_bin_histogram", """
SELECT CAST(greatest(0, least(11, floor((l_quantity - 0) / 5) + 1)) AS BIGINT) AS bin, count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi
FROM lineitem
GROUP BY 1
""")
def d16(t):
    return t("lineitem").groupBy(F.width_bucket("l_quantity", F.lit(0.0), F.lit(50.0), F.lit(10)).alias("bin")).agg(F.count("*").alias("n"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))


@query("d17_within_between_spread", f"""
WITH {EM},
g AS (SELECT k, j, avg(x[j]) AS mu, max(x[j]) - min(x[j]) AS within FROM m, range(1, 65) r(j) GROUP BY k, j),
b AS (SELECT j, max(mu) - min(mu) AS between FROM g GROUP BY j)
SELECT CAST(g.j - 1 AS INTEGER) AS dim, round(avg(within), 6) AS within, round(any_value(between), 6) AS between,
  round(any_value(between) / avg(within), 6) AS ratio
FROM g
JOIN b ON g.j = b.j
GROUP BY g.j
""")
def d17(t):
    g = em(t).select("k", F.posexplode("x").alias("dim", "e")).groupBy("k", "dim").agg(F.avg("e").alias("mu"), (F.max("e") - F.min("e")).alias("w"))
    b = g.groupBy("dim").agg((F.max("mu") - F.min("mu")).alias("b"), F.avg("w").alias("w"))
    return b.select("dim", r6("w", "within"), r6("b", "between"), r6(F.col("b") / F.col("w"), "ratio"))


@query("d18_readiness_table", """
WITH m AS (SELECT source AS name, count(*) AS files, sum(n_chars) AS chars, count(*) FILTER (WHERE n_chars < 100) AS broken FROM documents GROUP BY
  1),
r AS (SELECT 'src' || i AS name, i % 4 <> 3 AS licensed, 60000 AS expected FROM range(0, 22) t(i))
SELECT r.name, CASE WHEN NOT licensed THEN 'blocked' WHEN m.name IS NULL THEN 'missing' WHEN broken > 3 THEN 'corrupt' WHEN chars < 0.98 * expected
  AND expected - chars > 5000 THEN 'short' ELSE 'ready' END AS state, coalesce(files, 0) AS files
FROM r
LEFT JOIN m USING (name)
""")
def d18(t):
    m = t("documents").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") < 100).alias("broken"))
    r = m.sparkSession.range(22).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("name"), (F.col("id") % 4 != 3).alias("licensed"), F.lit(60000).alias("expected"))
    j = r.join(m.withColumn("seen", F.lit(True)).hint("merge"), "name", "left")
    short = (F.col("chars") < 0.98 * F.col("expected")) & (F.col("expected") - F.col("chars") > 5000)
    return j.select("name", F.when(~F.col("licensed"), "blocked").when(F.col("seen").isNull(), "missing").when(F.col("broken") > 3, "corrupt").when(short, "short").otherwise("ready").alias("state"), F.coalesce("files", F.lit(0)).alias("files"))


D18_SQL = """
WITH m AS (SELECT source AS name, count(*) AS files, sum(n_chars) AS chars, count(*) FILTER (WHERE n_chars < 100) AS broken FROM documents GROUP BY 1),
p AS (SELECT source AS name, count(*) AS probed, count(*) FILTER (WHERE n_chars >= 40) AS decoded
  FROM (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY md5('probe:' || doc_id)) AS r FROM documents) WHERE r <= 5 GROUP BY 1),
r AS (SELECT 'src' || i AS name, i % 4 <> 3 AS licensed, CASE WHEN i % 5 <> 0 THEN 'team' || i % 3 END AS owner, i < 3 AS required, 60000 AS expected FROM range(0, 22) t(i)),
s AS (SELECT r.*, coalesce(files, 0) AS files, coalesce(probed, 0) AS probed, coalesce(decoded, 0) AS decoded,
  CASE WHEN NOT licensed THEN 'blocked' WHEN m.name IS NULL THEN 'missing' WHEN decoded < probed THEN 'undecodable' WHEN broken > 3 THEN 'corrupt' WHEN chars < 0.98 * expected AND expected - chars > 5000 THEN 'short' ELSE 'ready' END AS state
  FROM r LEFT JOIN m USING (name) LEFT JOIN p USING (name))
SELECT name, state, files, probed, decoded, owner, CASE state WHEN 'blocked' THEN 'terms not established' WHEN 'missing' THEN 'nothing found' WHEN 'undecodable' THEN (probed - decoded) || ' of ' || probed || ' unreadable' END AS blocker,
  (SELECT count(*) FILTER (WHERE required AND state <> 'ready') = 0 AND count(*) FILTER (WHERE state IN ('blocked', 'missing', 'undecodable') AND owner IS NULL) = 0 FROM s) AS gate_open
FROM s
"""


@query("d18_readiness_gate", D18_SQL)
def d18_gate(t):
    """Declared sources beside what was found of them: a few files of each are read, whatever stands in the way has a
    name and an owner, and the gate is open if all that is required is ready and nothing in the way is without an owner."""
    d = t("documents").withColumnRenamed("source", "name")
    m = d.groupBy("name").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") < 100).alias("broken"))
    probe = first_of_each(d.select("name", "n_chars", F.md5(F.concat(F.lit("probe:"), F.col("doc_id").cast("string"))).alias("h")), "name", "h", 5)
    p = probe.groupBy("name").agg(F.count("*").alias("probed"), F.count_if(F.col("n_chars") >= 40).alias("decoded"))
    i = F.col("id")
    owner = F.when(i % 5 != 0, F.concat(F.lit("team"), (i % 3).cast("string")))
    declared = t.spark.range(22).select(F.concat(F.lit("src"), i.cast("string")).alias("name"), (i % 4 != 3).alias("licensed"), owner.alias("owner"), (i < 3).alias("required"), F.lit(60000).alias("expected"))
    return R.readiness(declared, m.join(p.hint("merge"), "name"))


@query("d19_counts_at_levels", """
SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, CAST(2 - grouping(o_orderstatus) - grouping(o_orderpriority) AS INTEGER)
  AS depth
FROM orders
GROUP BY ROLLUP (o_orderstatus, o_orderpriority)
""")
def d19(t):
    o = t("orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return R.by_levels(o, ["status", "priority"], F.count("*").alias("n"))


@query("d20_fold_means", f"""
WITH {_LAB},
f AS (SELECT source, count(*) AS n, CASE WHEN count(*) >= 18 THEN avg(quality) END AS score FROM lj GROUP BY 1)
SELECT round(avg(score), 6) AS macro, round(sum(score * n) / sum(n) FILTER (WHERE score IS NOT NULL), 6) AS weighted, count(score) AS folds, count(*)
  - count(score) AS excluded
FROM f
""")
def d20(t):
    f = labelled(t).groupBy("source").agg(F.count("*").alias("n"), F.avg("quality").alias("s")).withColumn("s", F.when(F.col("n") >= 18, F.col("s")))
    return f.agg(r6(F.avg("s"), "macro"), r6(F.sum(F.col("s") * F.col("n")) / F.sum(F.when(F.col("s").isNotNull(), F.col("n"))), "weighted"), F.count("s").alias("folds"), (F.count("*") - F.count("s")).alias("excluded"))


@query("d21_decision_rules", f"""
WITH {_LAB},
e AS (SELECT source, avg(toxic) FILTER (WHERE q) AS a, avg(toxic) FILTER (WHERE lang = 'en') AS b, avg((doc_id % 7 = 0)::INT) AS placebo FROM lj GROUP
  BY 1)
SELECT source, a > 0.1 AND b > 0.1 AS supported, placebo < 0.2 AS clean, CASE WHEN a > 0.1 AND b > 0.1 AND placebo < 0.2 THEN 'accept' WHEN placebo >=
  0.2 THEN 'placebo_fires' ELSE 'reject' END AS verdict
FROM e
""")
def d21(t):
    e = labelled(t).groupBy("source").agg(F.avg(F.when(F.col("q"), F.col("toxic"))).alias("a"), F.avg(F.when(F.col("lang") == "en", F.col("toxic"))).alias("b"), F.avg((F.col("doc_id") % 7 == 0).cast("double")).alias("p"))
    sup, clean = (F.col("a") > 0.1) & (F.col("b") > 0.1), F.col("p") < 0.2
    return e.select("source", sup.alias("supported"), clean.alias("clean"), F.when(sup & clean, "accept").when(~clean, "placebo_fires").otherwise("reject").alias("verdict"))


@query("d22_lineage_staleness", """
WITH now AS (SELECT source AS name, count(*) || ':' || sum(n_chars) AS fp FROM documents GROUP BY 1),
was AS (SELECT source AS name, count(*) || ':' || sum(CASE WHEN doc_id % 500 = 7 THEN n_chars + 1 ELSE n_chars END) AS fp FROM documents WHERE source
  <> 'src3' GROUP BY 1)
SELECT coalesce(now.name, was.name) AS name, CASE WHEN was.fp IS NULL THEN 'unaccounted' WHEN now.fp = was.fp THEN 'fresh' ELSE 'stale' END AS status
FROM now
FULL JOIN was ON now.name = was.name
""")
def d22(t):
    d = t("documents").withColumnRenamed("source", "name")
    fp = lambda x, c: x.groupBy("name").agg(F.concat_ws(":", F.count("*").cast("string"), F.sum(c).cast("string")).alias("fp"))
    now, was = fp(d, F.col("n_chars")), fp(d.where("name <> 'src3'"), F.when(F.col("doc_id") % 500 == 7, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    j = now.withColumnRenamed("fp", "a").join(was.withColumnRenamed("fp", "b").hint("merge"), "name", "full_outer")
    return j.select("name", F.when(F.col("b").isNull(), "unaccounted").when(F.col("a") == F.col("b"), "fresh").otherwise("stale").alias("status"))


@query("d23_median_ratio_to_own_scale", """
SELECT l_orderkey, round(median(l_extendedprice / nullif(l_quantity - 1, 0)), 6) AS ratio, count(*) FILTER
  (WHERE l_extendedprice / nullif(l_quantity - 1, 0) > 2000) AS over, round(max(l_extendedprice) - min(l_extendedprice), 6) AS range
FROM lineitem
GROUP BY 1
""")
def d23(t):
    r = F.col("l_extendedprice") / F.nullif(F.col("l_quantity") - 1, F.lit(0))
    return t("lineitem").groupBy("l_orderkey").agg(r6(F.median(r), "ratio"), F.count_if(r > 2000).alias("over"), r6(F.max("l_extendedprice") - F.min("l_extendedprice"), "range"))


@query("d24_masked_mean_vector", f"""
WITH {EM},
e AS (SELECT k, j, avg(x[j]) FILTER (WHERE x[1] > 0) AS a FROM m, range(1, 65) r(j) GROUP BY k, j)
SELECT k, CAST(arg_max(j, (a, -j)) - 1 AS INTEGER) AS top, round(max(a), 6) AS value, (SELECT avg((m.x[1] > 0)::INT) >= 0.5 FROM m WHERE m.k = e.k) AS
  usable
FROM e
GROUP BY k
""")
def d24(t):
    d = em(t).select("k", (F.col("x")[0] > 0).alias("on_"), F.posexplode("x").alias("dim", "e"))
    e = d.groupBy("k", "dim").agg(F.avg(F.when(F.col("on_"), F.col("e"))).alias("a"), F.avg(F.col("on_").cast("double")).alias("share"))
    return e.groupBy("k").agg(F.max_by("dim", F.struct("a", F.negative("dim"))).alias("top"), r6(F.max("a"), "value"), (F.max("share") >= 0.5).alias("usable"))


@query("d24_class_means_and_correlations", f"""
WITH {EM},
e AS (SELECT k, i, j, x[j] AS e FROM m, range(1, 65) r(j)),
r AS (SELECT j, rank() OVER (PARTITION BY j ORDER BY k) + (count(*) OVER (PARTITION BY j, k) - 1) / 2.0::DOUBLE AS a, rank() OVER
  (PARTITION BY j ORDER BY e) + (count(*) OVER (PARTITION BY j, e) - 1) / 2.0::DOUBLE AS b FROM e),
c AS (SELECT j, corr(a, b) AS rho FROM r GROUP BY j),
g AS (SELECT k, j, avg(e) AS mean FROM e GROUP BY k, j)
SELECT CAST(g.j - 1 AS INTEGER) AS dim, list(round(mean, 6) ORDER BY k) AS means, round(any_value(rho), 6) AS rho
FROM g
JOIN c ON c.j = g.j
GROUP BY g.j
""")
def d24_classes(t):
    """Per dimension the mean of every group, and the rank correlation of the dimension with the group's number."""
    e = em(t).select("k", F.posexplode("x").alias("dim", "e"))
    means = e.groupBy("dim", "k").agg(F.avg("e").alias("mean")).groupBy("dim").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "mean"))), lambda s: F.round(s["mean"], 6)).alias("means"))
    rho = spearman(e, "k", "e", ["dim"]).select("dim", r6("rho", "rho"))
    return means.join(rho.hint("merge"), "dim")

"""Inference and evaluation queries."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import functions as F

from tidemark.functions import signals as G
from tidemark.operators import inference as N
from tidemark.operators import logistic as L
from tidemark.operators import series as S
from tidemark.operators.joins import nearest_match
from tidemark.operators.quantiles import exact_quantiles
from tidemark.plans.joins_queries import PAIRS, WINDOWS, audit_windows, matched
from tidemark.plans.registry import query
from tidemark.plans.reports_queries import _LAB, labelled
from tidemark.plans.windows_queries import EM, EV, em, ev, r6, windowed

B = 200
#: Replicates of the reference
WHOLE_B = 4000


def match_diffs(t):
    """Outcome difference of each matched pair of windows."""
    w = N.written(audit_windows(t))
    m = matched(t, w)
    w = w.select("k", "win", "y")
    a = w.select("k", F.col("win").alias("case"), F.col("y").alias("y1"))
    b = w.select("k", F.col("win").alias("control"), F.col("y").alias("y0"))
    return m.join(a.hint("merge"), ["k", "case"]).join(b.hint("merge"), ["k", "control"]).select("k", (F.col("y1") - F.col("y0")).alias("diff"))


def _boot(reps):
    return f"""
cl AS (SELECT k, sum(diff) AS s, count(*) AS n, row_number() OVER (ORDER BY k) - 1 AS id FROM mt GROUP BY k),
sz AS (SELECT count(*) AS m, sum(s) AS s, sum(n) AS n, stddev_samp(s / n) AS sd FROM cl),
dr AS (SELECT b, ('0x' || substr(md5('b:' || b || ':' || j), 1, 8))::BIGINT % m AS id FROM range(0, {reps}) r(b), sz, range(0, (SELECT m FROM sz))
  q(j)),
bm AS (SELECT b, sum(s) / sum(n) AS mean FROM dr JOIN cl USING (id) GROUP BY b),
bs AS (SELECT quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi, avg((mean <= 0)::INT) AS below, avg((mean >= 0)::INT) AS above FROM
  bm)
"""


def _s01_sql(reps):
    return f"""
WITH {EV},
{WINDOWS},
{PAIRS},
{_boot(reps)}
SELECT m AS clusters, CAST(n AS BIGINT) AS pairs, round(s / n, 6) AS shift, round(CASE WHEN m >= 10 THEN lo END, 6) AS lo,
  round(CASE WHEN m >= 10 THEN hi END, 6) AS hi, round(CASE WHEN m >= 10 THEN greatest(1.0 / {reps}, least(1.0, 2 * least(below, above))) END, 6) AS
  p, round(s / n / sd, 6) AS effect, round(2.8 * sd / sqrt(m), 6) AS mde
FROM sz, bs
"""


def bootstrapped(t, reps):
    b = N.cluster_bootstrap(match_diffs(t), "k", "diff", reps)
    return b.select("clusters", "pairs", *[r6(c, c) for c in ("shift", "lo", "hi", "p", "effect", "mde")])


@query("s01_matched_pair_bootstrap", _s01_sql(B))
def s01(t):
    return bootstrapped(t, B)


_COPIES = f"list_sum([CAST(h >= c AS INTEGER) FOR c IN {N._COPIES!r}])"


def _s01_whole_sql(reps):
    return f"""
WITH {EV}, {WINDOWS}, {PAIRS},
cl AS (SELECT k, sum(diff) AS s, count(*) AS n FROM mt GROUP BY k),
sz AS (SELECT count(*) AS m, sum(s) AS s, sum(n) AS n, stddev_samp(s / n) AS sd FROM cl),
dr AS (SELECT b, s, n, {_COPIES} AS w FROM (SELECT b, s, n, ('0x' || substr(md5('b:' || b || ':' || k), 1, 8))::BIGINT AS h FROM range(0, {reps}) r(b), cl)),
bm AS (SELECT b, sum(w * s) / sum(w * n) AS mean FROM dr GROUP BY b HAVING sum(w) > 0),
bs AS (SELECT quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi, avg((mean <= 0)::INT) AS below, avg((mean >= 0)::INT) AS above FROM bm)
SELECT m AS clusters, CAST(n AS BIGINT) AS pairs, round(s / n, 6) AS shift, round(CASE WHEN m >= 10 THEN lo END, 6) AS lo, round(CASE WHEN m >= 10 THEN hi END, 6) AS hi,
  round(CASE WHEN m >= 10 THEN greatest(1.0 / {reps}, least(1.0, 2 * least(below, above))) END, 6) AS p, round(s / n / sd, 6) AS effect, round(2.8 * sd / sqrt(m), 6) AS mde
FROM sz, bs
"""


@query("s01_matched_pair_bootstrap_whole", _s01_whole_sql(WHOLE_B))
def s01_whole(t):
    """With as many replicates as the reference, each cluster's copies drawn where it stands."""
    b = N.poisson_bootstrap(match_diffs(t), "k", "diff", WHOLE_B)
    return b.select("clusters", "pairs", *[r6(c, c) for c in ("shift", "lo", "hi", "p", "effect", "mde")])


_SCORE = "sc AS (SELECT doc_id, n_chars, q, lang, source FROM lj)"


def _auc_sql(by):
    cols = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return f"""
g AS (SELECT {cols}n_chars, count(*) FILTER (WHERE q) AS p, count(*) FILTER (WHERE NOT q) AS n FROM lj GROUP BY {cols}n_chars),
w AS (SELECT *, coalesce(sum(n) OVER ({part}ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
au AS (SELECT {cols}sum(p * (below + n / 2.0)) / nullif(sum(p) * sum(n), 0) AS auc, sum(p) AS p, sum(n) AS n FROM w{grp})
"""


@query("s03_roc_auc", f"WITH {_LAB}, {_auc_sql('')} SELECT round(auc::DOUBLE, 6) AS auc, p::BIGINT AS positives, n::BIGINT AS negatives FROM au")
def s03(t):
    return N.auc(labelled(t), "n_chars", F.col("q")).select(r6("auc", "auc"), "positives", "negatives")


@query("s04_within_group_auc", f"WITH {_LAB}, {_auc_sql('lang')} SELECT round(avg(auc::DOUBLE), 6) AS within, count(auc) AS groups FROM au")
def s04(t):
    return N.auc(labelled(t), "n_chars", F.col("q"), ["lang"]).agg(r6(F.avg("auc"), "within"), F.count("auc").alias("groups"))


@query("s05_spearman", """
WITH r AS (SELECT l_returnflag AS f, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER
  (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) +
  (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS b FROM lineitem)
SELECT f AS l_returnflag, round(corr(a, b), 6) AS rho, count(*) AS n
FROM r
GROUP BY 1
""")
def s05(t):
    return N.spearman(t("lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]).select("l_returnflag", r6("rho", "rho"), "n")


@query("s06_effect_sizes", f"""
WITH {_LAB},
z AS (SELECT source, n_chars AS x, toxic AS y, quality AS z FROM lj),
c AS (SELECT source, (avg(x) FILTER (WHERE y = 1) - avg(x) FILTER (WHERE y = 0)) / sqrt((var_pop(x) FILTER (WHERE y = 1) * count(*) FILTER
  (WHERE y = 1) + var_pop(x) FILTER (WHERE y = 0) * count(*) FILTER (WHERE y = 0)) / count(*)) AS smd, CASE WHEN stddev_pop(x) * stddev_pop(y) > 0
  THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END AS xy, CASE WHEN stddev_pop(x) * stddev_pop(z) > 0 THEN covar_pop(x, z) /
  (stddev_pop(x) * stddev_pop(z)) END AS xz, CASE WHEN stddev_pop(y) * stddev_pop(z) > 0 THEN covar_pop(y, z) / (stddev_pop(y) * stddev_pop(z)) END AS
  yz FROM z GROUP BY 1)
SELECT source, round(smd, 5) AS smd, round(xy, 6) AS point_biserial, round(CASE WHEN abs(xz) < 1 - 1e-9 AND abs(yz) < 1 - 1e-9 THEN (xy - xz * yz) /
  sqrt((1 - xz * xz) * (1 - yz * yz)) END, 6) AS partial
FROM c
""")
def s06(t):
    g = labelled(t).groupBy("source").agg(N.std_mean_diff("n_chars", F.col("x")).alias("smd"), N.safe_corr("n_chars", "toxic").alias("xy"), N.safe_corr("n_chars", "quality").alias("xz"), N.safe_corr("toxic", "quality").alias("yz"))
    return g.select("source", F.round("smd", 5).alias("smd"), r6("xy", "point_biserial"), r6(N.partial_corr(F.col("xy"), F.col("xz"), F.col("yz")), "partial"))


#: Replicates of permutation tests: of most, and of the reference
BY_GROUP, PERMUTED = 999, 20_000


def _permuted_sql(reps, rows, by="", row="doc_id"):
    """Null differences ``nl(by, d)`` and observed ``ob(by, o, k, n)`` of a permutation test over ``rows(by, row, x, y)``."""
    cols, part = (f"{by}, ", f"PARTITION BY {by}, b") if by else ("", "PARTITION BY b")
    using = f"USING ({by})" if by else "ON true"
    return f"""
tt AS (SELECT {cols}count(*) AS n, sum(y) AS k, sum(x) AS t, sum(x * y) AS s FROM {rows} GROUP BY ALL HAVING sum(y) > 0 AND sum(y) < count(*)),
r AS (SELECT {cols}b, x, row_number() OVER ({part} ORDER BY ('0x' || substr(md5('p:' || b || ':' || {row}), 1, 8))::BIGINT, {row}) AS r FROM {rows},
  range(0, {reps}) q(b)),
z AS (SELECT {cols}b, sum(CASE WHEN r <= k THEN x ELSE 0 END) AS s FROM r JOIN tt {using} GROUP BY {cols}b),
nl AS (SELECT {cols}z.s / k - (t - z.s) / (n - k) AS d FROM z JOIN tt {using}),
ob AS (SELECT {cols}s / k - (t - s) / (n - k) AS o, k, n FROM tt)
"""


def _s07_sql(reps):
    return f"""
WITH {_LAB},
d AS (SELECT doc_id, n_chars::DOUBLE AS x, toxic AS y FROM lj),
{_permuted_sql(reps, 'd')}
SELECT round(any_value(o), 4) AS observed, round((count(*) FILTER (WHERE abs(d) >= abs(o) - 1e-12) + 1) / (count(*) + 1.0::DOUBLE), 6) AS p,
  round(2.8 * stddev_pop(d), 4) AS mde
FROM nl, ob
"""


def permuted(t, reps):
    d = labelled(t).withColumn("chars", F.col("n_chars").cast("double"))
    r = N.permutation_test(N.written(d.select("doc_id", "chars", "toxic")), "chars", "toxic", "doc_id", reps)
    return r.select(F.round("observed", 4).alias("observed"), r6("p", "p"), F.round("mde", 4).alias("mde"))


@query("s07_permutation_test", _s07_sql(BY_GROUP))
def s07(t):
    return permuted(t, BY_GROUP)


@query("s07_permutation_test_whole", _s07_sql(PERMUTED))
def s07_whole(t):
    """With as many replicates as the reference."""
    return permuted(t, PERMUTED)


@query("s08_bonferroni_interpretable", f"""
WITH {_LAB},
d AS (SELECT source, doc_id, n_chars::DOUBLE AS x, toxic AS y FROM lj),
{_permuted_sql(BY_GROUP, 'd', 'source')},
e AS (SELECT source, any_value(n) AS n, any_value(k) AS k, (count(*) FILTER (WHERE abs(d) >= abs(o) - 1e-12) + 1) / (count(*) + 1.0::DOUBLE) AS p FROM
  nl JOIN ob USING (source) GROUP BY 1)
SELECT source, round(p, 6) AS p, n >= 18 AND k >= 2 AS interpretable, CASE WHEN n >= 18 AND k >= 2 THEN
  round(least(1.0, p * count(*) FILTER (WHERE n >= 18 AND k >= 2) OVER ()), 6) END AS adjusted
FROM e
""")
def s08(t):
    """A permutation test of length against toxicity in every source, corrected for the tests that can be read."""
    d = labelled(t).withColumn("chars", F.col("n_chars").cast("double"))
    e = N.permutation_test(d, "chars", "toxic", "doc_id", BY_GROUP, by=["source"])
    ok = (F.col("rows") >= 18) & (F.col("positives") >= 2)
    return N.bonferroni(e, "p", ok).select("source", r6("p", "p"), ok.alias("interpretable"), r6("adjusted", "adjusted"))


_RULES = """
ru AS (SELECT x, unnest(['size', 'symbols', 'both']) AS rule, unnest([n_chars::DOUBLE, CASE WHEN r THEN n_chars + 1e6 ELSE n_chars END, n_chars *
  (1 + quality)]) AS score FROM lj)
"""


@query("s11_operating_point", f"""
WITH {_LAB},
{_RULES},
th AS (SELECT rule, quantile_cont(score, 0.9) AS t FROM ru WHERE NOT x GROUP BY 1)
SELECT rule, round(any_value(t), 6) AS threshold, round(avg((score > t)::INT) FILTER (WHERE x), 6) AS hit,
  round(avg((score > t)::INT) FILTER (WHERE NOT x), 6) AS false_alarm
FROM ru
JOIN th USING (rule)
GROUP BY 1
""")
def s11(t):
    """Threshold of three rules at a tenth of false alarms among quiet rows, and what it hits."""
    n = F.col("n_chars")
    rules = F.create_map(F.lit("size"), n.cast("double"), F.lit("symbols"), F.when(F.col("r"), n + 1e6).otherwise(n.cast("double")), F.lit("both"), (n * (1 + F.col("quality"))).cast("double"))
    d = labelled(t).select("x", F.explode(rules).alias("rule", "score"))
    th = exact_quantiles(d.where("not x"), ["rule"], F.col("score"), [0.9]).select("rule", F.col("q")[0].alias("t"))
    over = (F.col("score") > F.col("t")).cast("double")
    return d.join(F.broadcast(th), "rule").groupBy("rule").agg(r6(F.first("t"), "threshold"), r6(F.avg(F.when(F.col("x"), over)), "hit"), r6(F.avg(F.when(~F.col("x"), over)), "false_alarm"))


@query("s12_split_by_group", f"""
WITH {_LAB},
p AS (SELECT *, ('0x' || substr(md5('g:' || doc_id), 1, 8))::BIGINT % 3 = 0 AS z FROM lj),
g AS (SELECT lang, avg(n_chars) FILTER (WHERE x) - avg(n_chars) FILTER (WHERE NOT x) AS d, avg(n_chars) FILTER (WHERE z) - avg(n_chars) FILTER
  (WHERE NOT z) AS q, count(*) AS n FROM p GROUP BY 1)
SELECT lang, round(d, 4) AS effect, round(q, 4) AS placebo, n, count(*) FILTER (WHERE d > 0) OVER () AS positive, count(*) OVER () AS of_
FROM g
""")
def s12(t):
    """Effect per group beside that of a mark that means nothing, and in how many groups the effect is positive."""
    apart = lambda c: F.avg(F.when(c, F.col("n_chars"))) - F.avg(F.when(~c, F.col("n_chars")))
    d = labelled(t).withColumn("z", N.draw(F.lit("g"), F.col("doc_id")) % 3 == 0)
    g = d.groupBy("lang").agg(apart(F.col("x")).alias("d"), apart(F.col("z")).alias("q"), F.count("*").alias("n"))
    k = g.agg(F.count_if(F.col("d") > 0).alias("positive"), F.count("*").alias("of_"))
    return g.crossJoin(F.broadcast(k)).select("lang", F.round("d", 4).alias("effect"), F.round("q", 4).alias("placebo"), "n", "positive", "of_")


_WHOLE = r"""
w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[ \t\n\r]+'), lambda x: x <> '') AS tk FROM conversations),
p AS MATERIALIZED (SELECT row_number() OVER () AS id, a.conv_id, a.turn, a.tk AS r, b.tk AS h FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn =
  a.turn + 1),
dp(id, i, j, v) AS (SELECT id, 0::BIGINT, j, j FROM (SELECT id, unnest(range(0, len(h) + 1)) AS j FROM p) UNION ALL SELECT id, i, j, j + min(t - j)
  OVER (PARTITION BY id ORDER BY j) FROM (SELECT d.id, d.i + 1 AS i, d.j, least(d.v + 1, CASE WHEN d.j > 0 THEN lag(d.v) OVER
  (PARTITION BY d.id ORDER BY d.j) + (p.r[d.i + 1] <> p.h[d.j])::BIGINT END) AS t FROM dp d JOIN p ON p.id = d.id WHERE d.i < len(p.r)))
"""


_WER = f"""
WITH RECURSIVE {_WHOLE}
SELECT conv_id, turn, v AS edits, round(v / nullif(len(r), 0)::DOUBLE, 6) AS wer
FROM dp
JOIN p ON p.id = dp.id AND i = len(r) AND j = len(h)
"""


@query("s13_word_error_rate", _WER)
@query("s13_word_error_rate_whole", _WER)
def s13(t):
    """Over whole texts and whole words (under both of the names it has had)."""
    w = t("conversations").select("conv_id", "turn", F.filter(F.split(F.lower("text"), "[ \t\n\r]+"), lambda x: x != "").alias("tk"))
    nxt = w.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("tk").alias("hyp"))
    d = w.join(nxt.hint("merge"), ["conv_id", "turn"]).withColumn("edits", N.word_edits(F.col("tk"), F.col("hyp")))
    return d.select("conv_id", "turn", "edits", r6(F.col("edits") / F.nullif(F.size("tk"), F.lit(0)), "wer"))


@query("s14_recall_and_oov", """
WITH tr AS (SELECT lang, source FROM documents WHERE doc_id % 5 <> 0),
mx AS (SELECT source, arg_max(lang, (n, lang)) AS guess FROM (SELECT source, lang, count(*) AS n FROM tr GROUP BY ALL) GROUP BY 1),
te AS (SELECT d.lang, guess FROM documents d LEFT JOIN mx ON mx.source = d.source AND d.source <> 'src3' WHERE doc_id % 5 = 0)
SELECT lang, count(*) AS n, round(avg((coalesce(guess, '') = lang)::INT), 6) AS recall, count(*) FILTER (WHERE guess IS NULL) AS oov
FROM te
GROUP BY 1
""")
def s14(t):
    d = t("documents").select("doc_id", "lang", "source")
    n = d.where("doc_id % 5 <> 0").groupBy("source", "lang").agg(F.count("*").alias("n"))
    guess = n.groupBy("source").agg(F.max_by("lang", F.struct("n", "lang")).alias("guess")).where("source <> 'src3'")
    te = d.where("doc_id % 5 = 0").join(guess.hint("merge"), "source", "left")
    return te.groupBy("lang").agg(F.count("*").alias("n"), r6(F.avg((F.coalesce("guess", F.lit("")) == F.col("lang")).cast("double")), "recall"), F.count_if(F.col("guess").isNull()).alias("oov"))


_GUESS = """
tr AS (SELECT lang, source FROM documents WHERE doc_id % 5 <> 0),
mx AS (SELECT source, arg_max(lang, (n, lang)) AS guess FROM (SELECT source, lang, count(*) AS n FROM tr GROUP BY ALL) GROUP BY 1),
tp AS (SELECT arg_max(lang, (n, lang)) AS top FROM (SELECT lang, count(*) AS n FROM tr GROUP BY 1)),
te AS (SELECT d.lang, guess FROM documents d LEFT JOIN mx ON mx.source = d.source AND d.source <> 'src3' WHERE doc_id % 5 = 0)
"""


@query("s14_recogniser_summary", f"""
WITH {_GUESS} SELECT count(*) AS n, round(avg((coalesce(guess, '') = lang)::INT), 6) AS accuracy, round(avg((guess = lang)::INT) FILTER
  (WHERE guess IS NOT NULL), 6) AS closed_accuracy, round(avg((lang = top)::INT), 6) AS baseline, round(avg((guess IS NULL)::INT), 6) AS oov_share,
  count(DISTINCT guess) AS distinct_guesses, count(DISTINCT guess) <= 1 AS constant
FROM te, tp
""")
def s14_summary(t):
    """All held-out rows in one: accuracy, that over rows with a known source, the commonest class as baseline, the
    share of unknown ones, and whether the guesses are one and the same."""
    d = t("documents").select("doc_id", "lang", "source")
    train, te = d.where("doc_id % 5 <> 0"), d.where("doc_id % 5 = 0")
    guess = train.groupBy("source", "lang").agg(F.count("*").alias("n")).groupBy("source").agg(F.max_by("lang", F.struct("n", "lang")).alias("guess")).where("source <> 'src3'")
    top = train.groupBy("lang").agg(F.count("*").alias("n")).agg(F.max_by("lang", F.struct("n", "lang")).alias("top"))
    j = te.join(guess.hint("merge"), "source", "left").crossJoin(F.broadcast(top))  # one row
    hit = (F.col("guess") == F.col("lang")).cast("double")
    return j.agg(
        F.count("*").alias("n"), r6(F.avg(F.coalesce(hit, F.lit(0.0))), "accuracy"), r6(F.avg(hit), "closed_accuracy"), r6(F.avg((F.col("lang") == F.col("top")).cast("double")), "baseline"),
        r6(F.avg(F.col("guess").isNull().cast("double")), "oov_share"), F.count_distinct("guess").alias("distinct_guesses"), (F.count_distinct("guess") <= 1).alias("constant"),
    )


_PRED = """
pd AS (SELECT t AS threshold, CASE WHEN l = 'quality' THEN q ELSE x END AS y, (doc_id % 10) / 10.0 >= t AS p, l AS label FROM lj,
  (SELECT unnest([0.3, 0.5]) AS t), (SELECT unnest(['quality', 'toxic']) AS l))
"""


@query("s15_f1_at_thresholds", f"""
WITH {_LAB},
{_PRED},
c AS (SELECT label, threshold, count(*) FILTER (WHERE y AND p) AS tp, count(*) FILTER (WHERE NOT y AND p) AS fp, count(*) FILTER (WHERE y AND NOT p)
  AS fn, count(*) FILTER (WHERE NOT y AND NOT p) AS tn, count(*) AS n FROM pd GROUP BY 1, 2)
SELECT label, threshold::DOUBLE AS threshold, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE, 6) AS f1,
  round((tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE) / 2, 6) AS balanced_accuracy, round((tp + fp) / n::DOUBLE, 6) AS predicted_rate,
  round(greatest(tp + fn, fp + tn) / n::DOUBLE, 6) AS majority
FROM c
""")
def s15(t):
    d = labelled(t).withColumn("threshold", F.explode(F.array(F.lit(0.3), F.lit(0.5))))
    d = d.select("threshold", ((F.col("doc_id") % 10) / 10.0 >= F.col("threshold")).alias("p"), F.explode(F.create_map(F.lit("quality"), "q", F.lit("toxic"), "x")).alias("label", "y"))
    return d.groupBy("label", "threshold").agg(*N.f1_report(d, F.col("y"), F.col("p")))


@query("s15_f1_means", f"""
WITH {_LAB},
{_PRED},
c AS (SELECT label, threshold, count(*) FILTER (WHERE y AND p) AS tp, count(*) FILTER (WHERE NOT y AND p) AS fp, count(*) FILTER (WHERE y AND NOT p)
  AS fn FROM pd GROUP BY 1, 2),
f AS (SELECT *, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE AS f1 FROM c)
SELECT threshold::DOUBLE AS threshold, round(avg(f1), 6) AS macro, round(coalesce(2.0 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0),
  0)::DOUBLE, 6) AS micro, round(sum(f1 * (tp + fn)) / nullif(sum(tp + fn), 0), 6) AS weighted
FROM f
GROUP BY 1
""")
def s15_means(t):
    """Macro, micro and support-weighted F1 over the labels at each threshold."""
    d = labelled(t).withColumn("threshold", F.explode(F.array(F.lit(0.3), F.lit(0.5))))
    d = d.select("threshold", ((F.col("doc_id") % 10) / 10.0 >= F.col("threshold")).alias("p"), F.explode(F.create_map(F.lit("quality"), "q", F.lit("toxic"), "x")).alias("label", "y"))
    c = d.groupBy("label", "threshold").agg(F.count_if(F.col("y") & F.col("p")).alias("tp"), F.count_if(~F.col("y") & F.col("p")).alias("fp"), F.count_if(F.col("y") & ~F.col("p")).alias("fn"))
    return N.f1_means(c, ["threshold"])


@query("s16_axis_identity", f"""
WITH {EM},
c AS (SELECT k, a, b, abs(corr(x[a], x[b + 32])) AS r FROM m, range(1, 33) p(a), range(1, 33) q(b) GROUP BY ALL)
SELECT CAST(a - 1 AS INTEGER) AS a, CAST(b - 1 AS INTEGER) AS b, round(median(r), 6) AS r
FROM c
GROUP BY 1, 2
""")
def s16(t):
    """Median over the series of the correlation of every dimension of one half with every one of the other."""
    g = N.halves_moments(em(t), "x", ["k"])
    c = g.select("k", "a", "b", F.abs((F.col("n") * F.col("uv") - F.col("u") * F.col("v")) / F.sqrt((F.col("n") * F.col("uu") - F.col("u") * F.col("u")) * (F.col("n") * F.col("vv") - F.col("v") * F.col("v")))).alias("r"))
    return c.groupBy("a", "b").agg(r6(F.median("r"), "r"))


@query("s17_shared_subspace_gram", f"""
WITH {EM},
g AS (SELECT a, b, sum(x[a] * x[b + 32]) AS d, sum(x[a] * x[a]) AS na, sum(x[b + 32] * x[b + 32]) AS nb FROM m, range(1, 33) p(a), range(1, 33) q(b)
  GROUP BY ALL)
SELECT CAST(a - 1 AS INTEGER) AS a, CAST(b - 1 AS INTEGER) AS b, round(d / sqrt(na * nb), 6) AS cosine
FROM g
""")
def s17(t):
    g = N.halves_moments(em(t), "x", [])
    return g.select("a", "b", r6(F.col("uv") / F.sqrt(F.col("uu") * F.col("vv")), "cosine"))


@query("s17_subspace_fraction", f"""
WITH {EM},
g AS (SELECT k, a, b, sum(x[a] * x[b]) AS s FROM m, range(1, 65) p(a), range(1, 65) q(b) GROUP BY ALL)
SELECT k, round(sqrt(sum(s * s) FILTER (WHERE a <= 32 AND b > 32) / (sqrt(sum(s * s) FILTER (WHERE a <= 32 AND b <= 32)) *
  sqrt(sum(s * s) FILTER (WHERE a > 32 AND b > 32)))), 5) AS shared, count(*) FILTER (WHERE a <= 32 AND b > 32) AS pairs
FROM g
GROUP BY k
""")
def s17_fraction(t):
    """How much of two halves' directions is common, over the vectors of each label: the size of their cross Gram
    matrix against those of their own, from sums that combine before the shuffle."""
    return N.shared_fraction(em(t), "x", ["k"]).select("k", F.round("shared", 5).alias("shared"), "pairs")


S17_SQL = f"""
WITH {EM},
h AS (SELECT k, x[1:32] AS u, x[33:64] AS v FROM m),
n AS (SELECT k, [e / greatest(sqrt(list_sum([y * y FOR y IN u])), 1e-8) FOR e IN u] AS u, [e / greatest(sqrt(list_sum([y * y FOR y IN v])), 1e-8) FOR e IN v] AS v FROM h)
SELECT a.k, CAST(round(sqrt(count(*))) AS BIGINT) AS n, round(avg(pow(list_dot_product(a.u, b.v), 2)), 6) AS shared FROM n a JOIN n b ON a.k = b.k GROUP BY a.k
"""


@query("s17_mean_squared_cosine", S17_SQL)
def s17_pairs(t):
    """How much of two halves' directions is common over the vectors of each label: the mean over all pairs of a first
    half and a second half, from two Gram matrices."""
    return N.mean_squared_cosine(em(t), "x", ["k"]).select("k", "n", r6("shared", "shared"))


@query("s17_canonical_angles")
def s17_angles(t):
    """Canonical correlations of the two halves of the vectors; a 64 x 64 Gram matrix comes to the driver."""
    return N.canonical_angles(em(t), "x").select("i", r6("cosine", "cosine"), r6("degrees", "degrees"))


@query("w32_alignment_sweep", f"""
WITH {EV},
gr AS (SELECT sc, off FROM (SELECT unnest([0.5, 1.0, 2.0]) AS sc), (SELECT unnest([-4, 0, 4]) AS off)),
z AS (SELECT sc, off, s.v, coalesce(q.e = 'error', false) AS y FROM s, gr LEFT JOIN s q ON q.k = s.k AND q.i = CAST(floor(s.i * sc) AS BIGINT) + off),
g AS (SELECT sc, off, v, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n FROM z GROUP BY ALL),
w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY sc, off ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT sc::DOUBLE AS scale, CAST(off AS BIGINT) AS shift, round((sum(p * (below + n / 2.0)) / (sum(p) * sum(n)))::DOUBLE, 6) AS auc
FROM w
GROUP BY 1, 2
""")
def w32(t):
    d = ev(t)
    grid = F.array(*[F.struct(F.lit(s).alias("scale"), F.lit(o).cast("long").alias("shift")) for s in (0.5, 1.0, 2.0) for o in (-4, 0, 4)])
    moved = d.select("k", "i", "v", F.explode(grid).alias("g")).select("k", "v", "g.*", (F.floor(F.col("i") * F.col("g.scale")) + F.col("g.shift")).alias("i"))
    hit = d.where("e = 'error'").select("k", "i", F.lit(True).alias("y"))
    j = moved.join(hit.hint("merge"), ["k", "i"], "left").withColumn("y", F.coalesce("y", F.lit(False)))
    return N.auc(j, "v", F.col("y"), ["scale", "shift"]).select("scale", "shift", r6("auc", "auc"))


@query("s02_row_bootstrap_of_rank_correlation", f"""
WITH {_LAB},
a AS (SELECT n_chars AS x, length(source) + (doc_id % 13) AS y, row_number() OVER (ORDER BY doc_id) - 1 AS id, count(*) OVER () AS m FROM lj),
d AS (SELECT b, ('0x' || substr(md5('r:' || b || ':' || j.id), 1, 8))::BIGINT % j.m AS id FROM range(0, {WHOLE_B}) q(b), a j),
s AS (SELECT b, x, y FROM d JOIN a USING (id)),
r AS (SELECT b, rank() OVER (PARTITION BY b ORDER BY x) + (count(*) OVER (PARTITION BY b, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER
  (PARTITION BY b ORDER BY y) + (count(*) OVER (PARTITION BY b, y) - 1) / 2.0::DOUBLE AS ry FROM s),
c AS (SELECT b, corr(rx, ry) AS rho FROM r GROUP BY b)
SELECT round(quantile_cont(rho, 0.025), 6) AS lo, round(median(rho), 6) AS mid, round(quantile_cont(rho, 0.975), 6) AS hi
FROM c
""")
def s02(t):
    d = labelled(t).select("doc_id", F.col("n_chars").alias("x"), (F.length("source") + F.col("doc_id") % 13).alias("y"))
    rho = N.bootstrap_spearman(d, "x", "y", ["doc_id"], WHOLE_B, "r")
    return rho.agg(r6(F.percentile("rho", F.lit(0.025)), "lo"), r6(F.median("rho"), "mid"), r6(F.percentile("rho", F.lit(0.975)), "hi"))


_CUES = {"question": r"(?i)(?:^|[^\p{L}])(que|what|was)(?:$|[^\p{L}])", "quantity": r"\d", "emphasis": r"[!?]", "aside": r"[(\[]"}
_FEATS = {"size": "avg(length(text))", "turns": "count(*)::DOUBLE", "words": "avg(len(string_split(text, ' ')))", "lines": "avg(len(string_split(text, chr(10))))"}
_PAIRED = "c AS (SELECT conv_id, " + ", ".join(f"max(regexp_matches(text, '{p}')::INT) AS c_{k}" for k, p in _CUES.items()) + ", " + ", ".join(f"{e} AS f_{k}" for k, e in _FEATS.items()) + """
 FROM conversations GROUP BY 1), f AS (SELECT cue || '/' || feature AS pair, cue, feature, conv_id, y, x
FROM (SELECT conv_id, unnest([
""" + ", ".join(f"'{k}'" for k in _CUES) + "]) AS cue, unnest([" + ", ".join(f"c_{k}" for k in _CUES) + "]) AS y, " + ", ".join(f"f_{k}" for k in _FEATS) + " FROM c), LATERAL (SELECT unnest([" + ", ".join(f"'{k}'" for k in _FEATS) + "]) AS feature, unnest([" + ", ".join(f"f_{k}" for k in _FEATS) + "]) AS x))"


@query("s09_cue_feature_grounding", f"""
WITH {_PAIRED},
{_permuted_sql(BY_GROUP, 'f', 'pair', 'conv_id')},
pv AS (SELECT pair, (count(*) FILTER (WHERE abs(d) >= abs(o) - 1e-9) + 1) / (count(*) + 1.0::DOUBLE) AS p FROM nl JOIN ob USING (pair) GROUP BY 1),
ef AS (SELECT pair, any_value(cue) AS cue, any_value(feature) AS feature, count(*) AS rows, count(*) FILTER (WHERE y = 1) AS n,
  (avg(x) FILTER (WHERE y = 1) - avg(x) FILTER (WHERE y = 0)) / nullif(sqrt((var_pop(x) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 1) +
  var_pop(x) FILTER (WHERE y = 0) * count(*) FILTER (WHERE y = 0)) / count(*)), 0) AS effect FROM f GROUP BY 1),
j AS (SELECT ef.*, p, p IS NOT NULL AND n >= 8 AND rows - n >= 8 AS ok FROM ef LEFT JOIN pv USING (pair))
SELECT cue, feature, n, round(effect, 5) AS effect, round(p, 6) AS p, ok AS interpretable, CASE WHEN ok THEN
  round(least(1.0, p * count(*) FILTER (WHERE ok) OVER ()), 6) END AS adjusted
FROM j
""")
def s09(t):
    """Every cue against every feature: effect, permutation p and its correction over the tests that can be read."""
    flag = lambda p: F.bool_or(F.col("text").rlike(p))
    feats = {"size": F.avg(F.length("text")), "turns": F.count("*").cast("double"), "words": F.avg(F.size(F.split("text", " "))), "lines": F.avg(F.size(F.split("text", "\n")))}
    c = t("conversations").groupBy("conv_id").agg(*[flag(p).alias(f"c_{k}") for k, p in _CUES.items()], *[f.alias(f"f_{k}") for k, f in feats.items()])
    d = c.select("conv_id", F.explode(F.create_map(*[x for k in _CUES for x in (F.lit(k), F.col(f"c_{k}"))])).alias("cue", "y"), *[f"f_{k}" for k in feats])
    d = d.select("conv_id", "cue", "y", F.explode(F.create_map(*[x for k in feats for x in (F.lit(k), F.col(f"f_{k}"))])).alias("feature", "x")).withColumn("pair", F.concat_ws("/", "cue", "feature"))
    d = N.written(d)
    e = d.groupBy("pair").agg(F.first("cue").alias("cue"), F.first("feature").alias("feature"), F.count("*").alias("all"), F.count_if("y").alias("n"), N.std_mean_diff("x", F.col("y")).alias("effect"))
    p = N.permutation_test(d, "x", "y", "conv_id", BY_GROUP, by=["pair"], slack=1e-9).select("pair", "p")
    j = e.join(p.hint("merge"), "pair", "left")
    ok = F.col("p").isNotNull() & (F.col("n") >= 8) & (F.col("all") - F.col("n") >= 8)
    return N.bonferroni(j, "p", ok).select("cue", "feature", "n", F.round("effect", 5).alias("effect"), r6("p", "p"), ok.alias("interpretable"), r6("adjusted", "adjusted"))


@query("s10_audit_with_null_model", f"""
WITH {EV},
{WINDOWS},
{PAIRS},
nul AS (SELECT mt.k, ('0x' || substr(md5('n:' || k || ':' || c), 1, 8))::BIGINT / 4294967296.0::DOUBLE -
  ('0x' || substr(md5('n:' || k || ':' || d), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS diff FROM mt)
SELECT 'real' AS model, count(*) AS pairs, round(avg(diff), 6) AS shift
FROM mt
UNION ALL SELECT 'null', count(*), round(avg(diff), 6)
FROM nul
""")
def s10(t):
    m = matched(t)
    u = lambda c: N.draw(F.lit("n"), F.col("k"), F.col(c)) / 4294967296.0
    null = m.select(F.lit("null").alias("model"), (u("case") - u("control")).alias("diff"))
    both = match_diffs(t).select(F.lit("real").alias("model"), "diff").union(null)
    return both.groupBy("model").agg(F.count("*").alias("pairs"), r6(F.avg("diff"), "shift"))


#: Markers of windows: a share of one event type; the placebos are the same series of marks, turned by half their length
_MARKS = ["signup", "purchase", "click"]
_AUDIT_WINDOWS = (
    "w0 AS (SELECT wd.k, CAST(lo // 8 AS BIGINT) AS win, avg(v) AS amp, avg(p) AS pace, avg(CASE WHEN e = 'error' THEN 1.0 ELSE 0 END) AS real, "
    + ", ".join(f"avg(CASE WHEN e = '{m}' THEN 1.0 ELSE 0 END) >= 0.25 AS m_{m}" for m in _MARKS)
    + " FROM (SELECT k, unnest(range(0, n - 15, 8)) AS lo FROM (SELECT k, count(*) AS n FROM s GROUP BY k) WHERE n >= 16) wd JOIN s ON s.k = wd.k AND s.i >= lo AND s.i < lo + 16 GROUP BY wd.k, lo), "
    "wn AS (SELECT *, ('0x' || substr(md5('n:' || k || ':' || win), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS \"null\", win >= 1 AS inside, count(*) OVER (PARTITION BY k) AS nw FROM w0), "
    "mk AS (SELECT k, win, nw, unnest([" + ", ".join(f"{{'marker': '{m}', 'marked': m_{m}}}" for m in _MARKS) + "], recursive := true) FROM wn), "
    "fm AS (SELECT k, win, marker, 'markers' AS family, marked FROM mk UNION ALL SELECT k, (win + nw // 2) % nw, marker, 'placebo', marked FROM mk), "
    "sd AS (SELECT stddev_pop(amp) AS sa, stddev_pop(pace) AS sp FROM wn), "
    "x AS (SELECT fm.*, amp, pace, real, \"null\", inside FROM fm JOIN wn USING (k, win)), "
    "pr AS (SELECT a.k, a.family, a.marker, a.inside AND b.inside AS inside, a.win AS c, b.win AS d, round(pow((a.amp - b.amp) / sa, 2) + pow((a.pace - b.pace) / sp, 2), 12) AS d2, a.real - b.real AS real, a.\"null\" - b.\"null\" AS nul FROM x a JOIN x b ON a.k = b.k AND a.family = b.family AND a.marker = b.marker AND a.marked AND NOT b.marked JOIN sd ON true WHERE pow((a.amp - b.amp) / sa, 2) + pow((a.pace - b.pace) / sp, 2) <= 1), "
    "mt0 AS (SELECT k, family, marker, c, arg_min(inside, (d2, d)) AS inside, arg_min(real, (d2, d)) AS real, arg_min(nul, (d2, d)) AS nul FROM pr GROUP BY ALL), "
    "mt1 AS (SELECT k, family, marker, inside, unnest(['real', 'null']) AS model, unnest([real, nul]) AS diff FROM mt0), "
    "mt AS (SELECT k, family, marker, model, 'sensitivity' AS subset, diff FROM mt1 UNION ALL SELECT k, family, marker, model, 'primary', diff FROM mt1 WHERE inside), "
    "c0 AS (SELECT family, marker, model, subset, k, sum(diff) AS s, count(*) AS n FROM mt GROUP BY ALL), "
    "sz AS (SELECT family, marker, model, subset, count(*) AS m, sum(s) AS s, sum(n) AS n FROM c0 GROUP BY ALL), "
    f"dr AS (SELECT *, {_COPIES} AS w FROM (SELECT *, ('0x' || substr(md5('b:' || b || ':' || k), 1, 8))::BIGINT AS h FROM c0, range(0, 400) r(b))), "
    "bm AS (SELECT family, marker, model, subset, b, sum(w * s) / sum(w * n) AS mean FROM dr GROUP BY family, marker, model, subset, b HAVING sum(w) > 0), "
    "bs AS (SELECT family, marker, model, subset, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi, avg((mean <= 0)::INT) AS below, avg((mean >= 0)::INT) AS above FROM bm GROUP BY ALL), "
    "ad AS (SELECT family, marker, model, subset, m, n, s / n AS shift, CASE WHEN m >= 10 THEN lo END AS lo, CASE WHEN m >= 10 THEN hi END AS hi, CASE WHEN m >= 10 THEN greatest(1.0 / 400, least(1.0, 2 * least(below, above))) END AS p FROM sz JOIN bs USING (family, marker, model, subset))"
)


@query("s10_full_audit", f"""
WITH {EV},
{_AUDIT_WINDOWS}
SELECT family, marker, model, subset, m AS clusters, CAST(n AS BIGINT) AS pairs, round(shift, 6) AS shift, round(lo, 6) AS lo, round(hi, 6) AS hi,
  round(p, 6) AS p, round(CASE WHEN p IS NOT NULL THEN least(1.0, p * count(p) OVER (PARTITION BY family, model, subset)) END, 6) AS adjusted
FROM ad
""")
def s10_full(t):
    """Matched shift of an outcome and of a random one (the null model) at every marker and at its placebo, over all
    windows and over those inside the span: cluster bootstrap interval, p, and p corrected within the family."""
    g = windowed(ev(t), 16, 8).groupBy("k", F.col("win").cast("long").alias("win"))
    share = lambda e: F.avg((F.col("e") == e).cast("double"))
    w = g.agg(F.avg("v").alias("amp"), F.avg("p").alias("pace"), share("error").alias("real"), *[(share(m) >= 0.25).alias(f"m_{m}") for m in _MARKS])
    w = N.written(w.withColumns({"null": N.draw(F.lit("n"), F.col("k"), F.col("win")) / 4294967296.0, "inside": F.col("win") >= 1, "nw": F.count(F.lit(1)).over(S.whole())}))
    marks = w.select("k", "win", "nw", F.explode(F.create_map(*[x for m in _MARKS for x in (F.lit(m), F.col(f"m_{m}"))])).alias("marker", "marked"))
    turned = marks.withColumn("win", (F.col("win") + F.floor(F.col("nw") / 2)) % F.col("nw"))
    both = marks.withColumn("family", F.lit("markers")).union(turned.withColumn("family", F.lit("placebo"))).drop("nw")
    x = w.select("k", "win", "amp", "pace", "real", "null", "inside")
    rows = N.written(both.join(x.hint("merge"), ["k", "win"]).withColumn("g", F.concat_ws("|", F.col("k").cast("string"), "family", "marker")))
    sds = w.agg(F.stddev_pop("amp").alias("amp"), F.stddev_pop("pace").alias("pace")).first().asDict()
    m = nearest_match(rows.where("marked"), rows.where("not marked"), "g", ["amp", "pace"], 1.0, "win", sds)
    side = lambda win, n: rows.select("g", F.col("win").alias(win), F.col("real").alias(f"real{n}"), F.col("null").alias(f"null{n}"), F.col("inside").alias(f"inside{n}"), *(["k", "family", "marker"] if n else []))
    j = m.join(side("case", 1).hint("merge"), ["g", "case"]).join(side("control", 0).hint("merge"), ["g", "control"])
    inside = F.col("inside1") & F.col("inside0")
    d = j.select("k", "family", "marker", inside.alias("inside"), F.explode(F.create_map(F.lit("real"), F.col("real1") - F.col("real0"), F.lit("null"), F.col("null1") - F.col("null0"))).alias("model", "diff"))
    d = d.withColumn("subset", F.explode(F.when(F.col("inside"), F.array(F.lit("sensitivity"), F.lit("primary"))).otherwise(F.array(F.lit("sensitivity")))))
    b = N.poisson_bootstrap(N.written(d), "k", "diff", 400, by=["family", "marker", "model", "subset"])
    return N.bonferroni(b, "p", F.col("p").isNotNull(), ["family", "model", "subset"]).select("family", "marker", "model", "subset", "clusters", "pairs", *[r6(c, c) for c in ("shift", "lo", "hi", "p", "adjusted")])


def signed_sums(x, seed, n=8, size=32):
    """``n`` sums of all ``size`` components with signs drawn once, scaled to the spread of a component."""
    sign = lambda r, j: 1 - 2 * (hashlib.md5(f"{seed}:{r}:{j}".encode()).digest()[0] & 1)
    rows = [F.array(*[F.lit(float(sign(r, j))) for j in range(size)]) for r in range(n)]
    dot = lambda s: F.aggregate(F.zip_with(x, s, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) / math.sqrt(size)
    return F.array(*[dot(s) for s in rows])


@query("s18_held_out_dependence")
def s18(t):
    """Whether the halves of the vectors depend on each other, by a model that tells real pairs from mixed ones, and
    for comparison whether the first half depends on a noisy copy of itself. Each half goes in as eight sums of all its
    components with random signs."""
    d = em(t).select("vec_id", signed_sums(F.slice("x", 1, 32), "a").alias("a"), signed_sums(F.slice("x", 33, 32), "b").alias("b"))
    noise = F.transform("a", lambda e, i: e + 0.05 * (N.draw(F.lit("noise"), F.col("vec_id"), i) / 4294967296.0 - 0.5))
    d = d.withColumn("c", noise)
    both = [L.dependence(d, "vec_id", "a", o).withColumn("pair", F.lit(n)) for n, o in (("halves", "b"), ("copies", "c"))]
    return both[0].union(both[1]).select("pair", "n", r6("accuracy", "accuracy"), r6("jsd", "jsd"), "verdict")


@query("m09_labelled_window_dataset", f"""
WITH {EV},
wd AS (SELECT k, unnest(range(0, n - 15, 8)) AS lo FROM (SELECT k, count(*) AS n FROM s GROUP BY k) WHERE n >= 16),
w AS (SELECT wd.k, CAST(lo // 8 AS BIGINT) AS win, avg(v) AS x, avg((e = 'signup')::INT) AS a, avg((e = 'purchase')::INT) AS b FROM wd JOIN s ON s.k =
  wd.k AND s.i >= lo AND s.i < lo + 16 GROUP BY wd.k, lo)
SELECT k, win, unnest(['signup', 'purchase']) AS label_source, unnest([a >= 0.25, b >= 0.25]) AS label, round(x, 6) AS x
FROM w
""")
def m09(t):
    share = lambda e: F.avg((F.col("e") == e).cast("double")) >= 0.25
    g = windowed(ev(t), 16, 8).groupBy("k", F.col("win").cast("long").alias("win")).agg(F.avg("v").alias("x"), share("signup").alias("a"), share("purchase").alias("b"))
    return g.select("k", "win", F.explode(F.create_map(F.lit("signup"), "a", F.lit("purchase"), "b")).alias("label_source", "label"), r6("x", "x"))


_U02 = ("value", "smoothed", "less the other axis")


@query("u02_signal_family", f"""
WITH {EV},
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
q AS (SELECT s.k, s.i, v, v - p AS o, (coalesce(lag(v) OVER w, v) + v + coalesce(lead(v) OVER w, v)) / 3 AS m, e = 'error' AS y FROM s WINDOW w AS
  (PARTITION BY s.k ORDER BY s.i)),
f AS (SELECT k % 4 AS g, y, unnest({list(_U02)!r}) AS name, unnest([round(v, 6), round(m, 6), round(o, 6)]) AS score FROM q),
g AS (SELECT g, name, score, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n FROM f GROUP BY ALL),
w2 AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY g, name ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT g, name, round((sum(p * (below + n / 2.0)) / (sum(p) * sum(n)))::DOUBLE, 6) AS auc
FROM w2
GROUP BY 1, 2
""")
def u02(t):
    """AUC of every signal of a named family in every group of users."""
    d = N.written(ev(t).select("k", "i", "v", "p", "e"))
    j = G.scores(d, "level").join(d.select("k", "i", "e").hint("merge"), ["k", "i"]).withColumn("g", F.col("k") % 4)
    return N.auc(j.select("g", "name", F.round("score", 6).alias("score"), "e"), "score", F.col("e") == "error", ["g", "name"]).select("g", "name", r6("auc", "auc"))

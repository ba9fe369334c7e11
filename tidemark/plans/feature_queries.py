"""Queries on the features of series and windows, vocabularies with their decoding, and streams beside a census."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.joins import sized
from tidemark.operators.ranks import written
from tidemark.operators.reports import vocabulary
from tidemark.operators.summary import FEATURES, ten_features
from tidemark.plans.registry import query
from tidemark.plans.reports_queries import _WORDS, words
from tidemark.plans.windows_queries import EV, ev, windowed
from tidemark.streaming import run as R

#: SQL of the ten features of series x(k, i, v, p)
_TEN = """
d0 AS (SELECT k, i, v, p, coalesce(sqrt(pow(v - lag(v) OVER w, 2) + pow(p - lag(p) OVER w, 2)), 0) * 24 AS sp,
  sqrt(pow(v - 3 * lag(v, 1) OVER w + 3 * lag(v, 2) OVER w - lag(v, 3) OVER w, 2) + pow(p - 3 * lag(p, 1) OVER w + 3 * lag(p, 2) OVER w - lag(p, 3) OVER w, 2)) AS j
  FROM x WINDOW w AS (PARTITION BY k ORDER BY i)),
d AS (SELECT *, sp > 200 AS act, lag(sp > 200) OVER (PARTITION BY k ORDER BY i) AS was, sp - avg(sp) OVER (PARTITION BY k) AS c FROM d0),
den AS (SELECT k, sum(c * c) AS q FROM d GROUP BY k HAVING sum(c * c) > 1e-12),
ac AS (SELECT a.k, b.i - a.i AS lag, sum(a.c * b.c) / any_value(q) AS r FROM d a JOIN d b ON a.k = b.k AND b.i >= a.i + 6 AND b.i <= a.i + 40 JOIN den ON den.k = a.k GROUP BY 1, 2),
pk AS (SELECT k, lag, r, lag(r) OVER w AS before, lead(r) OVER w AS after FROM ac WINDOW w AS (PARTITION BY k ORDER BY lag)),
rp AS (SELECT k, count(*) AS n FROM pk WHERE r > 0.15 AND r >= before AND r > after GROUP BY k),
f AS (SELECT k, avg(sp) AS speed, max(sp) AS peak_speed, sqrt(pow(max(v) - min(v), 2) + pow(max(p) - min(p), 2)) AS amplitude, (max(v) - min(v)) * (max(p) - min(p)) AS volume,
  avg((NOT act)::INT) AS pause_fraction, coalesce(count(*) FILTER (WHERE NOT act) / nullif(count(*) FILTER (WHERE NOT act AND (was IS NULL OR was)), 0) / 24, 0) AS pause_mean,
  coalesce(avg(j), 0) * 13824 AS jerk, count(*) FILTER (WHERE act AND (was IS NULL OR NOT was)) AS sign_count, 1 - avg((NOT act)::INT) AS active_fraction, count(*) AS n_frames, count(*) / 24 AS seconds
  FROM d GROUP BY k),
t AS (SELECT f.*, coalesce(rp.n, 0) AS repetition FROM f LEFT JOIN rp USING (k))"""
_WINDOWED = f"""WITH {EV},
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
wd AS (SELECT k, unnest(range(0, n - 15, 8)) AS lo FROM n WHERE n >= 16),
x AS (SELECT s.k || '|' || (lo // 8) AS k, s.i - lo AS i, v, p FROM wd JOIN s ON s.k = wd.k AND s.i >= lo AND s.i < lo + 16),{_TEN}"""
_ROUNDED = ", ".join(f"round({c}, 5) AS {c}" for c in FEATURES if c not in ("repetition", "sign_count", "jerk")) + ", round(jerk, 3) AS jerk, repetition, sign_count"


def rounded(d):
    whole = {"repetition": F.col("repetition"), "sign_count": F.col("sign_count"), "jerk": F.round("jerk", 3)}
    return [whole.get(c, F.round(c, 5)).alias(c) for c in FEATURES]


def window_features(t):
    """The ten features of windows of 16 rows, 8 apart."""
    w = windowed(ev(t), 16, 8)
    own = w.select(F.concat_ws("|", F.col("k").cast("string"), F.col("win").cast("string")).alias("k"), (F.col("i") - 8 * F.col("win")).alias("i"), "v", "p")
    f = ten_features(own)
    part = F.split("k", r"\|")
    return f.withColumns({"win": part[1].cast("long"), "k": part[0].cast("long")})


@query("w28_ten_features_of_series", f"WITH {EV}, x AS (SELECT k, i, v, p FROM s),{_TEN} SELECT k, {_ROUNDED}, n_frames, round(seconds, 5) AS seconds FROM t")
def w28_series(t):
    d = ten_features(ev(t))
    return d.select("k", *rounded(d), "n_frames", F.round("seconds", 5).alias("seconds"))


@query("w28_ten_features_of_windows", f"""
{_WINDOWED} SELECT CAST(split_part(k, '|', 1) AS BIGINT) AS k, CAST(split_part(k, '|', 2) AS BIGINT) AS win,
{_ROUNDED}
FROM t
""")
def w28_windows(t):
    d = window_features(t)
    return d.select("k", "win", *rounded(d))


M09_SQL = f"""{_WINDOWED},
e AS (SELECT wd.k || '|' || (lo // 8) AS k, avg((e = 'signup')::INT) >= 0.25 AS a, avg((e = 'purchase')::INT) >= 0.25 AS b FROM wd JOIN s ON s.k = wd.k AND s.i >= lo AND s.i < lo + 16 GROUP BY wd.k, lo)
SELECT CAST(split_part(t.k, '|', 1) AS BIGINT) AS k, CAST(split_part(t.k, '|', 2) AS BIGINT) AS win, unnest(['signup', 'purchase']) AS label_source, unnest([a, b]) AS label, {_ROUNDED}
FROM t JOIN e USING (k)
"""


@query("m09_windows_with_ten_features", M09_SQL)
def m09_features(t):
    """A row for each window and source of labels: whether the window is marked, and its ten features."""
    share = lambda e: F.avg((F.col("e") == e).cast("double")) >= 0.25
    marks = windowed(ev(t), 16, 8).groupBy("k", F.col("win").cast("long").alias("win")).agg(share("signup").alias("signup"), share("purchase").alias("purchase"))
    d = window_features(t)
    j = d.join(marks.hint("merge"), ["k", "win"])
    both = F.explode(F.create_map(F.lit("signup"), "signup", F.lit("purchase"), "purchase")).alias("label_source", "label")
    return j.select("k", "win", both, *rounded(d))


@query("d04_encoded_and_decoded", f"""
WITH {_WORDS},
p AS (SELECT conv_id, turn, tk, unnest(range(len(tk))) AS i, unnest(tk) AS token FROM k)
SELECT conv_id, turn, list(coalesce(id, -1) ORDER BY i) AS ids, list(CASE WHEN id IS NULL THEN '?' ELSE token END ORDER BY i) AS decoded
FROM p
LEFT JOIN v USING (token)
GROUP BY 1, 2
""")
def d04_decoded(t):
    """Every text as ids and back: ids by the vocabulary, then tokens by the ids, ``?`` where the vocabulary has none."""
    w = words(t, True)
    v = written(vocabulary(w, "token", 2).select("token", F.col("id").cast("long").alias("id")))
    coded = w.join(sized(v), "token", "left").select("conv_id", "turn", "i", F.coalesce("id", F.lit(-1).cast("long")).alias("id"))
    read = coded.join(sized(v.withColumnRenamed("token", "back")), "id", "left")
    one = F.array_sort(F.collect_list(F.struct("i", "id", F.coalesce("back", F.lit("?")).alias("back"))))
    return read.groupBy("conv_id", "turn").agg(one.alias("t")).select("conv_id", "turn", F.col("t.id").alias("ids"), F.col("t.back").alias("decoded"))


@query("d04_vocabulary_report", f"""
WITH {_WORDS},
a AS (SELECT token, count(*) AS n FROM w GROUP BY 1)
SELECT count(*) AS types, CAST(sum(n) AS BIGINT) AS tokens, count(*) FILTER (WHERE n = 1) AS hapax, (SELECT
  list(token || ' ' || n ORDER BY n DESC, token) FROM (SELECT * FROM a ORDER BY n DESC, token LIMIT 20)) AS top
FROM a
""")
def d04_report(t):
    """Types, tokens, words that occur once, and the twenty most frequent."""
    c = written(words(t).groupBy("token").agg(F.count("*").alias("n")))
    top = c.orderBy(F.desc("n"), "token").limit(20)
    line = F.transform(F.array_sort(F.collect_list(F.struct(F.negative("n").alias("m"), "token"))), lambda s: F.concat_ws(" ", s["token"], F.negative(s["m"]).cast("string")))
    return c.agg(F.count("*").alias("types"), F.sum("n").alias("tokens"), F.count_if(F.col("n") == 1).alias("hapax")).crossJoin(F.broadcast(top.agg(line.alias("top"))))  # one row each


@query("r03_stream_beside_a_census", """
WITH c AS (SELECT event_type, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd FROM events GROUP BY 1)
SELECT event_id, n, round((value - mean) / nullif(sd, 0), 6) AS z
FROM events
JOIN c USING (event_type)
""")
def r03_census(t):
    """Every live event beside the census of its kind over the stored corpus."""
    c = written(t("events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")))
    s = R.read_stream(t.spark, t.sf_dir, "events").select("event_id", "event_type", "value")
    z = (F.col("value") - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0))
    return R.drain(s.join(sized(c), "event_type").select("event_id", "n", F.round(z, 6).alias("z")))

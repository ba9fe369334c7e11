"""Series and window queries. Series are the events of a user in time order, or the embeddings of a label in id order."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import filters as X
from tidemark.operators import series as S
from tidemark.plans.registry import query

EV = """
s AS (SELECT user_id AS k, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS i, value AS v, event_type AS e, ts,
  event_id, CAST(props->>'$.k' AS DOUBLE) AS p FROM events)
"""
HOLES = EV + ", h AS (SELECT k, i, CASE WHEN i % 7 IN (2, 3) OR i % 23 BETWEEN 10 AND 16 THEN NULL ELSE v END AS v FROM s)"
ARR = EV + ", a AS (SELECT k, list(v ORDER BY i) AS a FROM s GROUP BY k)"
EM = """
m AS (SELECT label AS k, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS i, vec_id,
  list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings)
"""


def ev(t):
    e = S.number_rows(t("events"), "user_id", "ts", "event_id")
    return e.select(F.col("user_id").alias("k"), "i", F.col("value").alias("v"), F.col("event_type").alias("e"), "ts", "event_id", F.get_json_object("props", "$.k").cast("double").alias("p"))


def holes(t):
    gap = (F.col("i") % 7).isin(2, 3) | (F.col("i") % 23).between(10, 16)
    return ev(t).select("k", "i", F.when(~gap, F.col("v")).alias("v"))


def em(t):
    e = S.number_rows(t("embeddings"), "label", "vec_id")
    return e.select(F.col("label").alias("k"), "i", "vec_id", F.col("embedding").cast("array<double>").alias("x"))


def r6(c, name):
    return F.round(c, 6).alias(name)


def lengths(t):
    return t("events").groupBy(F.col("user_id").alias("k")).agg(F.count("*").alias("n"))


@query("w01_window_edges", f"""
WITH {EV},
n AS (SELECT k, count(*) AS n FROM s GROUP BY k)
SELECT k, CAST(start // 8 AS INTEGER) AS win, start, CAST(16 AS BIGINT) AS len, false AS partial
FROM (SELECT k, unnest(range(0, n - 15, 8)) AS start FROM n WHERE n >= 16)
UNION ALL SELECT k, 0, 0, n, true
FROM n
WHERE n < 16
""")
def w01(t):
    return S.window_edges(lengths(t), 16, 8, keep_short=True)


@query("w02_resample_nearest", f"""
WITH {EV},
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
g AS (SELECT k, n, unnest(range(0, CAST(least(40, greatest(1, round_even(n / 30.0 * 12, 0))) AS BIGINT))) AS j FROM n)
SELECT g.k, j, s.i, v
FROM g
JOIN s ON s.k = g.k AND s.i = least(CAST(round_even(j / 12.0::DOUBLE * 30, 0) AS BIGINT), n - 1)
""")
def w02(t):
    return S.resample(ev(t).select("k", "i", "v"), 30, 12, max_frames=40).select("k", "j", "i", "v")


@query("w03_every_nth_and_cap", f"WITH {EV} SELECT k, i, v FROM s WHERE i % 3 = 0 AND i < 60")
def w03(t):
    return ev(t).where("i % 3 = 0 and i < 60").select("k", "i", "v")


@query("w04_interpolate_gaps", f"""
WITH {HOLES},
z AS (SELECT k, i, v, max(CASE WHEN v IS NOT NULL THEN i END) OVER w AS i0, min(CASE WHEN v IS NOT NULL THEN i END) OVER u AS i1 FROM h WINDOW w AS
  (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING), u AS (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT z.k, z.i, CASE WHEN z.v IS NOT NULL THEN z.v WHEN i0 IS NOT NULL AND i1 IS NOT NULL AND i1 - i0 - 1 <= 3 THEN a.v + (b.v - a.v) *
  (z.i - i0) / (i1 - i0) END AS filled FROM z LEFT JOIN h a ON a.k = z.k AND a.i = i0 LEFT JOIN h b ON b.k = z.k AND b.i = i1)
SELECT k, i, round(filled, 6) AS filled, filled IS NOT NULL AS valid
FROM f
""")
def w04(t):
    return S.interpolate(holes(t), "v", 3).select("k", "i", r6("filled", "filled"), "valid")


@query("w05_carry_forward", f"""
WITH {HOLES} SELECT k, i, (SELECT b.v FROM h b WHERE b.k = h.k AND b.i <= h.i AND b.v IS NOT NULL ORDER BY b.i DESC LIMIT 1) AS v
FROM h
""")
def w05(t):
    return holes(t).select("k", "i", S.carry_forward("v").alias("v"))


@query("w06_centre_and_scale", f"""
WITH {EM},
p AS (SELECT k, i, CASE WHEN i % 9 <> 4 THEN (x[1] + x[2]) / 2 ELSE x[5] END AS cx, CASE WHEN i % 9 <> 4 THEN abs(x[1] - x[2]) END AS raw, x FROM m),
z AS (SELECT *, coalesce(raw, (SELECT q.raw FROM p q WHERE q.k = p.k AND q.i = p.i - 1) + ((SELECT q.raw FROM p q WHERE q.k = p.k AND q.i = p.i + 1) -
  (SELECT q.raw FROM p q WHERE q.k = p.k AND q.i = p.i - 1)) / 2) AS sc FROM p)
SELECT k, i, round(cx, 6) AS anchor, round(sc, 6) AS scale, CASE WHEN sc > 1e-6 THEN list_transform(x, lambda e: round((e - cx) / sc, 4) + 0.0) END AS y
FROM z
""")
def w06(t):
    gone = F.col("i") % 9 == 4
    d = em(t).withColumn("cx", F.when(gone, F.col("x")[4]).otherwise((F.col("x")[0] + F.col("x")[1]) / 2)).withColumn("raw", F.when(~gone, F.abs(F.col("x")[0] - F.col("x")[1])))
    d = S.interpolate(d, "raw", 3).withColumnRenamed("filled", "sc")
    y = F.when(F.col("sc") > 1e-6, F.transform("x", lambda e: F.round((e - F.col("cx")) / F.col("sc"), 4)))
    return d.select("k", "i", r6("cx", "anchor"), r6("sc", "scale"), y.alias("y"))


@query("w07_body_relative_frame", f"""
WITH {EM},
p AS (SELECT *, (x[1] + x[3]) / 2 AS ox, (x[2] + x[4]) / 2 AS oy, sqrt((x[3] - x[1]) * (x[3] - x[1]) + (x[4] - x[2]) * (x[4] - x[2])) AS w,
  atan2(x[4] - x[2], x[3] - x[1]) AS a FROM m)
SELECT k, i, CASE WHEN w > 0.05 THEN round(((x[5] - ox) * cos(a) + (x[6] - oy) * sin(a)) / w, 6) END AS u, CASE WHEN w > 0.05 THEN
  round(((x[6] - oy) * cos(a) - (x[5] - ox) * sin(a)) / w, 6) END AS y, round(CASE WHEN a > pi() / 2 THEN a - pi() WHEN a < -pi() / 2 THEN a + pi()
  ELSE a END, 6) AS tilt
FROM p
""")
def w07(t):
    x = lambda j: F.col("x")[j]
    d = em(t).withColumns({"ox": (x(0) + x(2)) / 2, "oy": (x(1) + x(3)) / 2, "w": F.hypot(x(2) - x(0), x(3) - x(1)), "a": F.atan2(x(3) - x(1), x(2) - x(0))})
    dx, dy, a, w = x(4) - F.col("ox"), x(5) - F.col("oy"), F.col("a"), F.col("w")
    ok = w > 0.05
    tilt = F.when(a > math.pi / 2, a - math.pi).when(a < -math.pi / 2, a + math.pi).otherwise(a)
    return d.select("k", "i", F.when(ok, F.round((dx * F.cos(a) + dy * F.sin(a)) / w, 6)).alias("u"), F.when(ok, F.round((dy * F.cos(a) - dx * F.sin(a)) / w, 6)).alias("y"), r6(tilt, "tilt"))


def _held(lo, hi, f, name, arr="a"):
    return f"{f}(list_transform(range({-lo}, {hi + 1}), lambda j: {arr}[greatest(least(i + j, len({arr}) - 1), 0) + 1])) AS {name}"


@query("w08_moving_average", f"WITH {ARR} SELECT k, i, round(y, 6) AS y FROM (SELECT k, i, {_held(2, 1, 'list_avg', 'y')} FROM s JOIN a USING (k))")
def w08(t):
    return ev(t).select("k", "i", r6(S.moving_average("v", 4), "y"))


@query("w09_rolling_std", f"""
WITH {EV} SELECT k, i, round(stddev_pop(v) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS sd
FROM s
""")
def w09(t):
    return ev(t).select("k", "i", r6(S.rolling_std("v", 5), "sd"))


@query("w10_rolling_median", f"WITH {ARR} SELECT k, i, {_held(3, 3, 'list_median', 'y')} FROM s JOIN a USING (k)")
def w10(t):
    return ev(t).select("k", "i", S.median_of(S.held_frame("v", 3)).alias("y"))


GAUSS = [math.exp(-0.5 * (j / 1.5) ** 2) for j in range(-4, 5)]
GAUSS = [g / sum(GAUSS) for g in GAUSS]
_G = "[" + ", ".join(f"{g!r}::DOUBLE" for g in GAUSS) + "]"


@query("w11_gaussian_smoothing", f"""
WITH {ARR} SELECT k, i, round(y, 6) AS y
FROM (SELECT k, i, list_sum(list_transform(range(-4, 5), lambda j: a[greatest(least(i + j, len(a) - 1), 0) + 1] * ({_G})[j + 5])) AS y FROM s JOIN a
  USING (k))
""")
def w11(t):
    return ev(t).select("k", "i", r6(S.weighted(S.held_frame("v", 4), GAUSS), "y"))


@query("w12_sign_continuous_smoothing", f"""
WITH {EM},
d AS (SELECT k, i, x, list_inner_product(x, lag(x) OVER (PARTITION BY k ORDER BY i)) AS dp FROM m),
f AS (SELECT k, i, x, CASE WHEN sum(CASE WHEN dp < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) % 2 = 1 THEN -1 ELSE 1 END AS sg FROM d),
g AS (SELECT k, i, j, avg(x[j] * sg) OVER (PARTITION BY k, j ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS e FROM f, range(1, 65) r(j))
SELECT k, i, list_transform(list(e ORDER BY j), lambda y: round(y / sqrt(list_sum(list_transform(list(e ORDER BY j), lambda z: z * z))), 5) + 0.0) AS q
FROM g
GROUP BY k, i
""")
def w12(t):
    """Whole vectors: each takes the sign that agrees with the one before, five are averaged, the mean is made a unit."""
    w = S.over()
    dot = F.aggregate(F.zip_with("x", F.lag("x").over(w), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    d = em(t).select("k", "i", "x").withColumn("flip", F.coalesce((dot < 0).cast("int"), F.lit(0)))
    d = d.withColumn("sign", F.when(F.sum("flip").over(w) % 2 == 1, -1.0).otherwise(1.0))
    near = F.collect_list(F.transform("x", lambda e: e * F.col("sign"))).over(w.rowsBetween(-2, 2))
    d = d.select("k", "i", near.alias("near")).withColumn("y", F.aggregate(F.slice("near", 2, 4), F.col("near")[0], lambda a, b: F.zip_with(a, b, lambda p, q: p + q)))
    norm = F.sqrt(F.aggregate("y", F.lit(0.0), lambda a, e: a + e * e))
    return d.withColumn("_n", norm).select("k", "i", F.transform("y", lambda e: F.round(e / F.col("_n"), 5)).alias("q"))


@query("w13_band_energy", f"""
WITH {ARR},
b AS (SELECT k, i, {_held(1, 1, 'list_avg', 'f')}, {_held(8, 8, 'list_avg', 'g')} FROM s JOIN a USING (k)),
q AS (SELECT k, list((f - g) * (f - g) ORDER BY i) AS c FROM b GROUP BY k)
SELECT k, i, round(sqrt({_held(9, 9, 'list_avg', 'y', 'c')[:-5]}), 6) AS energy
FROM b
JOIN q USING (k)
""")
def w13(t):
    return S.band_energy(ev(t), "v", 3, 17, 19).select("k", "i", r6("energy", "energy"))


DT = 1 / 24
A_FAST, A_SLOW, A_HOLD = (1 - math.exp(-DT / tau) for tau in (0.08, 0.5, 0.6))


SHARES = (A_FAST, A_SLOW, A_HOLD)


def causal_band_rms(df, value="v"):
    """Causal band energy of a series: exponential means fast, slow and of the squared difference; adds nothing from the future."""
    return S.fold_long(df, lambda v: X.band_energy(v, SHARES, None)[1], value)


W14_SQL = f"""
WITH RECURSIVE {EV},
r AS (SELECT k, i, v AS f, v AS g, 0.0::DOUBLE AS en FROM s WHERE i = 0 UNION ALL SELECT s.k, s.i, f + {A_FAST!r} * (v - f), g + {A_SLOW!r} * (v - g),
  en + {A_HOLD!r} * (pow(f + {A_FAST!r} * (v - f) - g - {A_SLOW!r} * (v - g), 2) - en) FROM r JOIN s ON s.k = r.k AND s.i = r.i + 1)
SELECT k, i, round(sqrt(en), 6) AS y
FROM r
"""


@query("w14_causal_band_rms", W14_SQL)
def w14(t):
    return causal_band_rms(ev(t)).select("k", "i", r6("y", "y"))


LEAST = 25.0


def reversals(df, value="v"):
    """Turns of a series by at least ``LEAST``, and their level over the last 24 rows."""

    def make(v):
        flags, _, _ = X.turns(v, LEAST, 0.0, float(v[0]))
        return flags.astype("int32"), np.minimum(X.recent(flags, np.arange(len(v)), 24, np.zeros(0))[0] / 3.0, 1.2)

    return S.fold_long(df, make, value, "rev int, level double")


def turns_sql(key, kept, source):
    """Recursive SQL of the turns: the way of the movement and the furthest value on it since the last turn."""
    moved = f"abs(v - reach) >= {LEAST!r}"
    back = f"way * (reach - v) >= {LEAST!r}"
    return (
        f"tn AS (SELECT {key}, i, {', '.join(kept)}, 0.0::DOUBLE AS way, v AS reach, 0 AS rev FROM {source} WHERE i = 0 UNION ALL "
        f"SELECT s.{key}, s.i, {', '.join('s.' + c for c in kept)}, CASE WHEN way = 0 THEN (CASE WHEN {moved} THEN sign(v - reach) ELSE 0 END) WHEN {back} THEN -way ELSE way END, "
        f"CASE WHEN way = 0 THEN (CASE WHEN {moved} THEN v ELSE reach END) WHEN {back} THEN v ELSE way * greatest(way * reach, way * v) END, "
        f"CASE WHEN way <> 0 AND {back} THEN 1 ELSE 0 END FROM tn JOIN {source} s ON s.{key} = tn.{key} AND s.i = tn.i + 1)"
    )


W15_SQL = f"""
WITH RECURSIVE {EV},
{turns_sql('k', ['event_id'], 's')}
SELECT k, i, rev, round(least(sum(rev) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) / 3.0::DOUBLE, 1.2), 6) AS level
FROM tn
"""


@query("w15_reversal_level", W15_SQL)
def w15(t):
    return reversals(ev(t)).select("k", "i", "rev", r6("level", "level"))


_BAND = """
r AS (SELECT k, i, v AS f, v AS g, 0.0::DOUBLE AS en, p AS f2, p AS g2, 0.0::DOUBLE AS e2 FROM s WHERE i = 0 UNION ALL SELECT s.k, s.i, 
""" + ", ".join(f"f{n} + {A_FAST!r} * ({c} - f{n}), g{n} + {A_SLOW!r} * ({c} - g{n}), e{n or 'n'} + {A_HOLD!r} * (pow(f{n} + {A_FAST!r} * ({c} - f{n}) - g{n} - {A_SLOW!r} * ({c} - g{n}), 2) - e{n or 'n'})" for n, c in (("", "v"), ("2", "p"))) + " FROM r JOIN s ON s.k = r.k AND s.i = r.i + 1)"


@query("w16_axis_contrast", f"""
WITH RECURSIVE {EV},
{_BAND},
{turns_sql('k', ['event_id'], 's')},
nt AS (SELECT k, i, sum(rev) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) AS n FROM tn)
SELECT r.k, r.i, round(greatest(sqrt(en) - 0.5 * sqrt(e2), 0), 6) AS level, sqrt(en) - 0.5 * sqrt(e2) >= 5 AND n >= 2 AS on_
FROM r
JOIN nt ON nt.k = r.k AND nt.i = r.i
""")
def w16(t):
    """Energy of one axis less half the other's; on where it is high and the axis has turned twice in the last 24 rows."""

    def make(v, p):
        own, other = X.band_energy(v, SHARES, None)[1], X.band_energy(p, SHARES, None)[1]
        flags, _, _ = X.turns(v, LEAST, 0.0, float(v[0]))
        n, _ = X.recent(flags, np.arange(len(v)), 24, np.zeros(0))
        c = own - 0.5 * other
        return np.maximum(c, 0.0), (c >= 5) & (n >= 2)

    return S.fold_long(ev(t), make, ["v", "p"], "level double, on_ boolean").select("k", "i", r6("level", "level"), "on_")


RING = 600


@query("w17_adaptive_level", f"""
WITH {EV},
q AS (SELECT k, i, CASE WHEN i % 8 = 0 THEN quantile_cont(v, 0.2) OVER w END AS lo, CASE WHEN i % 8 = 0 THEN quantile_cont(v, 0.95) OVER w END AS hi,
  v FROM s WINDOW w AS (PARTITION BY k ORDER BY i ROWS BETWEEN 599 PRECEDING AND CURRENT ROW)),
f AS (SELECT k, i, v, last_value(lo IGNORE NULLS) OVER z AS lo, last_value(hi IGNORE NULLS) OVER z AS hi FROM q WINDOW z AS
  (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING))
SELECT k, i, round(CASE WHEN hi > lo THEN greatest(0, (v - lo) / (hi - lo)) ELSE 0 END, 6) AS level
FROM f
""")
def w17(t):
    return S.fold_long(ev(t), lambda v: X.adaptive_level(v, RING, 8, None)[1]).select("k", "i", r6("y", "level"))


FPS, MINC, BETA = 24.0, 1.0, 0.007
A_D = 1 / (1 + (1 / (2 * math.pi)) * FPS)


def one_euro(df, value="v"):
    """Adaptive causal low-pass: the smoothed speed raises the cutoff."""
    return S.fold_long(df, lambda v: X.one_euro(v, FPS, MINC, BETA), value)


@query("w18_one_euro", f"""
WITH RECURSIVE {EV},
r AS (SELECT k, i, v AS y, 0.0::DOUBLE AS d FROM s WHERE i = 0 UNION ALL SELECT k, i, al * v + (1 - al) * y, sp FROM
  (SELECT *, 1 / (1 + {FPS!r} / ({2 * math.pi!r} * ({MINC!r} + {BETA!r} * abs(sp)))) AS al FROM (SELECT s.k, s.i, s.v, r.y, {A_D!r} * (v - y) *
  {FPS!r} + {1 - A_D!r} * d AS sp FROM r JOIN s ON s.k = r.k AND s.i = r.i + 1)))
SELECT k, i, round(y, 6) AS y
FROM r
""")
def w18(t):
    return one_euro(ev(t)).select("k", "i", r6("y", "y"))


@query("w19_robust_fire", f"""
WITH {EV},
md AS (SELECT k, median(v) AS m FROM s GROUP BY k),
sp AS (SELECT k, m, greatest(median(abs(v - m)) * 1.4826, 0.01) AS d FROM s JOIN md USING (k) GROUP BY k, m)
SELECT k, i, v > m + 1.5 * d AS fires
FROM s
JOIN sp USING (k)
""")
def w19(t):
    d = ev(t)
    med, _ = S.robust_fire("v", 1.5, 0.01)
    d = d.withColumn("_med", med)
    _, spread = S.robust_fire("v", 1.5, 0.01)
    return d.withColumn("_d", spread).select("k", "i", (F.col("v") > F.col("_med") + 1.5 * F.col("_d")).alias("fires"))


_EVID = """
q AS (SELECT k, median(v) AS m, quantile_cont(v, 0.95) AS h FROM s GROUP BY k),
ev AS (SELECT k, i, CASE WHEN h > m THEN greatest(0, (v - m) / (h - m)) ELSE 0 END AS x FROM s JOIN q USING (k))
"""


@query("w20_range_evidence", f"WITH {EV}, {_EVID} SELECT k, i, round(x, 6) AS x FROM ev")
def w20(t):
    return ev(t).select("k", "i", r6(S.range_evidence("v"), "x"))


def evidence(t):
    return ev(t).select("k", "i", S.range_evidence("v").alias("x"))


_RUNS = """
z AS (SELECT k, i, i - row_number() OVER (PARTITION BY k ORDER BY i) AS g FROM {src} WHERE {on}),
rn AS (SELECT k, min(i) AS lo, max(i) + 1 AS hi, count(*) AS len FROM z GROUP BY k, g)
"""


@query("w21_presence_verdict", f"""
WITH {EV},
{_EVID},
{_RUNS.format(src='ev', on='x > 0.5')},
b AS (SELECT k, max(len) AS run FROM rn GROUP BY k),
c AS (SELECT k, max(x) AS peak, avg(CASE WHEN x > 0.5 THEN 1.0 ELSE 0 END) AS cov FROM ev GROUP BY k)
SELECT k, CAST(coalesce(run, 0) AS BIGINT) AS run, round(peak, 6) AS peak, round(cov, 6) AS coverage, coalesce(run, 0) >= 3 AND peak >= 0.8 AND cov >=
  0.04 AS present
FROM c
LEFT JOIN b USING (k)
""")
def w21(t):
    x = evidence(t).withColumn("on_", F.col("x") > 0.5)
    run = S.runs(x, "on_").groupBy("k").agg(F.max("len").alias("run"))
    c = x.groupBy("k").agg(F.max("x").alias("peak"), F.avg(F.col("on_").cast("double")).alias("cov"))
    j = c.join(run.hint("merge"), "k", "left").withColumn("run", F.coalesce("run", F.lit(0)))
    return j.select("k", "run", r6("peak", "peak"), r6("cov", "coverage"), ((F.col("run") >= 3) & (F.col("peak") >= 0.8) & (F.col("cov") >= 0.04)).alias("present"))


@query("w22_magnitude", f"WITH {EV}, {_EVID} SELECT k, round(avg(x), 6) AS mean, round(sum(x) / 24.0, 6) AS total FROM ev GROUP BY k")
def w22(t):
    return evidence(t).groupBy("k").agg(r6(F.avg("x"), "mean"), r6(F.sum("x") / 24.0, "total"))


@query("w23_runs_to_events", f"WITH {EV}, {_RUNS.format(src='s', on='v > 40')} SELECT k, lo, hi, len FROM rn WHERE len >= 2")
def w23(t):
    return S.runs(ev(t).withColumn("on_", F.col("v") > 40), "on_").where("len >= 2")


@query("w23b_pause_statistics", f"""
WITH {EV},
{_RUNS.format(src='s', on='v <= 40')},
pr AS (SELECT k, avg(len) / 24.0 AS mp FROM rn GROUP BY k),
n AS (SELECT k, avg(CASE WHEN v <= 40 THEN 1.0 ELSE 0 END) AS pf FROM s GROUP BY k)
SELECT k, round(pf, 6) AS pause_fraction, round(coalesce(mp, 0), 6) AS pause_mean
FROM n
LEFT JOIN pr USING (k)
""")
def w23b(t):
    d = ev(t).withColumn("off", F.col("v") <= 40)
    p = S.runs(d, "off").groupBy("k").agg((F.avg("len") / 24.0).alias("mp"))
    n = d.groupBy("k").agg(F.avg(F.col("off").cast("double")).alias("pf"))
    return n.join(p.hint("merge"), "k", "left").select("k", r6("pf", "pause_fraction"), r6(F.coalesce("mp", F.lit(0.0)), "pause_mean"))


def windowed(df, size, stride):
    """Rows of a series with the windows of ``size`` that they are in: a row knows its windows from its own place, so
    there is no range join; ``n`` keeps out windows that run over the end."""
    n = F.count(F.lit(1)).over(S.whole())
    last = F.floor(F.least(F.col("i"), F.col("_n") - size) / stride)
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / stride))
    d = df.withColumn("_n", n).where(F.col("_n") >= size).withColumns({"_a": first, "_b": last}).where("_b >= _a")
    return d.withColumn("win", F.explode(F.sequence("_a", "_b"))).drop("_n", "_a", "_b")


_WIN = "n AS (SELECT k, count(*) AS n FROM s GROUP BY k), wd AS (SELECT k, unnest(range(0, n - 15, 8)) AS lo FROM n WHERE n >= 16)"


@query("w24_windowed_firing", f"""
WITH {EV},
{_WIN} SELECT wd.k, CAST(lo // 8 AS BIGINT) AS win, round(avg(CASE WHEN v > 40 THEN 1.0 ELSE 0 END), 6) AS frac, CASE WHEN
  avg(CASE WHEN v > 40 THEN 1.0 ELSE 0 END) >= 0.5 THEN 'bearing' WHEN sum(CASE WHEN v > 40 THEN 1 ELSE 0 END) = 0 THEN 'free' ELSE 'partial' END AS
  state
FROM wd
JOIN s ON s.k = wd.k AND s.i >= lo AND s.i < lo + 16
GROUP BY wd.k, lo
""")
def w24(t):
    f = F.avg((F.col("v") > 40).cast("double"))
    g = windowed(ev(t), 16, 8).groupBy("k", "win").agg(f.alias("f"))
    return g.select("k", F.col("win").cast("long").alias("win"), r6("f", "frac"), F.when(F.col("f") >= 0.5, "bearing").when(F.col("f") == 0, "free").otherwise("partial").alias("state"))


_STEP = """
d AS (SELECT k, i, v, p, coalesce(sqrt(pow(v - lag(v) OVER w, 2) + pow(p - lag(p) OVER w, 2)), 0) * 24 AS sp FROM s WINDOW w AS
  (PARTITION BY k ORDER BY i))
"""


def speeds(df):
    w = S.over()
    return df.withColumn("sp", F.coalesce(F.sqrt(F.pow(F.col("v") - F.lag("v").over(w), F.lit(2)) + F.pow(F.col("p") - F.lag("p").over(w), F.lit(2))), F.lit(0.0)) * 24)


@query("w25_speed_and_extent", f"""
WITH {EV},
{_STEP} SELECT k, round(avg(sp), 6) AS speed, round(max(sp), 6) AS peak, round(sqrt(pow(max(v) - min(v), 2) + pow(max(p) - min(p), 2)), 6) AS extent,
  round((max(v) - min(v)) * (max(p) - min(p)), 6) AS area
FROM d
GROUP BY k
""")
def w25(t):
    dv, dp = F.max("v") - F.min("v"), F.max("p") - F.min("p")
    return speeds(ev(t)).groupBy("k").agg(r6(F.avg("sp"), "speed"), r6(F.max("sp"), "peak"), r6(F.sqrt(dv * dv + dp * dp), "extent"), r6(dv * dp, "area"))


_AC = """
c AS (SELECT k, i, sp - avg(sp) OVER (PARTITION BY k) AS x FROM d),
den AS (SELECT k, sum(x * x) AS q FROM c GROUP BY k HAVING sum(x * x) > 1e-12),
ac AS (SELECT a.k, b.i - a.i AS lag, sum(a.x * b.x) / any_value(q) AS r FROM c a JOIN c b ON a.k = b.k AND b.i >= a.i + 6 AND b.i <= a.i + 40 JOIN den
  ON den.k = a.k GROUP BY 1, 2),
pk AS (SELECT k, lag, r, lag(r) OVER w AS before, lead(r) OVER w AS after FROM ac WINDOW w AS (PARTITION BY k ORDER BY lag))
"""


def repetition(df, least=6, most=40):
    """Peaks of the autocorrelation of the speed above 0.15 between two lags. The products with the rows ``lag`` later
    are ``lead`` columns of one window, summed by series before anything is shuffled again."""
    w = S.over()
    x = speeds(df).select("k", "i", (F.col("sp") - F.avg("sp").over(S.whole())).alias("x"))
    later = x.select("k", "x", *[F.lead("x", n).over(w).alias(f"x{n}") for n in range(least, most + 1)])
    sums = later.groupBy("k").agg(F.sum(F.col("x") * F.col("x")).alias("q"), *[F.sum(F.col("x") * F.col(f"x{n}")).alias(f"s{n}") for n in range(least, most + 1)]).where("q > 1e-12")
    at = lambda n: F.col(f"s{n}") / F.col("q") if least <= n <= most else F.lit(None).cast("double")
    peak = lambda n: F.coalesce(((at(n) > 0.15) & (at(n) >= at(n - 1)) & (at(n) > at(n + 1))).cast("int"), F.lit(0))
    found = sums.where(f"s{least} is not null")
    return found.select("k", sum((peak(n) for n in range(least, most + 1)), F.lit(0)).cast("long").alias("repetition"))


@query("w26_repetition", f"WITH {EV}, {_STEP}, {_AC} SELECT k, count(*) FILTER (WHERE r > 0.15 AND r >= before AND r > after) AS repetition FROM pk GROUP BY k")
def w26(t):
    return repetition(ev(t))


@query("w27_jerk", f"""
WITH {EV},
d3 AS (SELECT k, v - 3 * lag(v, 1) OVER w + 3 * lag(v, 2) OVER w - lag(v, 3) OVER w AS a, p - 3 * lag(p, 1) OVER w + 3 * lag(p, 2) OVER w - lag(p, 3)
  OVER w AS b FROM s WINDOW w AS (PARTITION BY k ORDER BY i))
SELECT k, round(avg(sqrt(a * a + b * b)) * 13824, 4) AS jerk
FROM d3
WHERE a IS NOT NULL
GROUP BY k
""")
def w27(t):
    w = S.over()
    third = lambda c: F.col(c) - 3 * F.lag(c, 1).over(w) + 3 * F.lag(c, 2).over(w) - F.lag(c, 3).over(w)
    d = ev(t).select("k", third("v").alias("a"), third("p").alias("b")).where("a is not null")
    return d.groupBy("k").agg(F.round(F.avg(F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b"))) * 13824, 4).alias("jerk"))


@query("w28_windowed_summary", f"""
WITH {EV},
{_STEP},
{_WIN}
SELECT wd.k, CAST(lo // 8 AS BIGINT) AS win, round(avg(sp), 6) AS speed, round(max(sp), 6) AS peak_speed,
  round(sqrt(pow(max(v) - min(v), 2) + pow(max(p) - min(p), 2)), 6) AS amplitude, round((max(v) - min(v)) * (max(p) - min(p)), 6) AS extent_area,
  round(avg(CASE WHEN sp <= 200 THEN 1.0 ELSE 0 END), 6) AS pause_fraction, round(avg(v), 6) AS mean_value, count(*) AS n_frames,
  round(count(*) / 24.0, 6) AS seconds
FROM wd
JOIN d ON d.k = wd.k AND d.i >= lo AND d.i < lo + 16
GROUP BY wd.k, lo
""")
def w28(t):
    dv, dp = F.max("v") - F.min("v"), F.max("p") - F.min("p")
    g = windowed(speeds(ev(t)), 16, 8).groupBy("k", F.col("win").cast("long").alias("win"))
    return g.agg(r6(F.avg("sp"), "speed"), r6(F.max("sp"), "peak_speed"), r6(F.sqrt(dv * dv + dp * dp), "amplitude"), r6(dv * dp, "extent_area"), r6(F.avg((F.col("sp") <= 200).cast("double")), "pause_fraction"), r6(F.avg("v"), "mean_value"), F.count("*").alias("n_frames"), r6(F.count("*") / 24.0, "seconds"))


@query("w29_length_invariant_summary", f"""
WITH {EM},
d AS (SELECT k, i, j, x[j] AS e, abs(x[j] - lag(x[j]) OVER (PARTITION BY k, j ORDER BY i)) AS dl FROM m, range(1, 65) r(j))
SELECT k, CAST(j - 1 AS INTEGER) AS dim, round(avg(e), 6) AS mean, round(stddev_pop(e), 6) AS sd, round(avg(dl), 6) AS step, count(*) AS n
FROM d
GROUP BY k, j
""")
def w29(t):
    d = em(t).select("k", "i", F.posexplode("x").alias("dim", "e"))
    d = d.withColumn("dl", F.abs(F.col("e") - F.lag("e").over(Window.partitionBy("k", "dim").orderBy("i"))))
    return d.groupBy("k", "dim").agg(r6(F.avg("e"), "mean"), r6(F.stddev_pop("e"), "sd"), r6(F.avg("dl"), "step"), F.count("*").alias("n"))


@query("w30_frame_features", f"""
WITH {EV},
md AS (SELECT k, median(v) AS m FROM s GROUP BY k),
c AS (SELECT k, i, v - m AS x, CASE WHEN abs(p * 0.1 - lag(p * 0.1) OVER w) > pi() THEN -sign(p * 0.1 - lag(p * 0.1) OVER w) ELSE 0 END AS j, p * 0.1
  AS a FROM s JOIN md USING (k) WINDOW w AS (PARTITION BY k ORDER BY i)),
u AS (SELECT k, i, x, a + 2 * pi() * sum(j) OVER (PARTITION BY k ORDER BY i) AS a FROM c)
SELECT k, i, round(x, 6) AS centred, round(coalesce((lead(a) OVER w - lag(a) OVER w) / 2, lead(a) OVER w - a, a - lag(a) OVER w), 6) AS slope,
  round(stddev_pop(x) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING), 6) AS sd
FROM u
WINDOW w AS (PARTITION BY k ORDER BY i)
""")
def w30(t):
    w = S.over()
    d = ev(t).select("k", "i", (F.col("v") - F.median("v").over(S.whole())).alias("x"), (F.col("p") * 0.1).alias("a"))
    d = d.withColumn("da", F.col("a") - F.lag("a").over(w)).withColumn("j", F.when(F.abs("da") > math.pi, -F.signum("da")).otherwise(0.0))
    d = d.withColumn("a", F.col("a") + 2 * math.pi * F.sum("j").over(w))
    nxt, prv = F.lead("a").over(w), F.lag("a").over(w)
    return d.select("k", "i", r6("x", "centred"), r6(F.coalesce((nxt - prv) / 2, nxt - F.col("a"), F.col("a") - prv), "slope"), r6(S.rolling_std("x", 6), "sd"))


def md5_int(*parts):
    """A reproducible integer of 32 bits from a text key."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


@query("w31_circular_shift_placebo", f"""
WITH {EV},
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
o AS (SELECT k, n, n // 4 + CAST(('0x' || substr(md5('placebo:' || k), 1, 8))::BIGINT % (n // 2 + 1) AS BIGINT) AS off FROM n)
SELECT s.k, s.i, q.v AS shifted
FROM s
JOIN o USING (k)
JOIN s q ON q.k = s.k AND q.i = (s.i + off) % n
""")
def w31(t):
    d = ev(t).select("k", "i", "v").withColumn("n", F.count(F.lit(1)).over(S.whole()))
    off = F.floor(F.col("n") / 4) + md5_int(F.lit("placebo"), F.col("k").cast("string")) % (F.floor(F.col("n") / 2) + 1)
    moved = d.select("k", F.pmod(F.col("i") - off, F.col("n")).cast("long").alias("i"), F.col("v").alias("shifted"))
    return moved


@query("w33_outlier_repair", f"""
WITH {EV},
md AS (SELECT k, median(v) AS m FROM s GROUP BY k),
h AS (SELECT s.k, i, CASE WHEN v < 0.3 * m THEN NULL ELSE v END AS v FROM s JOIN md USING (k)),
z AS (SELECT k, i, v, max(CASE WHEN v IS NOT NULL THEN i END) OVER w AS i0, min(CASE WHEN v IS NOT NULL THEN i END) OVER u AS i1 FROM h WINDOW w AS
  (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING), u AS (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT z.k, z.i, round(coalesce(z.v, CASE WHEN i0 IS NULL THEN b.v WHEN i1 IS NULL THEN a.v ELSE a.v + (b.v - a.v) * (z.i - i0) / (i1 - i0) END), 6)
  AS v, z.v IS NULL AS repaired
FROM z
LEFT JOIN h a ON a.k = z.k AND a.i = i0
LEFT JOIN h b ON b.k = z.k AND b.i = i1
""")
def w33(t):
    d = ev(t).select("k", "i", F.when(F.col("v") >= 0.3 * F.median("v").over(S.whole()), F.col("v")).alias("v"))
    w = S.over()
    d = S.interpolate(d, "v", None)
    hold = F.coalesce("filled", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    return d.select("k", "i", r6(hold, "v"), F.col("v").isNull().alias("repaired"))


@query("w34_stabilise_noisy_axis", f"""
WITH {EM},
z AS (SELECT k, i, j, CASE WHEN j = 5 AND i % 2 = 0 THEN 4 * x[j] ELSE x[j] END AS e FROM m, range(1, 65) r(j)),
l AS (SELECT *, e - lag(e) OVER (PARTITION BY k, j ORDER BY i) AS dl FROM z),
n AS (SELECT k, j, stddev_pop(dl) AS sd, median(e) AS md FROM l GROUP BY k, j),
w AS (SELECT k, arg_max(j, sd) AS worst, max(sd) > 3 * median(sd) AS bad FROM n GROUP BY k),
y AS (SELECT l.k, i, l.j, CASE WHEN bad AND worst = l.j THEN md ELSE avg(e) OVER (PARTITION BY l.k, l.j ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1
  FOLLOWING) END AS y FROM l JOIN n ON n.k = l.k AND n.j = l.j JOIN w ON w.k = l.k),
c AS (SELECT k, j, median(y) AS m FROM y GROUP BY k, j)
SELECT y.k, i, CAST(y.j - 1 AS INTEGER) AS dim, round(y - m, 6) AS y
FROM y
JOIN c ON c.k = y.k AND c.j = y.j
""")
def w34(t):
    """Of all dimensions (one of them made noisy) the noisiest is held at its median if its steps spread more than
    three times the median spread; the others are smoothed; all are centred on their medians."""
    w = Window.partitionBy("k", "dim").orderBy("i")
    d = em(t).select("k", "i", F.posexplode("x").alias("dim", "e"))
    d = d.withColumn("e", F.when((F.col("dim") == 4) & (F.col("i") % 2 == 0), 4 * F.col("e")).otherwise(F.col("e"))).withColumn("dl", F.col("e") - F.lag("e").over(w))
    n = d.groupBy("k", "dim").agg(F.stddev_pop("dl").alias("sd"), F.median("e").alias("md"))
    worst = n.groupBy("k").agg(F.max_by("dim", "sd").alias("worst"), (F.max("sd") > 3 * F.median("sd")).alias("bad"))
    j = d.withColumn("s", F.avg("e").over(w.rowsBetween(-1, 1))).join(n.select("k", "dim", "md").hint("merge"), ["k", "dim"]).join(worst.hint("merge"), "k")
    y = j.select("k", "i", "dim", F.when(F.col("bad") & (F.col("worst") == F.col("dim")), F.col("md")).otherwise(F.col("s")).alias("y"))
    centre = y.groupBy("k", "dim").agg(F.median("y").alias("m"))
    return y.join(centre.hint("merge"), ["k", "dim"]).select("k", "i", "dim", r6(F.col("y") - F.col("m"), "y"))


@query("w35_jitter_and_energy", f"""
WITH {EM},
d AS (SELECT k, i, sqrt(list_sum(list_transform(list_zip(x, lag(x) OVER (PARTITION BY k ORDER BY i)), lambda z: pow(z[1] - z[2], 2)))) AS st FROM m)
SELECT k, round(avg(st), 6) AS mean_step, round(max(st), 6) AS max_step
FROM d
WHERE i > 0
GROUP BY k
""")
def w35(t):
    prev = F.lag("x").over(S.over())
    st = F.sqrt(F.aggregate(F.zip_with("x", prev, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    return em(t).select("k", "i", st.alias("st")).where("i > 0").groupBy("k").agg(r6(F.avg("st"), "mean_step"), r6(F.max("st"), "max_step"))


@query("w36_bridge_vector_gaps", f"""
WITH {EM},
h AS (SELECT k, i, CASE WHEN i % 11 IN (3, 4) OR i % 29 BETWEEN 12 AND 20 THEN NULL ELSE x END AS x FROM m),
z AS (SELECT k, i, x, max(CASE WHEN x IS NOT NULL THEN i END) OVER w AS i0, min(CASE WHEN x IS NOT NULL THEN i END) OVER u AS i1 FROM h WINDOW w AS
  (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING), u AS (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT z.k, z.i, CASE WHEN z.x IS NOT NULL THEN list_transform(z.x, lambda e: round(e, 6) + 0.0) WHEN i1 - i0 - 1 <= 4 THEN
  list_transform(list_zip(a.x, b.x), lambda p: round(p[1] + (p[2] - p[1]) * (z.i - i0) / (i1 - i0), 6) + 0.0) END AS x
FROM z
LEFT JOIN h a ON a.k = z.k AND a.i = i0
LEFT JOIN h b ON b.k = z.k AND b.i = i1
""")
def w36(t):
    w = S.over()
    gap = (F.col("i") % 11).isin(3, 4) | (F.col("i") % 29).between(12, 20)
    d = em(t).select("k", "i", F.when(~gap, F.col("x")).alias("x"))
    b, a = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("x").isNotNull(), F.col("i"))
    d = d.withColumns({"i0": F.last(at, True).over(b), "i1": F.first(at, True).over(a), "x0": F.last("x", True).over(b), "x1": F.first("x", True).over(a)})
    line = F.zip_with("x0", "x1", lambda p, q: p + (q - p) * (F.col("i") - F.col("i0")) / (F.col("i1") - F.col("i0")))
    y = F.when(F.col("x").isNotNull(), F.col("x")).when(F.col("i1") - F.col("i0") - 1 <= 4, line)
    return d.select("k", "i", F.transform(y, lambda e: F.round(e, 6)).alias("x"))


@query("w37_peak_row_of_window", f"""
WITH {EV},
{_WIN} SELECT wd.k, CAST(lo // 8 AS BIGINT) AS win, max(v + p) AS score, arg_max(i, (v + p, -i)) AS at, arg_max([v, p, v - p], (v + p, -i)) AS carried
FROM wd
JOIN s ON s.k = wd.k AND s.i >= lo AND s.i < lo + 16
GROUP BY wd.k, lo
""")
def w37(t):
    """The row with the largest summed evidence of each window, the first on ties, with its vector."""
    sc = F.col("v") + F.col("p")
    first = F.struct(sc, -F.col("i"))
    row = F.struct("i", F.array("v", "p", F.col("v") - F.col("p")).alias("x"))
    g = windowed(ev(t), 16, 8).groupBy("k", F.col("win").cast("long").alias("win")).agg(F.max(sc).alias("score"), F.max_by(row, first).alias("r"))
    return g.select("k", "win", "score", F.col("r.i").alias("at"), F.col("r.x").alias("carried"))


@query("w38_strictly_increasing_clock", f"""
WITH {EV},
c AS (SELECT k, i, CAST(floor(v) AS BIGINT) AS c FROM s)
SELECT k, i, max(c - i) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) + i AS clock
FROM c
""")
def w38(t):
    c = F.floor("v").cast("long")
    return ev(t).select("k", "i", (F.max(c - F.col("i")).over(S.over().rowsBetween(Window.unboundedPreceding, 0)) + F.col("i")).alias("clock"))


@query("w39_rank_family", """
SELECT o_orderkey, CAST(rank() OVER w AS INTEGER) AS rk, CAST(dense_rank() OVER w AS INTEGER) AS dr, CAST(row_number() OVER
  (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS INTEGER) AS rn, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY
  o_orderpriority, o_orderkey) AS INTEGER) AS q, rank() OVER w + (count(*) OVER (PARTITION BY o_custkey, o_orderpriority) - 1) / 2.0::DOUBLE AS
  mean_rank, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, first_value(o_totalprice) OVER
  (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS first
FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)
""")
def w39(t):
    p = Window.partitionBy("o_custkey")
    w, o, d = p.orderBy("o_orderpriority"), p.orderBy("o_orderpriority", "o_orderkey"), p.orderBy("o_orderdate", "o_orderkey")
    ties = F.count(F.lit(1)).over(Window.partitionBy("o_custkey", "o_orderpriority"))
    return t("orders").select("o_orderkey", F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr"), F.row_number().over(o).alias("rn"), F.ntile(4).over(o).alias("q"), (F.rank().over(w) + (ties - 1) / 2.0).alias("mean_rank"), F.lag("o_totalprice").over(d).alias("before"), F.first("o_totalprice").over(d).alias("first"))


@query("w40_series_report", f"""
WITH {EV},
{_RUNS.format(src='s', on='v > 40')},
l AS (SELECT k, list([lo, hi] ORDER BY lo) AS spans FROM rn WHERE len >= 2 GROUP BY k)
SELECT s.k, count(*) AS n, round(count(*) / 24.0, 6) AS seconds, round(avg(CASE WHEN v > 40 THEN 1.0 ELSE 0 END), 6) AS active, min(v) AS lo, max(v)
  AS hi, any_value(coalesce(spans, [])) AS spans
FROM s
LEFT JOIN l ON l.k = s.k
GROUP BY s.k
""")
def w40(t):
    d = ev(t).withColumn("on_", F.col("v") > 40)
    spans = S.runs(d, "on_").where("len >= 2").groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("lo", "hi"))), lambda x: F.array(x["lo"], x["hi"])).alias("spans"))
    g = d.groupBy("k").agg(F.count("*").alias("n"), r6(F.count("*") / 24.0, "seconds"), r6(F.avg(F.col("on_").cast("double")), "active"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return g.join(spans.hint("merge"), "k", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<array<bigint>>")))

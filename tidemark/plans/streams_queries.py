"""Streaming queries: each runs a file stream to completion and returns what it wrote."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import filters as X
from tidemark.plans.registry import query
from tidemark.plans.windows_queries import A_FAST, A_HOLD, A_SLOW, LEAST, RING, SHARES, r6, turns_sql
from tidemark.streaming import run as R
from tidemark.streaming import state as T

HOUR, DAY = 3_600_000_000, 86_400_000_000  # microseconds
#: Series of a user with the row's place, for SQL
_S = "s AS (SELECT user_id, event_id, ts, value AS v, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS i FROM events)"


@query("r01_validate_and_reject", """
SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view', 'error', 'purchase') THEN 'unknown_type' WHEN value > 240 THEN 'rate' WHEN
  CAST(props->>'$.k' AS INTEGER) < 8 THEN 'short' ELSE 'ok' END AS reason
FROM events
""")
def r01(t):
    s = R.read_stream(t.spark, t.sf_dir, "events")
    k = F.from_json("props", "k int")["k"]
    reason = F.when(~F.col("event_type").isin("click", "view", "error", "purchase"), "unknown_type").when(F.col("value") > 240, "rate").when(k < 8, "short").otherwise("ok")
    return R.drain(s.select("event_id", reason.alias("reason")))


@query("r02_window_measure", """
WITH d AS (SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS w, value FROM events)
SELECT user_id, CAST(epoch(w) AS BIGINT) AS day, count(*) AS n, round(avg(value), 6) AS magnitude, max(value) AS peak,
  round(avg((value < 10)::INT), 6) AS zero_fraction, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, max(value) >= 40 AND
  avg((value >= 10)::INT) >= 0.5 AS present
FROM d
WHERE w + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
GROUP BY 1, 2, w
""")
def r02(t):
    """Windows that the watermark has passed, each written once and then forgotten."""
    s = R.read_stream(t.spark, t.sf_dir, "events").withWatermark("ts", "1 hour")
    share = lambda c: F.avg(c.cast("double"))
    g = s.groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(
        F.count("*").alias("n"), r6(F.avg("value"), "magnitude"), F.max("value").alias("peak"), r6(share(F.col("value") < 10), "zero_fraction"),
        F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), share(F.col("value") >= 10).alias("active"),
    )
    return R.drain(g).select("user_id", F.unix_timestamp("w.start").alias("day"), "n", "magnitude", "peak", "zero_fraction", r6(F.col("q")[1] - F.col("q")[0], "iqr"), ((F.col("peak") >= 40) & (F.col("active") >= 0.5)).alias("present"))


@query("r03_stream_static_enrich", "SELECT event_id, c_mktsegment AS segment FROM events LEFT JOIN customer ON c_custkey = user_id")
def r03(t):
    s = R.read_stream(t.spark, t.sf_dir, "events").select("event_id", "user_id")
    c = t("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    return R.drain(s.join(c.hint("shuffle_hash"), "user_id", "left").select("event_id", "segment"))


@query("r04_stateful_band_rms", f"""
WITH RECURSIVE s AS (SELECT user_id, event_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT user_id, event_id, i, v AS f, v AS g, 0.0::DOUBLE AS en FROM s WHERE i = 1 UNION ALL SELECT s.user_id, s.event_id, s.i, f + {A_FAST!r} *
  (v - f), g + {A_SLOW!r} * (v - g), en + {A_HOLD!r} * (pow(f + {A_FAST!r} * (v - f) - g - {A_SLOW!r} * (v - g), 2) - en) FROM r JOIN s ON s.user_id =
  r.user_id AND s.i = r.i + 1)
SELECT user_id, event_id, round(sqrt(en), 6) AS energy
FROM r
""")
def r04(t):
    def step(state, pdf):
        state, energy = X.band_energy(pdf["value"].to_numpy(), SHARES, state)
        return tuple(float(x) for x in state), pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "energy": energy}), None

    s = R.read_stream(t.spark, t.sf_dir, "events")
    out = R.per_key(s, "user_id", ["event_id"], ["value"], "event_id long, energy double", "fast double, slow double, energy double", step)
    return R.drain(out).withColumn("energy", F.round("energy", 6))


@query("r08_monotonic_clock", """
WITH s AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
SELECT user_id, event_id, max(c - i) OVER (PARTITION BY user_id ORDER BY i) + i AS clock
FROM s
""")
def r08(t):
    def step(state, pdf):
        c, n = pdf["c"].to_numpy(), np.arange(1, len(pdf) + 1)
        clock = np.maximum.accumulate(c - n) + n
        if state is not None:
            clock = np.maximum(clock, state[0] + n)
        return (int(clock[-1]),), pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "clock": clock}), None

    s = R.read_stream(t.spark, t.sf_dir, "events").withColumn("c", F.floor("value").cast("long"))
    return R.drain(R.per_key(s, "user_id", ["event_id"], ["c"], "event_id long, clock long", "last long", step))


_PASSED = "(SELECT max(ts) - INTERVAL 2 HOUR FROM events)"


@query("r09_tumbling_windows_with_watermark", f"""
WITH d AS (SELECT event_type, value, time_bucket(INTERVAL 6 HOUR, ts) AS w FROM events)
SELECT event_type, CAST(epoch(w) AS BIGINT) AS start, count(*) AS n, round(sum(value), 4) AS total
FROM d
WHERE w + INTERVAL 6 HOUR <= {_PASSED}
GROUP BY 1, 2
""")
def r09(t):
    s = R.read_stream(t.spark, t.sf_dir, "events").withWatermark("ts", "2 hours")
    g = s.groupBy("event_type", F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return R.drain(g).select("event_type", F.unix_timestamp("w.start").alias("start"), "n", "total")


@query("r09_sliding_windows", f"""
WITH d AS (SELECT event_type, value, time_bucket(INTERVAL 2 HOUR, ts) - j * INTERVAL 2 HOUR AS w FROM events, range(0, 3) q(j))
SELECT event_type, CAST(epoch(w) AS BIGINT) AS start, count(*) AS n, round(sum(value), 4) AS total
FROM d
WHERE w + INTERVAL 6 HOUR <= {_PASSED}
GROUP BY 1, 2
""")
def r09_sliding(t):
    s = R.read_stream(t.spark, t.sf_dir, "events").withWatermark("ts", "2 hours")
    g = s.groupBy("event_type", F.window("ts", "6 hours", "2 hours").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return R.drain(g).select("event_type", F.unix_timestamp("w.start").alias("start"), "n", "total")


@query("r09_session_windows", f"""
WITH d AS (SELECT user_id, ts, value, sum((ts - before >= INTERVAL 8 HOUR)::INT) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM
  (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)),
z AS (SELECT user_id, coalesce(g, 0) AS g, min(ts) AS lo, max(ts) + INTERVAL 8 HOUR AS hi, count(*) AS n, sum(value) AS total FROM d GROUP BY 1, 2)
SELECT user_id, epoch_us(lo) AS lo, epoch_us(hi) AS hi, n, round(total, 4) AS total
FROM z
WHERE hi <= {_PASSED}
""")
def r09_session(t):
    s = R.read_stream(t.spark, t.sf_dir, "events").withWatermark("ts", "2 hours")
    g = s.groupBy("user_id", F.session_window("ts", "8 hours").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return R.drain(g).select("user_id", F.unix_micros("w.start").alias("lo"), F.unix_micros("w.end").alias("hi"), "n", "total")


#: Three parts by id, of which every 40th row arrives with the next but one
_PART = "least(3, CAST(floor(3.0 * event_id / (SELECT max(event_id) + 1 FROM events)) AS INTEGER) + CASE WHEN event_id % 40 = 0 THEN 2 ELSE 0 END)"


@query("r09_late_rows_dropped", f"""
WITH p AS (SELECT *, {_PART} AS part, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS hi FROM events),
m AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS UNBOUNDED PRECEDING) - INTERVAL 2 HOUR AS mark FROM p GROUP BY 1),
w AS (SELECT p.*, q.mark IS NOT NULL AND hi <= q.mark AS late FROM p LEFT JOIN m q ON q.part = p.part - 1)
SELECT event_type, CAST(epoch(hi) AS BIGINT) - 21600 AS start, count(*) FILTER (WHERE NOT late) AS n, count(*) FILTER (WHERE late) AS late
FROM w
WHERE hi <= {_PASSED}
GROUP BY 1, 2
HAVING count(*) FILTER (WHERE NOT late) > 0
""")
def r09_late(t):
    """Rows that arrive in four parts, some behind the watermark: those are dropped, and counted against all rows."""
    e = t("events").select("event_id", "event_type", "ts")
    last = e.agg((F.max("event_id") + 1).alias("n")).first()["n"] or 1
    part = F.least(F.lit(3), F.floor(3.0 * F.col("event_id") / last).cast("int") + F.when(F.col("event_id") % 40 == 0, 2).otherwise(0))
    count = lambda d: d.groupBy("event_type", F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    seen = R.arrivals(e, part, 4, lambda s: count(s.withWatermark("ts", "2 hours"))).select("event_type", F.unix_timestamp("w.start").alias("start"), "n")
    all_rows = count(e.withColumn("ts", F.col("ts").cast("timestamp"))).select("event_type", F.unix_timestamp("w.start").alias("start"), F.col("n").alias("m"))
    return seen.join(all_rows.hint("merge"), ["event_type", "start"]).select("event_type", "start", "n", (F.col("m") - F.col("n")).alias("late"))


@query("r10_stream_interval_join", """
SELECT p.event_id AS purchase, e.event_id AS error
FROM events p
JOIN events e ON p.user_id = e.user_id AND e.event_type = 'error' AND p.event_type = 'purchase' AND e.ts BETWEEN p.ts - INTERVAL 3 HOUR AND p.ts +
  INTERVAL 3 HOUR
""")
def r10(t):
    s = R.read_stream(t.spark, t.sf_dir, "events")
    p = s.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), F.col("ts").alias("pt")).withWatermark("pt", "1 hour")
    e = s.where("event_type = 'error'").select(F.col("user_id").alias("u"), F.col("event_id").alias("error"), F.col("ts").alias("et")).withWatermark("et", "1 hour")
    j = p.join(e, F.expr("user_id = u and et between pt - interval 3 hours and pt + interval 3 hours"))
    return R.drain(j.select("purchase", "error"))


SPAN = 36 * HOUR


def turn_levels(stream):
    """The turns of each user's values and their level, with turns as a list that a timer shortens."""

    def step(now, recent, pdf):
        v, at = pdf["value"].to_numpy(), pdf["at"].to_numpy()
        way, reach = now or (0.0, float(v[0]))
        flags, way, reach = X.turns(v, LEAST, way, reach)
        n, _ = X.recent(flags, at, SPAN, recent.astype(np.int64))
        frame = pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "rev": flags.astype("int32"), "level": np.minimum(n / 3.0, 1.2)})
        return (float(way), float(reach)), at[flags], frame

    return T.series(stream, "user_id", ["event_id"], ["value", "at", "ts"], "event_id long, rev int, level double", "way double, reach double", "long", step, span=SPAN)


@query("r05_stateful_reversal_counter", f"""
WITH RECURSIVE {_S},
{turns_sql('user_id', ['event_id', 'ts'], 's')}
SELECT user_id, event_id, rev, round(least(sum(rev) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 36 HOUR PRECEDING AND CURRENT ROW) /
  3.0::DOUBLE, 1.2), 6) AS level
FROM tn
""")
def r05(t):
    """Turns of a user's values by at least ``LEAST``, and their level over the last 36 hours; older turns are forgotten."""

    s = R.read_stream(t.spark, t.sf_dir, "events").withColumn("at", F.unix_micros("ts")).withWatermark("ts", "1 hour")
    with T.typed_state(t.spark):
        out = R.drain(turn_levels(s))
    return out.select("user_id", "event_id", "rev", F.round("level", 6).alias("level"))


@query("r06_stateful_adaptive_baseline", """
WITH s AS (SELECT user_id AS k, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS i, value AS v FROM
  events),
q AS (SELECT k, event_id, i, CASE WHEN i % 8 = 0 THEN quantile_cont(v, 0.2) OVER w END AS lo, CASE WHEN i % 8 = 0 THEN quantile_cont(v, 0.95) OVER w
  END AS hi, v FROM s WINDOW w AS (PARTITION BY k ORDER BY i ROWS BETWEEN 599 PRECEDING AND CURRENT ROW)),
f AS (SELECT k, event_id, v, last_value(lo IGNORE NULLS) OVER z AS lo, last_value(hi IGNORE NULLS) OVER z AS hi FROM q WINDOW z AS
  (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING))
SELECT k AS user_id, event_id, round(CASE WHEN hi > lo THEN greatest(0, (v - lo) / (hi - lo)) ELSE 0 END, 6) AS level
FROM f
""")
def r06(t):
    """The last values are a list that a batch only appends to; it is cut back when it is twice as long as needed."""

    def step(now, recent, pdf):
        v = pdf["value"].to_numpy()
        (_, n, lo, hi), level = X.adaptive_level(v, RING, 8, (recent, *now) if now else None)
        return (n, lo, hi), v, pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "level": level})

    s = R.read_stream(t.spark, t.sf_dir, "events")
    with T.typed_state(t.spark):
        out = R.drain(T.series(s, "user_id", ["event_id"], ["value"], "event_id long, level double", "n long, lo double, hi double", "double", step, keep=RING - 1))
    return out.select("user_id", "event_id", F.round("level", 6).alias("level"))


ON, SHORTEST, QUIET = 40.0, 2, 2 * DAY


def runs_of_batch(state, pdf):
    """Closed runs of a key's rows above ``ON``. A run ends before a row that is not, and where the next row comes more
    than ``QUIET`` after; the run that may go on is kept: its first row, its rows, its last time, and all rows so far."""
    begin, length, last, n = state or (-1, 0, 0, 0)
    on = pdf["value"].to_numpy() > ON
    rows, times = n + np.flatnonzero(on), pdf["at"].to_numpy()[on]
    n += len(pdf)
    if begin >= 0:  # the run so far, as its last row
        rows, times = np.append(begin + length - 1, rows), np.append(last, times)
    if not len(rows):
        return (-1, 0, 0, n), pd.DataFrame({"lo": [], "hi": []}, dtype="int64"), None
    cut = np.append(0, 1 + np.flatnonzero((np.diff(rows) > 1) | (np.diff(times) > QUIET)))
    spans = pd.DataFrame({"lo": rows[cut], "hi": np.append(rows[cut[1:] - 1], rows[-1]) + 1})
    if begin >= 0:
        spans.loc[0, "lo"] = begin
    lo, hi = (int(x) for x in spans.iloc[-1])
    going = hi == n
    closed = spans.iloc[: len(spans) - going]
    state = (lo, hi - lo, int(times[-1]), n) if going else (-1, 0, 0, n)
    return state, closed[closed["hi"] - closed["lo"] >= SHORTEST], int(times[-1] + QUIET) // 1000 + 1 if going else None


def close_run(state):
    """What a timer does: the open run ends, as no row came for long."""
    begin, length, _, n = state
    return (-1, 0, 0, n), pd.DataFrame({"lo": [begin], "hi": [begin + length]} if begin >= 0 and length >= SHORTEST else {"lo": [], "hi": []}, dtype="int64")


@query("r07_stateful_event_emission", f"""
WITH {_S},
h AS (SELECT user_id, i, CASE WHEN i - lag(i) OVER w > 1 OR ts - lag(ts) OVER w > INTERVAL 2 DAY THEN 1 ELSE 0 END AS cut FROM s WHERE v > 40 WINDOW w
  AS (PARTITION BY user_id ORDER BY i)),
z AS (SELECT user_id, i, sum(cut) OVER (PARTITION BY user_id ORDER BY i) AS g FROM h)
SELECT user_id, min(i) AS lo, max(i) + 1 AS hi
FROM z
GROUP BY user_id, g
HAVING count(*) >= 2
""")
def r07(t):
    """Runs as they close, by a quiet row, a later row or a timer; those open at the end are read from the state."""
    s = R.read_stream(t.spark, t.sf_dir, "events").withColumn("at", F.unix_micros("ts")).withWatermark("ts", "1 hour")
    out = R.per_key(s, "user_id", ["event_id"], ["value", "at", "ts"], "lo long, hi long", "begin long, length long, last long, n long", runs_of_batch, close_run)
    sink = R.Sink(t.spark)
    sink.run(out)
    left = sink.open_state().where(f"begin >= 0 and length >= {SHORTEST}").select("user_id", F.col("begin").alias("lo"), (F.col("begin") + F.col("length")).alias("hi"))
    return sink.results(out).select("user_id", "lo", "hi").union(left)

"""Queries on live windows and deliveries: several sinks, and repeats within the watermark."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.plans.registry import query
from tidemark.streaming import run as R
from tidemark.streaming import windows as L

WIDE = 3

R01_SQL = """
WITH e AS (
  SELECT user_id, event_id, value, CAST(props->>'$.k' AS INTEGER) AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i
  FROM events),
w AS (
  SELECT user_id, i // 10 AS w, count(*) AS frames, bool_or(k = 13) AS narrow, bool_or(event_id % 97 = 0) AS odd, max(value) AS peak,
    count(*) FILTER (WHERE NOT ((i // 10) % 5 = 4 AND i % 10 = 9)) AS poses,
    CASE WHEN (i // 10) % 11 = 3 THEN 0 ELSE max(value) END AS fps
  FROM e GROUP BY user_id, i // 10),
j AS (
  SELECT *, CASE WHEN narrow THEN 'width' WHEN frames < 8 THEN 'short' WHEN odd THEN 'not_finite'
    WHEN user_id % 3 <> 0 AND poses <> frames THEN 'pose_length' WHEN fps <= 0 OR fps > 240 THEN 'rate' END AS fault
  FROM w)
SELECT 'accepted' AS sink, user_id || '-' || w AS utterance_id, NULL AS fault, frames, round(peak, 6) AS peak FROM j WHERE fault IS NULL
UNION ALL
SELECT 'rejected', user_id || '-' || w, fault, NULL, NULL FROM j WHERE fault IS NOT NULL
"""


def live_windows(events):
    """Windows of ten events of a user as clients would send them, some with faults."""
    e = events.select("user_id", "event_id", "value", F.from_json("props", "k int")["k"].alias("k"))
    e = e.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    number = F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    frame = F.when(F.col("k") == 13, F.array(number, F.lit(1.0))).otherwise(F.array(number, F.lit(1.0), F.col("k").cast("double")))
    block = F.floor(F.col("i") / 10).alias("w")
    rows = F.array_sort(F.collect_list(F.struct("i", frame.alias("frame"), "value")))
    g = e.groupBy("user_id", block).agg(rows.alias("rows"), F.max("value").alias("peak"))
    turned = F.filter("rows", lambda r: ~((F.col("w") % 5 == 4) & (r["i"] % 10 == 9)))
    pose = F.when(F.col("user_id") % 3 != 0, F.transform(turned, lambda r: F.array(F.array(F.lit(1.0), r["value"]))))
    fps = F.when(F.col("w") % 11 == 3, F.lit(0.0)).otherwise(F.col("peak"))
    name = F.concat_ws("-", "user_id", "w")
    payload = F.struct(F.col("rows.frame").alias("blendshapes"), pose.alias("head_pose"), fps.alias("fps"), name.alias("utterance_id"))
    return g.select("user_id", name.alias("utterance_id"), F.to_json(payload).alias("payload"))


ROUTES = {
    "accepted": lambda d: d.where("fault is null").select("utterance_id", F.size("window.blendshapes").cast("long").alias("frames"), F.array_max(F.transform("window.blendshapes", lambda f: f[0])).alias("peak")),
    "rejected": lambda d: d.where("fault is not null").select("utterance_id", "fault"),
}


@query("r01_two_sinks", R01_SQL)
def r01_sinks(t):
    """Windows that arrive in three parts; those that can be measured go to one table, the others with their fault to
    another, in one pass over each batch."""
    rows = live_windows(t("events"))
    sink, stream = R.arrive(rows, F.col("user_id") % 3, 3, lambda s: L.judged(s, width=WIDE), ROUTES)
    good, bad = (sink.table(name, stream, ROUTES) for name in ("accepted", "rejected"))
    none = lambda kind: F.lit(None).cast(kind)
    good = good.select(F.lit("accepted").alias("sink"), "utterance_id", none("string").alias("fault"), "frames", F.round("peak", 6).alias("peak"))
    return good.union(bad.select(F.lit("rejected"), "utterance_id", "fault", none("long"), none("double")))


#: Originals arrive in three parts by id; of every third event a second delivery comes a part later, with a time half a day
#: (even ids) or five minutes after the first.
R09_SQL = """
WITH n AS (SELECT max(event_id) + 1 AS n FROM events),
a AS (
  SELECT event_id, 0 AS nth, CAST(floor(3e0 * event_id / n.n) AS INTEGER) AS part, ts FROM events, n
  UNION ALL
  SELECT event_id, 1, CAST(floor(3e0 * event_id / n.n) AS INTEGER) + 1, ts + CASE WHEN event_id % 2 = 0 THEN INTERVAL 12 HOUR ELSE INTERVAL 5 MINUTE END
  FROM events, n WHERE event_id % 3 = 0),
m AS (SELECT part, max(date_trunc('milliseconds', max(ts))) OVER (ORDER BY part) - INTERVAL 6 HOUR AS mark FROM a GROUP BY part),
s AS (
  SELECT a.*, q.mark, coalesce(a.ts <= q.mark, false) AS late, lag(a.ts) OVER e AS first_ts, lag(coalesce(a.ts <= q.mark, false)) OVER e AS first_late
  FROM a LEFT JOIN m q ON q.part = a.part - 1 WINDOW e AS (PARTITION BY event_id ORDER BY nth))
SELECT event_id, epoch_us(ts) AS at, nth FROM s
WHERE NOT late AND (nth = 0 OR first_late OR mark >= first_ts + INTERVAL 6 HOUR)
"""


@query("r09_repeats_within_watermark", R09_SQL)
def r09_repeats(t):
    """Deliveries without those that repeat an event while it is remembered; what comes back later counts anew."""
    e = t("events").select("event_id", "ts")
    n = e.agg((F.max("event_id") + 1).alias("n")).first()["n"] or 1
    part = F.floor(3.0 * F.col("event_id") / n).cast("int")
    later = F.when(F.col("event_id") % 2 == 0, F.expr("ts + interval 12 hours")).otherwise(F.expr("ts + interval 5 minutes"))
    again = e.where("event_id % 3 = 0").select("event_id", later.alias("ts"), F.lit(1).alias("nth"), (part + 1).alias("part"))
    rows = e.select("event_id", "ts", F.lit(0).alias("nth"), part.alias("part")).union(again)
    kept = R.arrivals(rows, F.col("part"), 4, lambda s: L.first_deliveries(s, ["event_id"], "ts", "6 hours"))
    return kept.select("event_id", F.unix_micros("ts").alias("at"), "nth")

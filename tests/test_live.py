"""Live windows and deliveries: every rule, batches that are run again, and state that is forgotten."""

import json
import os
import shutil

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.plans import live_queries as V
from tidemark.plans import streams_queries as Q
from tidemark.streaming import run as R
from tidemark.streaming import state as T
from tidemark.streaming import windows as L


def payload(frames=8, width=52, pose=None, fps=24.0, **other):
    return {"blendshapes": [[0.1] * width for _ in range(frames)], "head_pose": pose, "fps": fps, **other}


def test_every_rule_of_a_window(spark):
    turned = [[[1.0, 0.0]] * 3 for _ in range(8)]
    ragged = payload()
    ragged["blendshapes"][3] = [0.1] * 51
    odd = payload()
    odd["blendshapes"][2][5] = "NaN"
    cases = [
        (payload(), None), (payload(pose=turned), None), (payload(fps=240.0), None),
        ({"fps": 24.0}, "missing"), (payload(width=51), "width"), (ragged, "width"), (payload(frames=7), "short"), (payload(frames=0), "short"),
        (odd, "not_finite"), (payload(pose=turned[:7]), "pose_length"), (payload(pose=[*turned[:7], [["Infinity", 0.0]]]), "pose_not_finite"),
        (payload(fps=0.0), "rate"), (payload(fps=None), "rate"), (payload(fps=-1.0), "rate"), (payload(fps=240.5), "rate"), (payload(fps="NaN"), "rate"),
    ]
    rows = [(i, json.dumps(p)) for i, (p, _) in enumerate(cases)] + [(100, "no json"), (101, None), (102, "[]")]
    got = {r["id"]: r["fault"] for r in L.judged(spark.createDataFrame(rows, "id long, payload string")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]
    assert {got[i] for i in (100, 101, 102)} == {"missing"}


def test_a_batch_run_again_leaves_no_row_twice(spark):
    rows = spark.createDataFrame([(i, json.dumps(payload(frames=8 if i % 3 else 5, width=3, utterance_id=str(i)))) for i in range(30)], "utterance_id long, payload string")
    routes = {"accepted": lambda d: d.where("fault is null").select("utterance_id"), "rejected": lambda d: d.where("fault is not null").select("utterance_id", "fault")}
    build = lambda s: L.judged(s, width=3)
    sink, stream = R.arrive(rows, F.col("utterance_id") % 2, 2, build, routes)
    count = lambda: [sink.table(n, stream, routes).count() for n in routes]
    assert count() == [20, 10]
    local = sink.folder.removeprefix("file://")
    last = sorted((f for f in os.listdir(f"{local}/state/commits") if f.isdigit()), key=int)[-1]
    for name in (last, f".{last}.crc"):
        os.remove(f"{local}/state/commits/{name}")  # as if the driver had been lost between the tables and the commit
    shutil.rmtree(f"{local}/rejected/batch={last}")
    sink.run(stream, routes=routes)
    assert count() == [20, 10]


def test_repeats_in_time_and_after(spark):
    at = lambda h: f"2024-01-01 {h:02d}:00:00"
    rows = [(1, at(0), 0), (2, at(1), 0), (9, at(2), 0), (1, at(2), 1), (3, at(12), 1), (1, at(13), 2), (2, at(1), 2), (3, at(14), 3), (1, at(20), 3)]
    df = spark.createDataFrame(rows, "k long, ts string, part int").withColumn("ts", F.col("ts").cast("timestamp"))
    kept = R.arrivals(df, F.col("part"), 4, lambda s: L.first_deliveries(s, ["k"], "ts", "6 hours"))
    # 1 comes back at 2 while it is remembered; at 13 it is forgotten (12 - 6 >= 0 + 6), 2 at 1 is too late, and at 20 1 is remembered again
    assert sorted((r["k"], r["ts"].hour) for r in kept.collect()) == [(1, 0), (1, 13), (2, 1), (3, 12), (9, 2)]


def test_timers_shorten_the_list_of_turns(spark):
    hour = 3600
    rows = [(1, i, 100.0 * (i % 2), i * hour) for i in range(60)] + [(2, 1000 + i, 100.0 * (i % 2), i * hour) for i in range(10)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, value double, s long").select("*", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))
    build = lambda s: Q.turn_levels(s.withColumn("at", F.unix_micros("ts")).withWatermark("ts", "1 hour"))
    with T.typed_state(spark):
        sink, stream = R.arrive(df, F.floor(F.col("s") / (20 * hour)).cast("int"), 3, build)
    out = sink.results(stream)
    assert out.count() == 70 and out.agg(F.max("level")).first()[0] == 1.2
    # turns of rows 22 to 59 are within 36 hours of the watermark (58 - 36), user 2's are all forgotten without a new row
    left = {r["u"]: r["n"] for r in T.remembered(sink, "recent").groupBy(F.col("key.user_id").alias("u")).agg(F.count("*").alias("n")).collect()}
    assert left == {1: 38}
    assert T.remembered(sink, "now").count() == 2


def test_windows_of_events_have_every_fault(spark):
    events = spark.createDataFrame([(i % 3, i, float(i % 60), '{"k": %d}' % (i % 100)) for i in range(2000)], "user_id long, event_id long, value double, props string")
    found = {r["fault"] for r in L.judged(V.live_windows(events), width=V.WIDE).select("fault").distinct().collect()}
    assert {None, "width", "short", "not_finite", "pose_length", "rate"} <= found


class _Held:
    """A state variable and the timers of one key, without a store."""

    def __init__(self):
        self.value, self.rows, self.timers = None, [], []

    def getValueState(self, name, schema):
        return self

    getListState = getValueState

    def get(self):
        return self.value

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value = value

    def registerTimer(self, at):
        self.timers.append(at)


class _List(_Held):
    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def appendList(self, rows):
        self.rows += rows

    def clear(self):
        self.rows = []


class _Clock:
    def __init__(self, ms):
        self.ms = ms

    def getExpiryTimeInMs(self):
        return self.ms

    getCurrentWatermarkInMs = getExpiryTimeInMs


def test_a_key_has_one_timer_however_many_numbers_it_remembers():
    step = lambda now, recent, pdf: ((1,), pdf["x"].to_numpy(), pdf)
    s = T.Series("k", ["x"], "n int", "long", step, span=10_000)
    handle = _Held()
    s.init(handle)
    s.recent = recent = _List()
    for begin in (0, 500):
        list(s.handleInputRows((1,), iter([pd.DataFrame({"x": np.arange(begin, begin + 300) * 1000})]), None))
    assert handle.timers == [11] and len(recent.rows) == 600
    list(s.handleExpiredTimer((1,), _Clock(260), _Clock(11)))  # the watermark has passed 250 numbers and more
    assert recent.rows[0] == (250_000,) and handle.timers == [11, 261]
    list(s.handleExpiredTimer((1,), _Clock(900), _Clock(261)))
    assert recent.rows == [] and len(handle.timers) == 2
    list(s.handleInputRows((1,), iter([pd.DataFrame({"x": [2_000_000]})]), None))
    assert handle.timers == [11, 261, 2011] and recent.rows == [(2_000_000,)]

"""Causal filters cut into batches, and streams whose parts arrive one after the other."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import filters as X
from tidemark.plans import streams_queries as Q
from tidemark.streaming import run as R


def swings(v, least):
    """Turns by their meaning: all rows after the last turn are looked at again for each row."""
    out, begin, way = [], 0, 0
    for i in range(len(v)):
        if not way:
            out.append(False)
            if abs(v[i] - v[0]) >= least:
                way, begin = (1 if v[i] > v[0] else -1), i
            continue
        furthest = max(way * x for x in v[begin:i]) if i > begin else way * v[i]
        out.append(furthest - way * v[i] >= least)
        if out[-1]:
            way, begin = -way, i
    return out


@pytest.mark.parametrize("block", [3, 256])
def test_turns_by_their_meaning_and_in_batches(monkeypatch, block):
    monkeypatch.setattr(X, "BLOCK", block)
    r = random.Random(1)
    for _ in range(60):
        v = np.array([r.choice([0, 5, 10, 30, 55, 80, -20]) + r.random() * 3 for _ in range(r.randrange(1, 90))])
        want = swings(v.tolist(), 25)
        assert X.turns(v, 25, 0.0, float(v[0]))[0].tolist() == want
        cut = r.randrange(1, len(v) + 1)
        a, way, reach = X.turns(v[:cut], 25, 0.0, float(v[0]))
        assert np.append(a, X.turns(v[cut:], 25, way, reach)[0]).tolist() == want


def test_one_swing_is_no_turn_and_turns_are_forgotten():
    single = np.concatenate([np.zeros(12), np.linspace(0, 30, 12), np.full(48, 30.0)])
    assert not X.turns(single, 5, 0.0, 0.0)[0].any()
    wave = np.concatenate([12 * np.sin(2 * np.pi * 2.5 * np.arange(36) / 24), np.zeros(72)])
    flags, _, _ = X.turns(wave, 5, 0.0, 0.0)
    n, kept = X.recent(flags, np.arange(len(wave)), 31, np.zeros(0))
    assert n[:36].max() >= 2 and n[-1] == 0 and not len(kept)


def test_filters_in_batches_equal_one_pass():
    r = np.random.default_rng(2)
    v = r.random(900) * 100
    for f in (lambda x, s: X.band_energy(x, (0.4, 0.1, 0.2), s), lambda x, s: X.adaptive_level(x, 60, 8, s)):
        _, whole = f(v, None)
        state, parts = None, []
        for a, b in ((0, 1), (1, 7), (7, 400), (400, 401), (401, 900)):
            state, y = f(v[a:b], state)
            parts.append(y)
        assert np.allclose(np.concatenate(parts), whole, atol=1e-12)
    levels = X.adaptive_level(v, 60, 8, None)[1]
    for i in (0, 8, 100, 640, 899):
        at = i - i % 8
        lo, hi = np.percentile(v[max(0, at - 59) : at + 1], [20, 95])
        assert levels[i] == pytest.approx(max(0.0, (v[i] - lo) / (hi - lo)) if hi > lo else 0.0)


def test_one_euro_by_its_formula():
    v = [float(i % 7) for i in range(50)]
    share, out, y, d = (lambda c: 1 / (1 + 24 / (2 * math.pi * c))), [v[0]], v[0], 0.0
    for z in v[1:]:
        d = share(1.0) * (z - y) * 24 + (1 - share(1.0)) * d
        a = share(1.0 + 0.007 * abs(d))
        y = a * z + (1 - a) * y
        out.append(y)
    assert np.allclose(X.one_euro(np.array(v), 24.0, 1.0, 0.007), out)


def runs_of(rows, quiet):
    """Runs of one key's rows ``(micros, value)``."""
    out, begin, last = [], None, None
    for i, (at, v) in enumerate(rows):
        if begin is not None and (v <= Q.ON or at - last > quiet):
            out.append((begin, prev + 1))
            begin = None
        if v > Q.ON:
            begin, last, prev = (i if begin is None else begin), at, i
    return [*out, (begin, prev + 1)] if begin is not None else out


def test_runs_close_by_row_gap_timer_and_at_the_end(spark):
    r = random.Random(4)
    rows = []
    for u in range(6):
        at = 0
        for i in range(80):
            at += r.choice([1, 2, 3, 60]) * Q.HOUR
            rows.append((u, u * 1000 + i, at, r.choice([10.0, 50.0, 60.0])))
    rows.append((9, 9000, 5 * Q.HOUR, 50.0))
    rows.append((9, 9001, 6 * Q.HOUR, 50.0))  # a key that never comes again: only the timer closes its run
    df = spark.createDataFrame(rows, "user_id long, event_id long, at long, value double").withColumn("ts", F.timestamp_micros("at"))
    sink = R.Sink(spark)
    cut = sorted(x[2] for x in rows)[len(rows) // 2]
    stream = None
    for b, part in enumerate((df.where(F.col("at") <= cut), df.where(F.col("at") > cut))):
        part.write.parquet(f"{sink.folder}/in/part={b}")
        s = spark.readStream.schema(df.schema).parquet(f"{sink.folder}/in/part=*").withWatermark("ts", "1 second")
        stream = R.per_key(s, "user_id", ["event_id"], ["value", "at", "ts"], "lo long, hi long", "begin long, length long, last long, n long", Q.runs_of_batch, Q.close_run)
        sink.run(stream)
    emitted = {tuple(x) for x in sink.results(stream).collect()}
    assert (9, 0, 2) in emitted
    left = {(x["user_id"], x["begin"], x["begin"] + x["length"]) for x in sink.open_state().collect() if x["begin"] >= 0 and x["length"] >= Q.SHORTEST}
    want = {(u, lo, hi) for u in {x[0] for x in rows} for lo, hi in runs_of([(x[2], x[3]) for x in rows if x[0] == u], Q.QUIET) if hi - lo >= Q.SHORTEST}
    assert emitted | left == want and not emitted & left


def test_late_rows_are_dropped_and_counted(spark):
    rows = [(i, i * Q.HOUR, 0) for i in range(100)] + [(200 + i, (5 + i) * Q.HOUR, 1) for i in range(3)] + [(300, 120 * Q.HOUR, 1)]
    df = spark.createDataFrame(rows, "event_id long, at long, part int").withColumn("ts", F.timestamp_micros("at"))
    build = lambda s: s.withWatermark("ts", "2 hours").groupBy(F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    got = {x["w"]["start"]: x["n"] for x in R.arrivals(df, F.col("part"), 2, build).collect()}
    assert sum(got.values()) == 100 and max(got.values()) == 6  # three rows behind the watermark; the window of row 300 is open


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    monkeypatch.setattr(type(spark.conf), "get", lambda self, k, d=None: None)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077", raising=False)
    with pytest.raises(ValueError, match="checkpoint"):
        R.work_folder(spark)


def test_session_and_batch_states_are_pandas_frames():
    state, closed, until = Q.runs_of_batch(None, pd.DataFrame({"value": [50.0, 60.0, 1.0, 70.0], "at": [0, 1, 2, 3]}))
    assert closed.values.tolist() == [[0, 2]] and state == (3, 1, 3, 4) and until * 1000 > 3 + Q.QUIET
    assert Q.close_run(state)[0] == (-1, 0, 0, 4) and not len(Q.close_run(state)[1])

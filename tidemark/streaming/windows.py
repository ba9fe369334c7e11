"""Live windows of measurements: what a client must send, and repeats of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A payload as sent: frames of coefficients, a rotation for each frame or none, and the frame rate
PAYLOAD = "blendshapes array<array<double>>, head_pose array<array<array<double>>>, fps double, utterance_id string"
#: Coefficients of a frame, the fewest frames of a window, the highest frame rate
WIDTH, FEWEST, FASTEST = 52, 8, 240.0


def _odd(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def fault(p: Column, width: int = WIDTH, fewest: int = FEWEST, fastest: float = FASTEST) -> Column:
    """Why a parsed payload can't be measured, the first rule it breaks; NULL if none.

    ``missing``: no frames were sent, or no such object; ``width``: a frame has another number of coefficients;
    ``short``: fewer frames than ``fewest``; ``not_finite``: a coefficient that is no finite number; ``pose_length``: not
    one rotation for each frame (no rotations at all are allowed), ``pose_not_finite``; ``rate``: not in (0, fastest].
    Windows are never repaired.
    """
    frames, pose, rate = p["blendshapes"], p["head_pose"], F.coalesce(p["fps"], F.lit(0.0))
    wide = lambda f: f.isNull() | (F.size(f) != width)
    rules = [
        (frames.isNull(), "missing"),
        (F.exists(frames, wide), "width"),
        (F.size(frames) < fewest, "short"),
        (F.exists(frames, lambda f: F.exists(f, _odd)), "not_finite"),
        (pose.isNotNull() & (F.size(pose) != F.size(frames)), "pose_length"),
        (F.exists(pose, lambda m: m.isNull() | F.exists(m, lambda r: r.isNull() | F.exists(r, _odd))), "pose_not_finite"),
        (F.isnan(rate) | (rate <= 0) | (rate > fastest), "rate"),
    ]
    out = F.lit(None).cast("string")
    for broken, name in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(False)), name).otherwise(out)
    return out


def judged(stream: DataFrame, payload: str = "payload", width: int = WIDTH) -> DataFrame:
    """``stream`` with ``window``, the parsed payload, and ``fault``."""
    s = stream.withColumn("window", F.from_json(payload, PAYLOAD))
    return s.withColumn("fault", fault(F.col("window"), width))


def first_deliveries(stream: DataFrame, key: list[str], time: str, within: str) -> DataFrame:
    """Rows whose key was not delivered before. A key is forgotten once the watermark, ``within`` behind the latest
    time, has passed its first delivery by ``within``; a repeat after that is a new delivery. So the state is bounded by
    the keys of that span, whatever the length of the stream."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(key)

"""Causal filters of one series on numpy arrays, for tasks that hold a series (``series.fold_long``) or a batch of it
(``streaming.run.per_key``). Each takes what it remembers and the next values, and returns both; none loops over rows but
``one_euro``, whose rate depends on its own output."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd


def exponential_mean(values: np.ndarray, share: float, last: float) -> np.ndarray:
    """Each value takes ``share`` of the distance from the mean before it, ``last`` at first."""
    return pd.Series(np.append(last, values)).ewm(alpha=share, adjust=False).mean().to_numpy()[1:]


def band_energy(values: np.ndarray, shares: tuple[float, float, float], last: tuple | None) -> tuple[tuple, np.ndarray]:
    """Root of the mean squared difference of a fast and a slow mean; ``last`` holds the three means."""
    skip = 0
    if last is None:
        last, skip = (values[0], values[0], 0.0), 1
    fast, slow = (np.append(m, exponential_mean(values[skip:], a, m)) for a, m in zip(shares[:2], last[:2], strict=True))
    held = exponential_mean((fast - slow)[1:] ** 2, shares[2], last[2])
    energy = np.append(last[2], held) if skip else held
    return (fast[-1], slow[-1], energy[-1] if len(energy) else last[2]), np.sqrt(energy)


BLOCK = 256


def turns(values: np.ndarray, least: float, way: float, reach: float) -> tuple[np.ndarray, float, float]:
    """Rows at which a series turns: those that lie at least ``least`` back from the furthest value since the last turn.

    ``way`` is the sign of the movement, 0 before the first swing of ``least`` away from ``reach``, and ``reach`` the
    furthest value on it. The furthest values of a block are a running maximum, so a step finds a whole turn.
    """
    flags = np.zeros(len(values), bool)
    at = 0
    while at < len(values):
        part = values[at : at + BLOCK]
        if way:
            furthest = np.maximum.accumulate(np.append(way * reach, way * part))[1:]
            back = furthest - way * part >= least
            reach = way * furthest[-1]
        else:
            back = np.abs(part - reach) >= least
        if not back.any():
            at += len(part)
            continue
        j = int(back.argmax())
        flags[at + j] = way != 0
        way = -way if way else float(np.sign(part[j] - reach))
        reach = float(part[j])
        at += j + 1
    return flags, float(way), float(reach)


def recent(flags: np.ndarray, times: np.ndarray, window: int, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many turns lie at most ``window`` before each row, and the times of those that the next rows may still count."""
    at = np.concatenate((before, times[flags])).astype(np.int64)
    upto = len(before) + np.cumsum(flags)
    n = upto - np.searchsorted(at, times - window, side="left")
    return n, at[at >= times[-1] - window] if len(times) else at


def adaptive_level(values: np.ndarray, size: int, every: int, last: tuple | None) -> tuple[tuple, np.ndarray]:
    """Values between the 20th and the 95th percentile of the last ``size``, which are taken anew at every
    ``every``-th row. ``last`` holds the ring of values, the number of rows and both percentiles."""
    ring, n, lo, hi = last or ((), 0, 0.0, 0.0)
    seen = pd.Series(np.append(ring, values)).rolling(size, min_periods=1)
    fresh = (n + np.arange(len(values))) % every == 0
    ends = []
    for q, old in ((0.2, lo), (0.95, hi)):
        x = np.where(fresh, seen.quantile(q).to_numpy()[len(ring) :], np.nan)
        ends.append(pd.Series(np.append(old, x)).ffill().to_numpy()[1:])
    low, high = ends
    with np.errstate(divide="ignore", invalid="ignore"):
        level = np.where(high > low, np.maximum(0.0, (values - low) / (high - low)), 0.0)
    return ([float(x) for x in np.append(ring, values)[-(size - 1) :]], n + len(values), float(low[-1]), float(high[-1])), level


def one_euro(values: np.ndarray, rate: float, least: float, slope: float) -> np.ndarray:
    """Adaptive low-pass: the smoothed speed raises the cutoff."""
    share = lambda cutoff: 1 / (1 + rate / (2 * math.pi * cutoff))
    own, y, speed, out = share(1.0), float(values[0]), 0.0, []
    for v in values.tolist():
        speed += own * ((v - y) * rate - speed) if out else 0.0
        y += share(least + slope * abs(speed)) * (v - y)
        out.append(y)
    return np.array(out)

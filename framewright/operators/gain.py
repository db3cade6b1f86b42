"""Gain control: divisors from curves, modulation, demodulation, and curves of whole tracks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions import tables as T
from framewright.operators import sequence as Q
from framewright.operators.curve_start import with_first_point
from framewright.operators.framing import over_track

NEUTRAL, REGION = 4, 8


def divisors(points: list[tuple[int, int]], n: int = 256) -> np.ndarray:
    """Divisor of every sample for (level, loc) points: a level holds up to 8 * loc, then glides in 8 samples to the next one (at last to neutral)."""
    out, pos = np.ones(n), 0
    for k, (level, loc) in enumerate(points):
        following = points[k + 1][0] if k + 1 < len(points) else NEUTRAL
        last = loc * REGION
        out[pos:last] = T.GAIN_LEVEL[level]
        step = T.GAIN_STEP[following - level + 15]
        out[last : last + REGION] = T.GAIN_LEVEL[level] * step ** np.arange(min(REGION, max(0, n - last)))
        pos = last + REGION
    return out


def modulate(current: np.ndarray, following: np.ndarray, points: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """A half frame and the next one, divided so that the transform sees a steady level: the first by the first level, the second sample by sample."""
    if not points:
        return current, following
    return current / T.GAIN_LEVEL[points[0][0]], following / divisors(points, len(following))


def demodulate(current: np.ndarray, before: np.ndarray, now: list[tuple[int, int]], later: list[tuple[int, int]]) -> np.ndarray:
    """The overlap of two decoded halves with both gains undone: ``later`` begins in the next frame and scales this half."""
    scale = T.GAIN_LEVEL[later[0][0]] if later else 1.0
    return (current * scale + before) * divisors(now, len(current))


def _with_points(profiles: DataFrame, least: float) -> DataFrame:
    """Adds target, last_level, last_target and points to profiles.

    Besides its own profile, a frame's curve needs the last level and the target of the
    frame before, which depend on that frame alone.
    """
    rows = profiles.withColumn("i", F.col("frame")).withColumn("target", Q.curve_target(F.col("level")))
    rows = over_track(
        rows, 1, 0, lambda w: {"last_level": F.lag(F.element_at("level", -1), 1, 0.0).over(w), "last_target": F.lag("target", 1, 0.0).over(w)}, 1024
    )
    return rows.withColumn("points", Q.gain_curve(F.col("level"), F.col("low"), F.col("high"), F.col("last_level"), F.col("last_target"), F.lit(least)))


def curves(profiles: DataFrame, least: float = 1.5) -> DataFrame:
    """(track, ch, frame, target, points) of profiles (track, ch, frame, level, low, high arrays)."""
    return _with_points(profiles, least).select("track", "ch", "frame", "target", "points")


def decisions(profiles: DataFrame, band: Column, least: float = 1.5) -> DataFrame:
    """All that decides on a frame's gain points: (track, ch, frame, band, level, target, last_level, last_target, points, first).

    ``first`` holds the numbers behind the point at 0 and the points with it. Written with
    ``write.json`` it is a log of decisions, a document a frame.
    """
    rows = _with_points(profiles, least).withColumn("band", band)
    points = F.transform("points", lambda p: F.struct(p["level"].cast("int").alias("level"), p["loc"].cast("int").alias("loc")))
    first = with_first_point(F.col("level"), F.col("last_target"), F.col("target"), points, F.col("band"))
    return rows.select("track", "ch", "frame", "band", "level", "target", "last_level", "last_target", points.alias("points"), first.alias("first"))

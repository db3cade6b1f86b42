"""Windowed lapped transforms of the second and third codec, and their inverses.

A frame is transformed together with the frame before it, which is a lag within blocks of
frames. Windows are applied as column expressions; the transform itself is one matrix
product per Arrow batch. The inverse overlaps each transformed pair with the one before.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions import tables as T
from framewright.operators.framing import band_reverse, over_track
from framewright.operators.transforms import imdct, mdct

#: Frames of a block; a frame has some hundred samples.
FRAMES = 1024


def _with_previous(frames: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the value of the frame before; null before the first."""
    rows = frames.withColumn("i", F.col("frame"))
    return over_track(rows, 1, 0, lambda w: {out: F.lag(value).over(w)}, FRAMES).drop("i")


def _times(x: Column, window: Column) -> Column:
    return F.zip_with(x, window, lambda a, b: a * b)


def rising(half: int, steep: bool) -> list[float]:
    """The first half of a window of the third codec: a sine, or a steep one with flat ends."""
    if not steep:
        return [2 * math.sin((i + 0.5) * math.pi / (2 * half)) for i in range(half)]
    edge = half // 4
    return [0.0] * edge + rising(half // 2, False) + [2.0] * edge


def _third_window(steep: Column, half: int, falling: bool) -> Column:
    sine, flat = ([*reversed(w)] if falling else w for w in (rising(half, False), rising(half, True)))
    return F.when(F.coalesce(steep, F.lit(False)), F.lit(flat)).otherwise(F.lit(sine))


def second_codec(bands: DataFrame) -> DataFrame:
    """(track, ch, frame, c, peak) of frames of 256 samples of band ``ch``: coefficients, odd bands reversed, and the largest level."""
    rows = _with_previous(bands, "x", "before")
    silent = F.array_repeat(F.lit(0.0), 256)
    held = _times(F.coalesce("before", silent), F.lit(T.ENCODE_WINDOW))
    pair = F.concat(held, _times(F.col("x"), F.lit(T.ENCODE_WINDOW[::-1])))
    peak = F.array_max(F.transform("x", F.abs))
    return rows.select("track", "ch", "frame", mdct(pair, 512).alias("c"), peak.alias("peak")).withColumn("c", band_reverse(F.col("c"), F.col("ch")))


def second_codec_inverse(coefficients: DataFrame) -> DataFrame:
    """(track, ch, frame, x): the samples of the frame before ``frame``, from its two transforms."""
    window = F.lit([*T.DECODE_WINDOW, *T.DECODE_WINDOW[::-1]])
    # The transform and its inverse give 256 times a sample, the two windows twice, its mirror image cancels.
    inverse = imdct(band_reverse(F.col("c"), F.col("ch")), 512, 1 / 256)
    rows = coefficients.select("track", "ch", "frame", inverse.alias("v")).withColumn("v", _times(F.col("v"), window))
    return _overlapped(rows, 256)


def third_codec(bands: DataFrame) -> DataFrame:
    """(track, ch, frame, steep, c) of frames of 128 samples of band ``ch``; ``steep`` picks the window of the frame's own samples."""
    rows = _with_previous(bands.withColumn("own", F.struct("x", "steep")), "own", "before")
    silent = F.array_repeat(F.lit(0.0), 128)
    held = _times(F.coalesce("before.x", silent), _third_window(F.col("before.steep"), 128, False))
    pair = F.concat(held, _times(F.col("x"), _third_window(F.col("steep"), 128, True)))
    return rows.select("track", "ch", "frame", "steep", mdct(pair, 256).alias("c")).withColumn("c", band_reverse(F.col("c"), F.col("ch")))


def third_codec_inverse(coefficients: DataFrame) -> DataFrame:
    """(track, ch, frame, x): the samples of the frame before ``frame``."""
    rows = _with_previous(coefficients, "steep", "was_steep")
    # The transform and its inverse give 128 times a sample, the squares of both windows add up to 4.
    rows = rows.select("track", "ch", "frame", "steep", "was_steep", imdct(band_reverse(F.col("c"), F.col("ch")), 256, 1 / 256).alias("v"))
    window = F.concat(_third_window(F.col("was_steep"), 128, False), _third_window(F.col("steep"), 128, True))
    return _overlapped(rows.withColumn("v", _times(F.col("v"), window)), 128)


def _overlapped(rows: DataFrame, half: int) -> DataFrame:
    """Adds the first half of each frame's vector ``v`` to the second half of the one before; the first frame has none."""
    rows = _with_previous(rows.select("track", "ch", "frame", "v"), "v", "before")
    added = F.zip_with(F.slice("v", 1, half), F.slice("before", half + 1, half), lambda a, b: a + b)
    return rows.where("before IS NOT NULL").select("track", "ch", "frame", added.alias("x"))

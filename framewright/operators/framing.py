"""Framing and reshaping of sample streams.

A signal is (track, ch, i, x): one row a sample. Frames are (track, ch, frame, x) with x an
array. Windows over the whole of a track would put it into one task; ``with_halo`` cuts it
into blocks that carry copies of their neighbours' edge samples instead, so any operator
with a finite memory runs on blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65536


def block_step(signal: DataFrame, step: int) -> DataFrame:
    """Adds frame and pos: sample i is number i % step of frame i div step."""
    return signal.withColumn("frame", F.floor(F.col("i") / step)).withColumn("pos", F.pmod(F.col("i"), F.lit(step)).cast("int"))


def deinterleave(signal: DataFrame, channels: int) -> DataFrame:
    """Channel c gets samples c, c + channels, ... as its samples 0, 1, ..."""
    return signal.withColumn("ch", F.pmod(F.col("i"), F.lit(channels)).cast("int")).withColumn("i", F.floor(F.col("i") / channels))


def interleave_clip(left: Column, right: Column) -> Column:
    """Two channel arrays as one, each sample limited to [-1, 1]."""
    clip = lambda x: F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))
    return F.flatten(F.zip_with(left, right, lambda a, b: F.array(clip(a), clip(b))))


def frames(signal: DataFrame, size: int) -> DataFrame:
    """Arrays of ``size`` samples; missing samples of a short last frame are zero."""
    cut = block_step(signal, size)
    packed = cut.groupBy("track", "ch", "frame").agg(F.map_from_entries(F.collect_list(F.struct("pos", "x"))).alias("m"))
    return packed.select("track", "ch", "frame", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda p: F.coalesce(F.try_element_at("m", p), F.lit(0.0))).alias("x"))


def with_halo(signal: DataFrame, before: int, after: int, size: int = BLOCK) -> DataFrame:
    """Adds block and core. A row also appears in the next (previous) block if that needs it as history (look-ahead)."""
    home = F.floor(F.col("i") / size)
    spread = F.sequence(F.floor((F.col("i") - after) / size), F.floor((F.col("i") + before) / size))
    out = signal.withColumn("home", home).withColumn("block", F.explode(spread))
    return out.withColumn("core", F.col("home") == F.col("block")).where("block >= 0").drop("home")


def over_track(signal: DataFrame, before: int, after: int, column: Callable[[Window], dict[str, Column]], size: int = BLOCK) -> DataFrame:
    """Adds window columns that look ``before`` samples back and ``after`` ahead within a track and channel."""
    w = Window.partitionBy("track", "ch", "block").orderBy("i")
    out = with_halo(signal, before, after, size).withColumns(column(w))
    return out.where("core").drop("core", "block")


def band_reverse(x: Column, band: Column) -> Column:
    """Odd bands in reverse order."""
    return F.when(band % 2 == 1, F.reverse(x)).otherwise(x)


def spectral_flip(x: Column) -> Column:
    """Changes the sign of samples 0, 2, 4, ..."""
    return F.transform(x, lambda v, i: F.when(i % 2 == 0, -v).otherwise(v))


def mid_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """(i, mid, side) of two signals that are joined by track and sample number."""
    r = right.select("track", "i", F.col("x").alias("r"))
    return left.select("track", "i", F.col("x").alias("l")).join(r, ["track", "i"]).select("track", "i", ((F.col("l") + F.col("r")) / 2).alias("mid"), ((F.col("l") - F.col("r")) / 2).alias("side"))


def dense_index(rows: DataFrame, part: str, order: str, out: str = "i", size: int = BLOCK) -> DataFrame:
    """Numbers the rows of each ``part`` from 0 in the order of the integer column ``order``.

    Rows are ranked within blocks of the order column, and blocks get the counts of those
    before them from a small table (a row for each part and block), so no part is one task.
    """
    cut = rows.withColumn("__block", F.floor(F.col(order) / size))
    counts = cut.groupBy(part, "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(part).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(part, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy(part, "__block").orderBy(order)) - 1
    return cut.withColumn("__rank", rank).join(offsets, [part, "__block"]).withColumn(out, (F.col("__rank") + F.col("__before")).cast("long")).drop("__block", "__rank", "__before")


def look_ahead(frames_: DataFrame, value: str, size: int = BLOCK) -> DataFrame:
    """Adds the value of the next and of the previous frame, 0 beyond the ends."""
    rows = frames_.withColumn("i", F.col("frame"))
    return over_track(rows, 1, 1, lambda w: {"next": F.lead(value, 1, 0.0).over(w), "previous": F.lag(value, 1, 0.0).over(w)}, size).drop("i")


def double_mono(payload: Column) -> Column:
    """A mono frame twice, as containers without mono want it."""
    return F.concat(payload, payload)


def byte_reverse(payload: Column) -> Column:
    """The bytes of a binary in reverse order."""
    pairs = F.regexp_extract_all(F.hex(payload), F.lit("(..)"), F.lit(1))
    return F.unhex(F.array_join(F.reverse(pairs), ""))


def silent_side(frames_: DataFrame) -> DataFrame:
    """Adds a silent channel 1 to frames of channel 0."""
    silent = frames_.withColumn("ch", F.lit(1)).withColumn("x", F.transform("x", lambda v: v * 0.0))
    return frames_.unionByName(silent)

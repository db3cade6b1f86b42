"""Aggregates over blocks, frames, bands and units. All are partial-aggregation friendly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions import tables as T
from framewright.operators.framing import block_step


def rms(x: str | Column) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.sqrt(F.avg(x * x))


def peak(x: str) -> Column:
    return F.max(F.abs(F.col(x)))


def block_profile(signal: DataFrame, frame: int, block: int) -> DataFrame:
    """RMS, peak and energy of every block of a frame."""
    cut = block_step(signal, frame).withColumn("sub", F.floor(F.col("pos") / block).cast("int"))
    return cut.groupBy("track", "ch", "frame", "sub").agg(rms("x").alias("rms"), peak("x").alias("peak"), F.sum(F.col("x") * F.col("x")).alias("energy"))


def inner_quartiles(signal: DataFrame, frame: int, block: int, chunks: int = 8) -> DataFrame:
    """RMS of each block and the nearest-rank quartiles of the RMS of its ``chunks`` parts (no interpolation)."""
    part = max(1, block // chunks)
    cut = block_step(signal, frame).withColumn("sub", F.floor(F.col("pos") / block).cast("int")).withColumn("chunk", F.floor(F.col("pos") % block / part).cast("int"))
    small = cut.groupBy("track", "ch", "frame", "sub", "chunk").agg(rms("x").alias("r"), F.sum(F.col("x") * F.col("x")).alias("e"), F.count("*").alias("n"))
    whole = small.groupBy("track", "ch", "frame", "sub").agg(F.sqrt(F.sum("e") / F.sum("n")).alias("level"), F.sort_array(F.collect_list("r")).alias("s"))
    n = F.size("s")
    return whole.select("track", "ch", "frame", "sub", "level", F.get("s", F.floor(n / 4).cast("int")).alias("low"), F.get("s", F.floor(n * 3 / 4).cast("int")).alias("high"))


def lower_median(values: Column) -> Column:
    """Element (n - 1) div 2 of the sorted array."""
    return F.get(F.sort_array(values), F.floor((F.size(values) - 1) / 2).cast("int"))


def energy(x: Column) -> Column:
    """Sum of squares of an array."""
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)


def spectrum_rows(frames_: DataFrame, x: str = "x") -> DataFrame:
    """One row a line: adds line and c to the other columns."""
    rest = [c for c in frames_.columns if c != x]
    return frames_.select(*rest, F.posexplode(x).alias("line", "c"))


def by_unit(lines: DataFrame, widths: list[int], bands: list[int]) -> DataFrame:
    """Adds unit, band and width by the layout, a table of one row a line that is broadcast."""
    return lines.join(F.broadcast(T.unit_table(lines.sparkSession, widths, bands)), "line")


def scale_index(peak_value: Column) -> Column:
    """Index of the least scale 2^(i/3 - 21) that is not below ``peak_value``, 63 at most.

    The scale is dense in the logarithm, so the as-of lookup is a rounded logarithm that is
    corrected by comparing with the neighbouring table values.
    """
    scale = F.lit(T.SCALE)
    guess = F.least(F.lit(63), F.greatest(F.lit(0), F.ceil(3 * (F.log2(F.greatest(peak_value, F.lit(1e-12))) + 21)).cast("int")))
    lower = F.greatest(guess - 1, F.lit(0))
    upper = F.least(guess + 1, F.lit(63))
    return F.when(F.get(scale, lower) >= peak_value, lower).when(F.get(scale, guess) >= peak_value, guess).otherwise(upper)


def scale_units(units: DataFrame, keys: list[str]) -> DataFrame:
    """Scale index, scale and energy of each unit."""
    out = units.groupBy(*keys, "band", "unit").agg(F.max(F.abs(F.col("c"))).alias("m"), F.sum(F.col("c") * F.col("c")).alias("energy"))
    return out.withColumn("sf", scale_index(F.col("m"))).withColumn("scale", F.get(F.lit(T.SCALE), F.col("sf")))


def flatness(units: DataFrame, keys: list[str], floor: float = 1e-12) -> DataFrame:
    """Spectral flatness of each unit's energies, 1 where it is silent, limited to [0, 1]."""
    e = F.col("c") * F.col("c")
    out = units.groupBy(*keys, "unit").agg(F.avg(F.ln(F.greatest(e, F.lit(floor)))).alias("l"), F.avg(e).alias("a"))
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp("l") / F.col("a")))
    return out.select(*keys, "unit", F.when(F.col("a") <= floor, 1.0).otherwise(value).alias("flatness"))


def scale_spread(scaled: DataFrame, keys: list[str]) -> DataFrame:
    """Population deviation of the scale indices, limited to 14 and divided by it."""
    return scaled.groupBy(*keys).agg((F.least(F.stddev_pop("sf"), F.lit(14.0)) / 14.0).alias("spread"))


def tilt(scaled: DataFrame, keys: list[str]) -> DataFrame:
    """Mean scale index of band 0 minus that of band 1; 0 if one of them is empty."""
    low, mid = (F.avg(F.when(F.col("band") == b, F.col("sf"))) for b in (0, 1))
    return scaled.groupBy(*keys).agg(F.coalesce(low - mid, F.lit(0.0)).alias("tilt"))


def weighted_loudness(lines: DataFrame, keys: list[str], count: int, scale: Column | None = None) -> DataFrame:
    """Sum of line energies times the loudness curve of ``count`` lines."""
    curve = F.get(F.lit(T.loudness_curve(count)), F.col("line"))
    e = F.col("c") * F.col("c") * curve
    return lines.groupBy(*keys).agg(F.sum(e if scale is None else e * scale).alias("loudness"))


def safe_energy_ratio(before: Column, after: Column, least: float = 1e-20) -> Column:
    """before / after, 1 where one of them is no positive finite number."""
    bad = F.isnan(before) | F.isnan(after) | (before <= least) | (after <= least)
    return F.when(bad, 1.0).otherwise(F.try_divide(before, after))


def cheaper_mode(rows: DataFrame, keys: list[str], fixed: str, variable: str) -> DataFrame:
    """Total bits of both coders and the cheaper one; the fixed-length coder on a tie."""
    out = rows.groupBy(*keys).agg(F.sum(fixed).alias("fixed_bits"), F.sum(variable).alias("variable_bits"))
    return out.withColumn("mode", F.when(F.col("fixed_bits") <= F.col("variable_bits"), "fixed").otherwise("variable"))


def best_table(costs: DataFrame, keys: list[str], cost: str = "cost", table: str = "table") -> DataFrame:
    """The first table of least cost."""
    best = F.min(F.struct(F.col(cost).alias("c"), F.col(table).alias("t")))
    return costs.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.t").alias(table), F.col("b.c").alias(cost))


def window_counts(rows: DataFrame, keys: list[str], pos: str, size: int = 64) -> DataFrame:
    """Components in every group of ``size`` lines."""
    return rows.groupBy(*keys, F.floor(F.col(pos) / size).alias("group")).agg(F.count("*").alias("n"))

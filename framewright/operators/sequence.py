"""Operators over the order of samples, blocks and frames."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.framing import over_track


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, where the plain expression would be computed at every use."""
    return F.get(F.transform(F.array(value), body), 0)


def rise_and_fall(levels: DataFrame, rise: float = 16.0, fall: float = 20.0, size: int = 65536) -> DataFrame:
    """Flags transients of a signal of block levels (x, linear RMS; i, block number over the track).

    Levels compare as 19 * log10. Silence has no logarithm: between two silent blocks there
    is no transient, from and to sound there is one. Before the first block the level is 0 dB,
    so a silent first block is flagged.
    """
    def columns(w: Window) -> dict[str, Column]:
        silent = F.col("x") <= 0
        db = 19 * F.log10(F.when(~silent, F.col("x")))
        first = F.lag("i").over(w).isNull()
        before = F.when(first, 0.0).otherwise(F.lag(db).over(w))
        was_silent = ~first & F.lag(silent).over(w)
        flag = F.when(silent & was_silent, False).when(silent | was_silent, True).otherwise((db - before > rise) | (before - db > fall))
        return {"transient": flag}

    return over_track(levels, 1, 0, columns, size)


def median3(w_value: str, w: Window) -> Column:
    """Median of a value and its neighbours; at an edge the larger of two."""
    return F.element_at(F.sort_array(F.collect_list(w_value).over(w.rowsBetween(-1, 1))), (F.floor(F.count("*").over(w.rowsBetween(-1, 1)) / 2) + 1).cast("int"))


def median3_array(x: Column) -> Column:
    """``median3`` for every element of an array."""
    def one(v: Column, i: Column) -> Column:
        near = F.sort_array(F.slice(x, F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3)))
        return F.get(near, F.floor(F.size(near) / 2).cast("int"))

    return F.transform(x, one)


def plateau(profile: Column, length: int = 3) -> Column:
    """(level, last, release) of the highest level that a profile holds for ``length`` elements.

    ``last`` is the plateau's last element (-1 without one). A release means that the profile
    ends below a tenth of the level, or below half of it without coming above 70 % again.
    """
    n = F.size(profile)

    def found(smooth: Column, level: Column) -> Column:
        ok = level >= 1e-6
        begin = (F.array_position(floors(smooth), level) + (length - 2)).cast("int")
        below = F.filter(F.transform(smooth, lambda v, i: F.when((i > begin) & (v < level), i).otherwise(n)), lambda i: i < n)
        last = F.coalesce(F.array_min(below), n) - 1
        tail = F.element_at(profile, -1)

        def result(last: Column) -> Column:
            high = F.exists(F.slice(profile, last + 2, n), lambda v: v >= level * 0.7)
            release = (last < n - 1) & ((tail < level * 0.1) | (~high & (tail < level * 0.5)))
            return F.struct(F.when(ok, level).otherwise(0.0).alias("level"), F.when(ok, last).otherwise(-1).alias("last"), F.when(ok, release).otherwise(False).alias("release"))

        return let(last, result)

    def floors(smooth: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(n - length + 1, F.lit(1))), lambda j: F.array_min(F.slice(smooth, j, length)))

    def best(smooth: Column) -> Column:
        level = F.when(n >= length, F.greatest(F.array_max(floors(smooth)), F.lit(0.0))).otherwise(0.0)
        return let(level, lambda v: found(smooth, v))

    return let(median3_array(profile), best)


def boundary_scores(profile: Column, reach: int = 3) -> Column:
    """For the boundaries before elements 1, 2, ...: the ratio of the maxima on both sides, at least 1."""
    def score(k: Column) -> Column:
        lo = F.greatest(k - reach, F.lit(0))
        left, right = F.array_max(F.slice(profile, lo + 1, k - lo)) + 1e-9, F.array_max(F.slice(profile, k + 1, reach)) + 1e-9
        return F.greatest(left / right, right / left)

    return F.transform(F.sequence(F.lit(1), F.size(profile) - 1), score)


def level_index(ratio: Column) -> Column:
    """Gain level of an amplitude ratio: 4 is neutral, a step is a factor of 2, fractions are cut."""
    down = 4 + F.floor(F.log2(F.floor(1 / F.greatest(ratio, F.lit(2.0**-11)))))
    up = 4 - F.floor(F.log2(F.greatest(F.floor(F.least(ratio, F.lit(16.0))), F.lit(1.0))))
    return F.when(ratio <= 0.5, down).otherwise(up).cast("int")


def sticky_levels(centre: Column, low: Column, high: Column) -> Column:
    """Levels of a profile (all relative to the target); a change by one is undone while the range supports the old level."""
    rows = F.arrays_zip(centre.alias("c"), low.alias("l"), high.alias("h"))

    def step(acc: Column, r: Column) -> Column:
        level, a, b = level_index(r["c"]), level_index(r["l"]), level_index(r["h"])
        before = F.element_at(acc, -1)
        keep = (F.size(acc) > 0) & (F.abs(a - b) <= 1) & (F.abs(level - before) == 1) & (before >= F.least(a, b)) & (before <= F.greatest(a, b))
        return F.concat(acc, F.array(F.when(keep, before).otherwise(level)))

    return F.aggregate(rows, F.array().cast("array<int>"), step)


def transitions(levels: Column, scores: Column, least: Column | float) -> Column:
    """Gain points (level, loc, delta) of a staircase, scanned from the right.

    The last change to the neutral level 4 and changes by two and more are kept always,
    changes by one where the boundary's score is at least ``least``.
    """
    n = F.size(levels)
    inner = F.slice(levels, 1, n - 1)
    end = F.aggregate(F.transform(inner, lambda v, i: F.when(v != 4, i + 1).otherwise(0)), F.lit(0), lambda a, v: F.greatest(a, v))
    order = F.reverse(F.filter(F.transform(levels, lambda v, i: F.struct((i + 1).alias("loc"), v.alias("level"))), lambda t: t["loc"] <= end))
    kind = "array<struct<level:int,loc:int,delta:int>>"

    def step(acc: Column, t: Column) -> Column:
        delta = F.abs(t["level"] - acc["before"])
        keep = (delta > 0) & ((t["loc"] == end) | (delta >= 2) | (F.coalesce(F.get(scores, t["loc"] - 1), F.lit(1.0)) >= least))
        point = F.array(F.struct(t["level"].alias("level"), t["loc"].alias("loc"), delta.alias("delta")))
        return F.struct(F.when(keep, t["level"]).otherwise(acc["before"]).alias("before"), F.when(keep, F.concat(acc["points"], point)).otherwise(acc["points"]).alias("points"))

    start = F.struct(F.lit(4).alias("before"), F.array().cast(kind).alias("points"))
    return F.aggregate(order, start, step, lambda a: F.reverse(a["points"]))


def top_points(points: Column, most: int = 6) -> Column:
    """The ``most`` points with the largest change, the rightmost on a tie, in order of place."""
    ranked = F.array_sort(points, lambda a, b: F.when(a["delta"] != b["delta"], b["delta"] - a["delta"]).otherwise(b["loc"] - a["loc"]))
    return F.array_sort(F.slice(ranked, 1, most), lambda a, b: a["loc"] - b["loc"])


def gain_curve(profile: Column, low: Column, high: Column, last_level: Column, last_target: Column, least: Column | float) -> Column:
    """Gain points of a frame's profile, given the previous frame's last level and target."""
    top = F.array_max(profile)
    none = F.array().cast("array<struct<level:int,loc:int,delta:int>>")

    def with_target(target: Column) -> Column:
        floor = F.greatest(target, F.lit(1e-9))
        between = F.when(last_target > 1e-6, F.greatest(last_target, target) / F.greatest(F.least(last_target, target), F.lit(1e-9))).otherwise(1.0)
        stable = (top / floor <= 7) & (between <= 10)
        relative = lambda a: F.transform(a, lambda v: v / floor)

        def points(smooth: Column) -> Column:
            levels = F.when(stable, sticky_levels(relative(smooth), relative(low), relative(high))).otherwise(F.transform(relative(smooth), level_index))
            return let(levels, lambda v: let(boundary_scores(smooth), lambda b: top_points(transitions(v, b, least))))

        return F.when((target < 1e-6) | (last_level < 1e-6), none).otherwise(let(median3_array(profile), points))

    return let(curve_target(profile), with_target)


def curve_target(profile: Column) -> Column:
    """The level that a frame's gain is relative to: its plateau if that is high and lasts, else its last element."""
    top = F.array_max(profile)
    return let(plateau(profile), lambda p: F.when((p["level"] > 1e-6) & ~p["release"] & (p["level"] >= top * 0.4), p["level"]).otherwise(F.element_at(profile, -1)))


def islands(rows: DataFrame, keys: list[str], pos: str, most: int | None = None) -> DataFrame:
    """Adds run (first position) to rows of consecutive positions, cut after ``most`` of them."""
    w = Window.partitionBy(*keys).orderBy(pos)
    out = rows.withColumn("__run", F.col(pos) - F.row_number().over(w))
    inner = Window.partitionBy(*keys, "__run").orderBy(pos)
    out = out.withColumn("__part", F.floor((F.row_number().over(inner) - 1) / (most or 1 << 30)))
    return out.withColumn("run", F.min(pos).over(Window.partitionBy(*keys, "__run", "__part"))).drop("__run", "__part")


def longest_run(flags: Column, least: int = 1) -> Column:
    """(start, length) of the first longest run of true in an array of booleans; length 0 below ``least``."""
    def step(a: Column, f: Column) -> Column:
        n = F.when(f, a["n"] + 1).otherwise(0)
        better = n > a["best"]
        return F.struct((a["i"] + 1).alias("i"), n.alias("n"), F.when(better, n).otherwise(a["best"]).alias("best"), F.when(better, a["i"] + 1 - n).otherwise(a["start"]).alias("start"))

    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(0).alias("best"), F.lit(0).alias("start"))
    return F.aggregate(flags, start, step, lambda a: F.struct(F.when(a["best"] >= least, a["start"]).otherwise(0).alias("start"), F.when(a["best"] >= least, a["best"]).otherwise(0).alias("length")))


def strongest_run(x: Column, most: int = 5) -> Column:
    """(score, start, length) of the run of up to ``most`` elements with the largest sum of magnitudes; the first, then the shortest."""
    n = F.size(x)
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), n - i)), lambda k: F.struct(F.round(F.aggregate(F.slice(x, i + 1, k), F.lit(0.0), lambda s, v: s + F.abs(v)), 9).alias("score"), (-i).alias("i"), (-k).alias("k")))))
    best = F.array_max(pairs)
    return F.struct(best["score"].alias("score"), (-best["i"]).alias("start"), (-best["k"]).alias("length"))


def delta_code(x: Column, bits: int = 3) -> Column:
    """Differences from the element before, modulo 2^bits; the first element as it is."""
    return F.transform(x, lambda v, i: F.when(i == 0, v).otherwise(v - F.get(x, F.greatest(i - 1, F.lit(0)))).bitwiseAND((1 << bits) - 1))


def bit_width(x: Column) -> Column:
    """Bits of a non-negative number, 1 for 0."""
    return F.length(F.bin(x))


def frequency_pack(x: Column, full: int = 10) -> Column:
    """(order, bits) of the cheaper coding of ascending numbers below 2^full.

    Ascending: the first in ``full`` bits, each next one in as many bits as full scale minus
    the number before leaves. Descending: the last first, each next one in as many bits as the
    number before it has. A single number is coded ascending; ties are descending.
    """
    top = (1 << full) - 1
    ascending = F.aggregate(F.transform(F.slice(x, 1, F.size(x) - 1), lambda v: bit_width(top - v)), F.lit(full), lambda a, b: a + b)
    descending = F.aggregate(F.transform(F.slice(x, 2, F.size(x)), bit_width), F.lit(full), lambda a, b: a + b)
    order = F.when((F.size(x) == 1) | (ascending < descending), "asc").otherwise("desc")
    return F.struct(order.alias("order"), F.when(order == "asc", ascending).otherwise(descending).alias("bits"))


def decayed(signal: DataFrame, decay: float = 0.98, start: float = 0.006, reach: int = 2047, size: int = 512) -> DataFrame:
    """Exponential mean of x over i: L = decay * L + (1 - decay) * x, from ``start``.

    A block scan: within a block of ``size`` samples the mean from zero is one running sum of
    samples that are weighted up by decay^-k, from block to block only its last value
    travels. After ``reach`` steps the weight decay^reach is below double precision, so a
    block needs the last values of a few blocks before it, and no scan of the track.
    """
    if decay**-size > 1e9:
        raise ValueError("the block is too long for this decay")
    keys = ["track", "ch", "block"]
    rows = signal.withColumn("block", F.floor(F.col("i") / size)).withColumn("k", F.col("i") - F.col("block") * size)
    weight = (1 - decay) * F.pow(F.lit(decay), -F.col("k"))
    local = F.sum(F.col("x") * weight).over(Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    last = rows.groupBy(*keys).agg((F.sum(F.col("x") * weight) * decay ** (size - 1)).alias("x")).withColumnRenamed("block", "i")
    back = -(-reach // size)

    def carried(w: Window) -> dict[str, Column]:
        return {"carry": sum((F.lag("x", m, 0.0).over(w) * decay ** (size * (m - 1)) for m in range(1, back + 1)), F.lit(0.0))}

    before = over_track(last, back, 0, carried).select("track", "ch", F.col("i").alias("block"), "carry")
    early = F.when(F.col("i") < reach, F.lit(start) * F.pow(F.lit(decay), F.col("i") + 1)).otherwise(0.0)
    level = F.col("local") * F.pow(F.lit(decay), F.col("k")) + F.col("carry") * F.pow(F.lit(decay), F.col("k") + 1) + early
    return rows.withColumn("local", local).join(before, keys).withColumn("level", level).drop("block", "k", "local", "carry")


def as_of(x: Column, grid_x: list[float], grid_y: list[float]) -> Column:
    """Value of a piecewise linear function at x, constant beyond its ends.

    The grid is a literal (some hundred points); the interval is found by counting the points
    that are not above x.
    """
    gx, gy = F.lit(grid_x), F.lit(grid_y)
    k = F.least(F.greatest(F.size(F.filter(gx, lambda g: g <= x)) - 1, F.lit(0)), F.lit(len(grid_x) - 2))
    x0, x1, y0, y1 = F.get(gx, k), F.get(gx, k + 1), F.get(gy, k), F.get(gy, k + 1)
    t = F.least(F.greatest((x - x0) / (x1 - x0), F.lit(0.0)), F.lit(1.0))
    return y0 + t * (y1 - y0)


def tone_index(frequency: Column, band: Column) -> Column:
    """10-bit index of an angular frequency (0..pi) in a band: band * 1024 + index."""
    return F.rint(1024 * frequency / math.pi).cast("int").bitwiseAND(1023).bitwiseOR(F.shiftleft(band, 10))


def phase_index(phase: Column) -> Column:
    """5-bit index of a phase."""
    return F.rint(32 * phase / (2 * math.pi)).cast("int").bitwiseAND(31)

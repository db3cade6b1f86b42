"""Code lengths, unit counts, gates and options of the second and third codec, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions import tables as T


def signed_symbol(m: Column) -> Column:
    """Symbol of a quantised value in the variable-length codes: 0, 1, -1, 2, -2, ... as 0, 1, 2, 3, 4, ..."""
    return F.when(m > 0, 2 * m - 1).otherwise(-2 * m).cast("int")


def spectrum_bits(values: Column, selector: int) -> tuple[Column, Column]:
    """(fixed, variable) bits of a unit's quantised values; selector 1 codes pairs, so it wants an even count."""
    lengths = F.lit(T.C2_CODE_LENGTHS[selector])
    total = lambda costs: F.aggregate(costs, F.lit(0), lambda a, b: a + b)
    if selector == 1:
        pairs = F.transform(F.sequence(F.lit(0), (F.size(values) / 2).cast("int") - 1), lambda k: F.get(F.lit(T.C2_PAIR_INDEX), (3 * (F.get(values, 2 * k) + 1) + F.get(values, 2 * k + 1) + 1).cast("int")))
        return (F.lit(T.C2_CLC_BITS[1]) * (F.size(values) / 2).cast("int")), total(F.transform(pairs, lambda s: F.get(lengths, s)))
    return F.lit(T.C2_CLC_BITS[selector]) * F.size(values), total(F.transform(values, lambda v: F.get(lengths, signed_symbol(v))))


def canonical(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the canonical prefix code of (keys, rank, length), ranks in the order of the codes.

    A code is the sum of the shares 2^-length of all codes before it, as a number of its
    own length.
    """
    w = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)  # a code table
    before = F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("length"))).over(w), F.lit(0.0))
    return symbols.withColumn("code", (before * F.pow(F.lit(2.0), F.col("length"))).cast("int"))


def delta_words(lengths: Column, other: Column | None = None) -> Column:
    """Word lengths as differences modulo 8: from the one before (the first as it is), or from another channel's."""
    if other is not None:
        return F.zip_with(lengths, other, lambda a, b: (a - b).bitwiseAND(7))
    return F.transform(lengths, lambda v, i: F.when(i == 0, v).otherwise(v - F.get(lengths, F.greatest(i - 1, F.lit(0)))).bitwiseAND(7))


def best_delta_table(deltas: Column, first: int, last: int) -> Column:
    """(table, bits) of the cheapest of the word-length code tables ``first`` to ``last`` for all deltas but the first; the first of equals.

    A difference without a code in a table has length 0 there, as in the format's tables.
    """
    rest = F.slice(deltas, 2, F.greatest(F.size(deltas) - 1, F.lit(0)))
    cost = lambda k: F.aggregate(F.transform(rest, lambda d: F.get(F.lit(T.C3_WORD_LENGTHS[k]), d)), F.lit(0), lambda a, b: a + b)
    costs = [F.struct(cost(k).alias("bits"), F.lit(k).alias("table")) for k in range(first, last + 1)]
    return F.array_min(F.array(*costs)) if len(costs) > 1 else costs[0]


def initial_units(bits: Column, fixed: Column) -> Column:
    """Units that a frame of codec 2 starts with: ``fixed`` (0: 32), fewer where the header alone would fill the frame."""
    most = F.when(fixed == 0, 32).otherwise(fixed)
    header = F.when(bits > 5, F.floor((bits - 5) / 3)).otherwise(1)
    return F.greatest(F.lit(1), F.when(bits < 101, F.least(most, F.greatest(F.lit(1), header))).otherwise(most)).cast("int")


def trimmed_units(bits: Column) -> Column:
    """Units up to the last one that has bits, 1 at least."""
    return F.greatest(F.lit(1), F.coalesce(F.array_max(F.transform(bits, lambda b, i: F.when(b > 0, i + 1))), F.lit(0)))


def boosted(bits: Column, error: Column, end: int = 10) -> Column:
    """One more bit, up to 7, for units below ``end`` whose energy error is off: between 0 and 0.7, or above 1.2."""
    off = lambda e: ((e > 0) & (e < 0.7)) | (e > 1.2)
    return F.transform(F.arrays_zip(bits.alias("b"), error.alias("e")), lambda u, i: F.when((i < end) & off(u["e"]) & (u["b"] < 7), u["b"] + 1).otherwise(u["b"]))


#: Counts of quantisation units that the third codec tries, in its order.
UNIT_STEPS = [32, *range(28, 0, -1)]


def units_that_fit(costs: Column, budget: Column) -> Column:
    """The largest of the tried unit counts whose costs, one a unit, stay within the budget; 1 where none does."""
    cost = lambda n: F.aggregate(F.slice(costs, 1, n), F.lit(0.0), lambda a, b: a + b)
    return F.coalesce(F.get(F.filter(F.lit(UNIT_STEPS), lambda n: cost(n) <= budget), 0), F.lit(1))


def is_tonal(flatness: Column, unit: Column, most: float = 0.01) -> Column:
    """Whether a unit's lines are coded as tones: units 8 to 28 that are far from flat."""
    return (flatness < most) & unit.between(8, 28)


def audible(energy: Column, threshold: Column, loudness: Column) -> Column:
    """Whether a unit reaches the hearing threshold at the signal's loudness; others get no bits."""
    return energy >= threshold * loudness


def gain_gate(high_share: Column, level: Column, band: Column) -> Column:
    """What becomes of a band's gain curve: ``skip``, ``no points`` or ``keep``.

    A band whose share of high frequencies is below 0.05 is skipped. Points are dropped
    where the level is below 1e-4, the share below 0.3, or in the fourth band.
    """
    return F.when(high_share < 0.05, "skip").when((level < 1e-4) | (high_share < 0.3) | (band >= 3), "no points").otherwise("keep")


def gain_divisors(points: Column, n: int) -> Column:
    """Divisors of ``n`` samples for points (level, loc): a level holds up to 8 * loc, then glides in 8 samples to the next one, at last to neutral (4)."""
    def at(i: Column) -> Column:
        begun = F.filter(points, lambda p: p["loc"] * 8 <= i)
        k = F.size(begun)
        level = lambda j: F.coalesce(F.get(points, j)["level"], F.lit(4))
        here = F.get(points, k - 1)
        inside = (k > 0) & (i < here["loc"] * 8 + 8)
        glide = F.pow(F.lit(2.0), 4 - here["level"] - (level(k) - here["level"]) * (i - here["loc"] * 8) / 8.0)
        return F.when(inside, glide).otherwise(F.pow(F.lit(2.0), 4 - level(k)))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def gain_modulated(current: Column, following: Column, points: Column, n: int) -> Column:
    """(current, following) divided: the first by the first level, the second sample by sample; as they are without points."""
    first = F.pow(F.lit(2.0), 4 - F.coalesce(F.get(points, 0)["level"], F.lit(4)))
    return F.struct(F.transform(current, lambda v: v / first).alias("current"), F.zip_with(following, gain_divisors(points, n), lambda v, d: v / d).alias("following"))


def gain_demodulated(current: Column, before: Column, now: Column, later: Column, n: int) -> Column:
    """The overlap of two decoded halves with both gains undone: ``later`` begins in the next frame and scales this half."""
    first = F.pow(F.lit(2.0), 4 - F.coalesce(F.get(later, 0)["level"], F.lit(4)))
    return F.zip_with(F.zip_with(current, before, lambda a, b: a * first + b), gain_divisors(now, n), lambda v, d: v * d)


def byte_count(bits: Column) -> Column:
    """Whole bytes that hold so many bits; 0 bits wrap around as an unsigned 32-bit number does."""
    return F.when(bits == 0, F.lit((((0 - 1) & 0xFFFFFFFF) // 8) + 1)).otherwise(F.ceil(bits / 8)).cast("long")


def endian_swapped(value: Column, size: int) -> Column:
    """An unsigned number of 2 or 4 bytes with its bytes in reverse order."""
    byte = lambda k: F.shiftrightunsigned(value.cast("long"), 8 * k).bitwiseAND(255)
    return sum((F.shiftleft(byte(k), 8 * (size - 1 - k)) for k in range(1, size)), F.shiftleft(byte(0), 8 * (size - 1)))


def advanced_options(text: Column) -> Column:
    """(ghadbg, ghawbrefine, error) of ``key=value,key=value``; an empty value leaves its key unset, null text sets nothing."""
    items = F.split(text, ",", -1)
    key = lambda x: F.regexp_extract(x, "^([^=]*)=", 1)
    given = lambda k: F.filter(items, lambda x: F.startswith(x, F.lit(k + "=")) & (F.length(x) > len(k) + 1))
    number = lambda k: F.regexp_extract(F.try_element_at(given(k), F.lit(-1)), r"=\s*([+-]?\d+)", 1).try_cast("int")
    no_value = F.exists(items, lambda x: ~F.contains(x, F.lit("=")))
    unknown = F.exists(items, lambda x: ~key(x).isin("ghadbg", "ghawbrefine"))
    twice = F.exists(items, lambda x: F.length(x) - F.length(F.replace(x, F.lit("="), F.lit(""))) > 1)
    mask, refine = number("ghadbg"), number("ghawbrefine")
    wrong = (mask < 0) | (mask > 15) | (refine < 0) | (refine > 1)
    error = F.when(no_value, "no value").when(unknown, "unknown key").when(twice, "two equals signs").when(F.coalesce(wrong, F.lit(False)), "out of range")
    return F.struct(mask.alias("ghadbg"), refine.alias("ghawbrefine"), error.alias("error"))


def chosen_container(codec: Column, extension: Column, named: Column) -> Column:
    """(container, legal): the named one, else by the lower-case extension of the output file."""
    by_name = F.when(F.lower(extension).isin("raw", "dat"), "raw").when(codec == "c1", "aea").when(F.lower(extension).isin("wav", "at3"), "riff").when(F.lower(extension) == "rm", "rm").otherwise("oma")
    kind = F.coalesce(F.lower(named), by_name)
    legal = F.when(codec == "c1", kind.isin("aea", "raw")).when(codec == "c2", kind.isin("oma", "riff", "rm", "raw")).when(codec == "c3", kind.isin("oma", "riff", "raw")).otherwise(False)
    return F.struct(kind.alias("container"), legal.alias("legal"))


def frequency_response(taps: list[float], size: int, spark) -> DataFrame:
    """(k, power): squared magnitude of the taps' Fourier transform at ``size`` points up to half the rate."""
    tap = spark.range(1).select(F.posexplode(F.lit([float(t) / 2 for t in taps])).alias("j", "t"))
    angle = F.col("k") * F.col("j") * (-math.pi / size)
    sums = spark.range(size).select(F.col("id").alias("k")).crossJoin(F.broadcast(tap)).groupBy("k").agg(F.sum(F.col("t") * F.cos(angle)).alias("a"), F.sum(F.col("t") * F.sin(angle)).alias("b"))
    return sums.select("k", (F.col("a") * F.col("a") + F.col("b") * F.col("b")).alias("power"))

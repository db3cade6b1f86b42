"""The first point of a gain curve: divisors by subframe, how well a curve fits, and the guard of an inserted point."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright.operators import sequence as Q

SUBFRAMES, NEUTRAL, TINY = 32, 4, 1e-9
POINTS = "array<struct<level:int,loc:int>>"


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def _gain(level: Column) -> Column:
    return F.pow(F.lit(2.0), NEUTRAL - level)


def mean_divisors(points: Column) -> Column:
    """Mean divisor of each of 32 subframes of 8 samples for points (level, loc) in the order of loc.

    A glide takes exactly the subframe that its point names; all others are constant.
    """
    level = lambda k: F.coalesce(F.get(points, k)["level"], F.lit(NEUTRAL))

    def at(s: Column) -> Column:
        k = F.size(F.filter(points, lambda p: p["loc"] <= s))
        here = F.get(points, k - 1)
        glide = _sum(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: _gain(here["level"] + (level(k) - here["level"]) * j / 8.0))) / 8
        return F.when((k > 0) & (here["loc"] == s), glide).otherwise(_gain(level(k)))

    return F.transform(F.sequence(F.lit(0), F.lit(SUBFRAMES - 1)), at)


def early_mismatch(profile: Column, target: Column, points: Column) -> Column:
    """Mean squared octaves between the divided profile and the target, up to two subframes after the last glide, and a quarter of the squared steps of the divisors, weighted by the profile.

    0 where there is no target.
    """
    octaves = lambda v: F.log2(F.greatest(v, F.lit(TINY)))
    n = F.least(F.lit(SUBFRAMES), F.greatest(F.lit(3), F.coalesce(F.array_max(F.transform(points, lambda p: p["loc"])), F.lit(0)) + 3))

    def score(rows: Column) -> Column:
        fit = _sum(F.transform(rows, lambda r: F.pow(octaves(r["g"] / F.greatest(r["d"], F.lit(TINY))) - octaves(target), 2))) / F.size(rows)
        pairs = F.zip_with(F.slice(rows, 1, F.size(rows) - 1), F.slice(rows, 2, F.size(rows) - 1), lambda a, b: F.struct(((a["g"] + b["g"]) / 2).alias("w"), F.pow(octaves(b["d"]) - octaves(a["d"]), 2).alias("s")))
        weight, steps = _sum(F.transform(pairs, lambda p: p["w"])), _sum(F.transform(pairs, lambda p: p["w"] * p["s"]))
        return fit + 0.25 * F.when(weight > TINY, steps / weight).otherwise(steps)

    rows = F.slice(F.zip_with(profile, mean_divisors(points), lambda g, d: F.struct(g.alias("g"), d.alias("d"))), 1, n)
    return F.when(target <= TINY, F.lit(0.0)).otherwise(Q.let(rows, score))


def start_level(profile: Column, points: Column) -> Column:
    """Mean of the profile before the first glide, divided as the curve does it; null where the curve glides at once."""
    first = F.get(points, 0)
    n = F.when(F.size(points) == 0, F.size(profile)).otherwise(first["loc"])
    return F.when(n > 0, _sum(F.slice(profile, 1, n)) / n / _gain(F.coalesce(first["level"], F.lit(NEUTRAL))))


def with_first_point(profile: Column, last_target: Column, target: Column, points: Column, band: Column, slack: float = 0.02, margin: float = 0.2) -> Column:
    """A curve with a point at 0 that takes up the level of the frame before, and the numbers that decided on it.

    (start, level, score_before, score_after, step_before, step_after, verdict, points). The
    verdict is ``none`` (no point is due), ``kept`` or ``reverted``: the fit may get worse by
    ``slack``, or more if the step at the frame's border shrinks by ``margin`` octaves. A first
    point with the level of the second is dropped. The fourth band gets no point.
    """
    points = points.cast(POINTS)

    def decide(s: Column) -> Column:
        ratio = last_target / s
        level = Q.level_index(ratio)
        due = (band < 3) & (last_target > 1e-6) & (s > 1e-6) & ((level != NEUTRAL) | (F.size(points) > 0))
        longer = F.concat(F.array(F.struct(level.alias("level"), F.lit(0).alias("loc"))), points)
        wanted = F.log2(F.least(F.greatest(ratio, F.lit(2.0**-11)), F.lit(16.0)))
        step = lambda v: F.abs(NEUTRAL - v - wanted)
        held = F.coalesce(F.get(points, 0)["level"], F.lit(NEUTRAL))
        numbers = F.struct(early_mismatch(profile, target, points).alias("before"), early_mismatch(profile, target, longer).alias("after"), step(held).alias("old"), step(level).alias("new"))

        def verdict(z: Column) -> Column:
            keep = (z["new"] + margin < z["old"]) | (z["after"] <= z["before"] * (1 + slack))
            kept = F.when(~F.coalesce(due, F.lit(False)), "none").when(keep, "kept").otherwise("reverted")
            out = F.when(F.coalesce(due, F.lit(False)) & keep, longer).otherwise(points)
            idle = (F.size(out) >= 2) & (F.get(out, 0)["loc"] == 0) & (F.get(out, 0)["level"] == F.get(out, 1)["level"])
            shown = lambda c: F.when(F.coalesce(due, F.lit(False)), c)
            return F.struct(
                s.alias("start"), shown(level).alias("level"), shown(z["before"]).alias("score_before"), shown(z["after"]).alias("score_after"), shown(z["old"]).alias("step_before"),
                shown(z["new"]).alias("step_after"), kept.alias("verdict"), F.when(idle, F.slice(out, 2, F.greatest(F.size(out) - 1, F.lit(1)))).otherwise(out).alias("points"),
            )

        return Q.let(numbers, verdict)

    return Q.let(start_level(profile, points), decide)

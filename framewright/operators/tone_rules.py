"""Which sinusoids are kept, how they are projected, grouped and taken out of a signal; as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators.tones import generate

SPACING, BY_BAND, IN_ALL = 20, 15, 48


def accepted(candidates: Column) -> Column:
    """Those of the candidates (ch, sb, idx) of a frame, in the order of their discovery, that become tones.

    A band takes 15 tones at most, each 20 indices or more away from all others of its
    channel, but for its first; a candidate that is turned down closes its band in its
    channel. A frame takes 48 in both channels.
    """
    kind = "struct<kept:array<struct<ch:int,sb:int,idx:int>>,closed:array<int>>"

    def step(acc: Column, c: Column) -> Column:
        name = c["ch"] * 64 + c["sb"]
        own = F.size(F.filter(acc["kept"], lambda k: (k["ch"] == c["ch"]) & (k["sb"] == c["sb"])))
        near = F.exists(acc["kept"], lambda k: (k["ch"] == c["ch"]) & (F.abs(k["idx"] - c["idx"]) < SPACING))
        heard = (F.size(acc["kept"]) < IN_ALL) & ~F.array_contains(acc["closed"], name)
        good = (own == 0) | (~near & (own < BY_BAND))
        tone = F.struct(c["ch"].cast("int").alias("ch"), c["sb"].cast("int").alias("sb"), c["idx"].cast("int").alias("idx"))
        return F.struct(
            F.when(heard & good, F.concat(acc["kept"], F.array(tone))).otherwise(acc["kept"]).alias("kept"),
            F.when(heard & ~good, F.concat(acc["closed"], F.array(name.cast("int")))).otherwise(acc["closed"]).alias("closed"),
        )

    return F.aggregate(candidates, F.struct(F.array().alias("kept"), F.array().alias("closed")).cast(kind), step, lambda acc: acc["kept"])


def amplitude(scale: Column) -> Column:
    return F.pow(F.lit(2.0), (scale - 3) / 4)


def wave(tones: Column, n: int, begin: int = 0) -> Column:
    """``n`` samples, from sample ``begin`` on, of the sum of tones (idx, scale, phase)."""
    silence = F.array_repeat(F.lit(0.0), n)
    one = lambda t: generate(amplitude(t["scale"]), F.shiftleft(t["phase"], 6) + t["idx"] * begin, t["idx"], n)
    return F.aggregate(tones, silence, lambda acc, t: F.zip_with(acc, one(t), lambda a, b: a + b))


def without_tones(x: Column, before: Column, now: Column, n: int) -> Column:
    """``n`` samples less their tones: a Hann slope leads from the tones of the frame before, which go on, to this frame's."""
    slope = lambda i: 0.5 - 0.5 * F.cos(F.pi() * (i + 0.5) / n)
    faded = F.zip_with(F.transform(wave(before, n, n), lambda v, i: v * (1 - slope(i))), F.transform(wave(now, n), lambda v, i: v * slope(i)), lambda a, b: a + b)
    return F.zip_with(x, faded, lambda a, b: a - b)


def filtered(bands: DataFrame, tones: DataFrame, n: int) -> DataFrame:
    """(track, ch, frame, sb, x) of subband frames of ``n`` samples less the tones (track, ch, frame, sb, idx, scale, phase) of their subband; bands without tones are as they were.

    A frame's tones also fade out in the next frame, so both uses are one exchange of the
    tones; 48 tones a frame at most bound the lists.
    """
    by = ["track", "ch", "sb", "frame"]
    tone = F.struct("idx", "scale", "phase")
    used = tones.withColumn("late", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("frame", F.col("frame") + F.col("late"))
    lists = used.groupBy(*by).agg(*(F.array_sort(F.collect_list(F.when(F.col("late") == k, tone))).alias(name) for k, name in ((0, "now"), (1, "before"))))
    none = F.array().cast("array<struct<idx:int,scale:int,phase:int>>")
    rows = bands.join(lists, by, "left").withColumns({k: F.coalesce(k, none) for k in ("now", "before")})
    touched = (F.size("now") > 0) | (F.size("before") > 0)
    return rows.select(*by, F.when(touched, without_tones(F.col("x"), F.col("before"), F.col("now"), n)).otherwise(F.col("x")).alias("x"))


def goes_on(following: Column, tones: Column, n: int) -> Column:
    """Whether the tones, begun anew, take energy out of the next frame's first ``n`` samples."""
    squares = lambda v: F.aggregate(v, F.lit(0.0), lambda a, b: a + b * b)
    return squares(F.zip_with(following, wave(tones, n), lambda a, b: a - b)) < squares(following)


def projected(sb: Column, phase: Column, magnitude: Column, response: Column) -> Column:
    """A wideband tone as a tone of a subband with response (frequency, phase, magnitude); odd subbands run backwards."""
    turned = F.when(F.pmod(sb, F.lit(2)) == 0, phase).otherwise(-phase) + response["phase"]
    return F.struct(response["frequency"].alias("frequency"), turned.alias("phase"), (magnitude * response["magnitude"]).alias("magnitude"))


def refit_holds(refined: Column, first: Column, error: Column, first_error: Column, drift: int = 40, ratio: float = 4.0) -> Column:
    """Whether refitted tones (idx, magnitude) replace the first ones, both in the order of idx.

    Not if two share an index, one drifts by more than ``drift`` indices or changes its
    magnitude by more than ``ratio``, or the squared error does not fall.
    """
    indices = F.transform(refined, lambda t: t["idx"])
    apart = F.size(F.array_distinct(indices)) == F.size(refined)
    m, o = (lambda p: p["a"]["magnitude"]), (lambda p: p["b"]["magnitude"])
    fits = lambda p: (F.abs(p["a"]["idx"] - p["b"]["idx"]) <= drift) & (m(p) > 0) & (o(p) > 0) & ~F.isnan(m(p)) & (m(p) <= o(p) * ratio) & (o(p) <= m(p) * ratio)
    pairs = F.zip_with(refined, first, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return apart & F.coalesce(F.forall(pairs, fits), F.lit(False)) & (error < first_error)


def tonal_groups(tones: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, quant, length, positions, starts) of tones (keys, bits, length, pos): by quantiser and length, and where their sub-groups begin.

    The quantiser is the unit's bits and 4 more, 2 to 7. A sub-group ends where seven more
    tones lie in the window of 64 lines of its anchor; a tone beyond the window becomes
    the anchor, without an end.
    """
    quant = F.greatest(F.lit(2), F.least(F.lit(7), F.col("bits") + 4)).cast("int")
    kind = "struct<starts:array<int>,anchor:int,run:int>"

    def step(acc: Column, pos: Column, k: Column) -> Column:
        close = pos - (acc["anchor"] - F.pmod(acc["anchor"], F.lit(64))) < 64
        run = F.when(close, acc["run"] + 1).otherwise(0)
        begins = (k == 0) | (run == 7)
        return F.struct(
            F.when(begins, F.concat(acc["starts"], F.array(k))).otherwise(acc["starts"]).alias("starts"),
            F.when(begins | ~close, pos).otherwise(acc["anchor"]).alias("anchor"),
            F.when(begins, 0).otherwise(run).alias("run"),
        )

    indexed = F.transform("positions", lambda p, k: F.struct(p.cast("int").alias("p"), k.alias("k")))
    starts = F.aggregate(indexed, F.struct(F.array().alias("starts"), F.lit(0).alias("anchor"), F.lit(0).alias("run")).cast(kind), lambda acc, r: step(acc, r["p"], r["k"]), lambda acc: acc["starts"])
    grouped = tones.groupBy(*keys, quant.alias("quant"), "length").agg(F.array_sort(F.collect_list("pos")).alias("positions"))  # a frame's tones, 64 at most
    return grouped.withColumn("starts", starts)


def scale_bits(indices: Column) -> Column:
    """The bits of a unit's scale indices, six each, behind the two that say so."""
    return F.concat(F.lit("00"), F.array_join(F.transform(indices, lambda v: F.lpad(F.bin(v), 6, "0")), ""))


def spectral_symbols(values: Column, per_symbol: int, bits: int, signed: bool) -> Column:
    """(symbol, signs) of quantised values, ``per_symbol`` at a time, ``bits`` each, the first lowest.

    Unsigned symbols hold magnitudes; their signs follow as a bit for each value that is not 0 (1: negative).
    """
    part = lambda k: F.slice(values, k * per_symbol + 1, per_symbol)
    field = lambda v: v.bitwiseAND((1 << bits) - 1) if signed else F.abs(v)
    place = lambda v, i: field(v) * F.element_at(F.lit([1 << bits * j for j in range(per_symbol)]), i + 1)
    symbol = lambda p: F.aggregate(F.transform(p, place), F.lit(0), lambda a, b: a + b)
    signs = lambda p: F.lit("") if signed else F.array_join(F.transform(F.filter(p, lambda v: v != 0), lambda v: F.when(v < 0, "1").otherwise("0")), "")
    count = F.floor((F.size(values) + per_symbol - 1) / per_symbol).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda k: F.struct(symbol(part(k)).alias("symbol"), signs(part(k)).alias("signs")))


def all_word_lengths(x: Column, mantissas: list[float]) -> Column:
    """Lines in [-1, 1] at each word length from 1 on, once for all coders that compare them."""
    at = lambda m: F.transform(x, lambda v: F.rint(v * m).cast("int"))
    return F.array(*(at(m) for m in mantissas))

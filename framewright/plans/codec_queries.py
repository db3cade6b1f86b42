"""Registered queries of the second and third codec's operators and of small helpers, each with DuckDB SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import tables as T
from framewright.operators import framing as P
from framewright.operators import lapped, packing
from framewright.operators import sequence as Q
from framewright.operators import stats as A
from framewright.operators import transforms as L
from framewright.plans import signals as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
E, V, LINES = S.EVENTS_SQL, S.VECTORS_SQL, S.LINES_SQL


def query(sql: str) -> Callable:
    """Registers a query and its SQL under its function's name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _ints(numbers: list) -> str:
    return "[" + ", ".join(map(str, numbers)) + "]"


def _doubles(numbers: list) -> str:
    return "[" + ", ".join(f"{x!r}::DOUBLE" for x in map(float, numbers)) + "]"


# --- Lapped transforms ---


def bands(spark: SparkSession, sf_dir: str, count: int, size: int) -> DataFrame:
    """Events dealt to ``count`` bands as frames of ``size`` samples; a short last frame is filled with zeros."""
    return P.frames(P.deinterleave(S.events(spark, sf_dir), count), size)


def _bands_sql(count: int, size: int) -> str:
    """The same, one row a sample of a frame: ch, frame, p, x."""
    return f"""SELECT g.ch, g.frame, p, coalesce(x, 0) AS x
        FROM (SELECT DISTINCT i % {count} AS ch, i // {count} // {size} AS frame FROM ({E})) g CROSS JOIN range(0, {size}) AS r(p)
        LEFT JOIN (SELECT i % {count} AS ch, i // {count} // {size} AS frame, i // {count} % {size} AS q, x FROM ({E})) e ON e.ch = g.ch AND e.frame = g.frame AND e.q = p"""


def _lapped_sql(count: int, size: int, held: str, own: str) -> str:
    """Sums of a frame's and its predecessor's samples (window expressions in p) with the transform's cosines."""
    return f"""WITH b AS ({_bands_sql(count, size)}), u AS (
          SELECT ch, frame, p + {size} AS t, x * {own} AS v FROM b
          UNION ALL SELECT b.ch, b.frame + 1, p, x * {held} FROM b JOIN (SELECT DISTINCT ch, frame FROM b) n ON n.ch = b.ch AND n.frame = b.frame + 1)
        SELECT CAST(ch AS INT) AS ch, frame, CAST(CASE WHEN ch % 2 = 1 THEN {size - 1} - k ELSE k END AS INT) AS k, round(sum(v * cos(pi() / {size} * (t + 0.5 + {size} / 2.0) * (k + 0.5))), 5) + 0.0 AS c
        FROM u, range(0, {size}) AS r(k) GROUP BY ch, frame, k"""


def _lines(rows: DataFrame) -> DataFrame:
    return rows.select("ch", "frame", F.posexplode("c").alias("k", "c")).withColumn("c", F.round("c", 5) + 0.0)


_SIN256 = "(sin(((p + 0.5) / 256 - 0.5) * pi()) + 1)"


@query(_lapped_sql(4, 256, _SIN256, _SIN256.replace("p +", "255 - p +")))
def second_codec_transform(spark, sf_dir):
    return _lines(lapped.second_codec(bands(spark, sf_dir, 4, 256)))


@query(f"SELECT CAST(ch AS INT) AS ch, frame, max(abs(x)) AS peak FROM ({_bands_sql(4, 256)}) GROUP BY ch, frame")
def second_codec_peaks(spark, sf_dir):
    return lapped.second_codec(bands(spark, sf_dir, 4, 256)).select("ch", "frame", "peak")


def _unlapped(rows: DataFrame) -> DataFrame:
    return rows.select("ch", "frame", F.posexplode("x").alias("p", "x")).withColumn("x", F.round("x", 5) + 0.0)


def _back_sql(count: int, size: int) -> str:
    """What perfect reconstruction gives: the samples of the frame before."""
    return f"WITH b AS ({_bands_sql(count, size)}) SELECT CAST(b.ch AS INT) AS ch, b.frame + 1 AS frame, CAST(p AS INT) AS p, round(x, 5) + 0.0 AS x FROM b JOIN (SELECT DISTINCT ch, frame FROM b) n ON n.ch = b.ch AND n.frame = b.frame + 1"


@query(_back_sql(4, 256))
def second_codec_inverse(spark, sf_dir):
    """Transform and inverse; the SQL is the signal itself."""
    return _unlapped(lapped.second_codec_inverse(lapped.second_codec(bands(spark, sf_dir, 4, 256))))


_STEEP = "CASE WHEN b.frame % 3 = 1 THEN CASE WHEN {q} < 32 THEN 0 WHEN {q} < 96 THEN 2 * sin(({q} - 32 + 0.5) * pi() / 128) ELSE 2 END ELSE 2 * sin(({q} + 0.5) * pi() / 256) END"


def _sixteen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands(spark, sf_dir, 16, 128).withColumn("steep", F.col("frame") % 3 == 1)


@query(_lapped_sql(16, 128, f"({_STEEP.format(q='p')})", f"({_STEEP.format(q='(127 - p)')})"))
def third_codec_transform(spark, sf_dir):
    return _lines(lapped.third_codec(_sixteen(spark, sf_dir)))


@query(_back_sql(16, 128))
def third_codec_inverse(spark, sf_dir):
    """Transform and inverse with changing windows; the SQL is the signal itself."""
    return _unlapped(lapped.third_codec_inverse(lapped.third_codec(_sixteen(spark, sf_dir))))


def _mdct_frames_sql(n: int) -> str:
    return f"""WITH b AS ({_bands_sql(1, n)}) SELECT frame, CAST(k AS INT) AS k, round(sum(x * cos(2 * pi() / {n} * (p + 0.5 + {n} / 4.0) * (k + 0.5))), 5) + 0.0 AS c FROM b, range(0, {n // 2}) AS r(k) GROUP BY 1, 2"""


def _mdct_frames(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return _lines(bands(spark, sf_dir, 1, n).withColumn("c", L.mdct(F.col("x"), n))).drop("ch")


@query(_mdct_frames_sql(256))
def mdct256(spark, sf_dir):
    return _mdct_frames(spark, sf_dir, 256)


@query(_mdct_frames_sql(512))
def mdct512(spark, sf_dir):
    return _mdct_frames(spark, sf_dir, 512)


@query(f"""WITH l AS (SELECT vec_id, line // 2 AS t, sum(CASE WHEN line % 2 = 0 THEN c END) AS re, sum(CASE WHEN line % 2 = 1 THEN c END) AS im FROM ({LINES}) GROUP BY 1, 2)
    SELECT vec_id, CAST(k AS INT) AS k, round(sum(re * cos(2 * pi() * k * t / 32) + im * sin(2 * pi() * k * t / 32)), 6) + 0.0 AS re, round(sum(im * cos(2 * pi() * k * t / 32) - re * sin(2 * pi() * k * t / 32)), 6) + 0.0 AS im
    FROM l, range(0, 32) AS r(k) GROUP BY 1, 2""")
def complex_fourier(spark, sf_dir):
    y = S.vectors(spark, sf_dir).select("vec_id", L.complex_fourier(F.col("x")).alias("y"))
    rows = y.select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.struct(F.get("y", 2 * k).alias("re"), F.get("y", 2 * k + 1).alias("im")))).alias("k", "z"))
    return rows.select("vec_id", "k", *((F.round(f"z.{c}", 6) + 0.0).alias(c) for c in ("re", "im")))


@query(f"""WITH l AS (SELECT vec_id, line // 2 AS k, sum(CASE WHEN line % 2 = 0 THEN c END) AS re, sum(CASE WHEN line % 2 = 1 THEN c END) AS im FROM ({LINES}) GROUP BY 1, 2)
    SELECT vec_id, CAST(t AS INT) AS t, round(sum(CASE WHEN k = 0 THEN re WHEN k = 31 THEN re * cos(pi() * t) ELSE 2 * (re * cos(2 * pi() * k * t / 62) - im * sin(2 * pi() * k * t / 62)) END) / 62, 6) + 0.0 AS x
    FROM l, range(0, 62) AS r(t) GROUP BY 1, 2""")
def inverse_real_fourier(spark, sf_dir):
    y = S.vectors(spark, sf_dir).select("vec_id", F.posexplode(L.inverse_real_fourier(F.col("x"))).alias("t", "x"))
    return y.withColumn("x", F.round("x", 6) + 0.0)


@query(f"""SELECT k, round(a * a + b * b, 9) AS power FROM (SELECT k, sum(t * cos(pi() * k * j / 256)) AS a, sum(t * sin(pi() * k * j / 256)) AS b
    FROM (SELECT unnest({_doubles([t / 2 for t in T.QMF_TAPS])}) AS t, unnest(range(0, 48)) AS j), range(0, 256) AS r(k) GROUP BY k)""")
def qmf_response(spark, sf_dir):
    return packing.frequency_response(T.QMF_TAPS, 256, spark).withColumn("power", F.round("power", 9))


# --- Gain control ---

_LEVELS = "CAST(label % 16 AS INT) AS a, CAST(vec_id % 16 AS INT) AS b, CAST(vec_id % 3 AS INT) AS la, CAST(4 + vec_id % 3 AS INT) AS lb"
_GAIN = """CASE WHEN i < la * 8 THEN pow(2.0, 4 - a) WHEN i < la * 8 + 8 THEN pow(2.0, 4 - a - (b - a) * (i - la * 8) / 8.0)
    WHEN i < lb * 8 THEN pow(2.0, 4 - b) WHEN i < lb * 8 + 8 THEN pow(2.0, 4 - b - (4 - b) * (i - lb * 8) / 8.0) ELSE 1 END"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = lambda level, loc: F.struct((level % 16).cast("int").alias("level"), loc.cast("int").alias("loc"))
    return S.vectors(spark, sf_dir).withColumn("points", F.array(point(F.col("label"), F.col("vec_id") % 3), point(F.col("vec_id"), 4 + F.col("vec_id") % 3)))


@query(f"""WITH l AS (SELECT vec_id, line AS i, c, {_LEVELS} FROM ({LINES}))
    SELECT vec_id, CAST(i AS INT) AS i, round(c / pow(2.0, 4 - a), 7) + 0.0 AS current, round(c / ({_GAIN}), 7) + 0.0 AS following FROM l""")
def gain_modulation(spark, sf_dir):
    rows = _points(spark, sf_dir).withColumn("g", packing.gain_modulated(F.col("x"), F.col("x"), F.col("points"), 64))
    rows = rows.select("vec_id", F.posexplode(F.arrays_zip("g.current", "g.following")).alias("i", "z"))
    return rows.select("vec_id", "i", *((F.round(f"z.{c}", 7) + 0.0).alias(c) for c in ("current", "following")))


@query(f"SELECT vec_id, CAST(line AS INT) AS i, round(c, 7) + 0.0 AS x FROM ({LINES})")
def gain_round_trip(spark, sf_dir):
    """Demodulation of what was modulated; the SQL is the signal itself."""
    rows = _points(spark, sf_dir).withColumn("g", packing.gain_modulated(F.col("x"), F.col("x"), F.col("points"), 64))
    half = F.transform("g.following", lambda v: v / 2)
    none = F.array().cast("array<struct<level:int,loc:int>>")
    back = packing.gain_demodulated(half, half, F.col("points"), none, 64)
    return rows.select("vec_id", F.posexplode(back).alias("i", "x")).withColumn("x", F.round("x", 7) + 0.0)


@query(f"""WITH v AS (SELECT i, x / 100 AS share, (i % 11) / 4e4 AS level, CAST(i % 5 AS INT) AS band FROM ({E}))
    SELECT i, CASE WHEN share < 0.05 THEN 'skip' WHEN level < 1e-4 OR share < 0.3 OR band >= 3 THEN 'no points' ELSE 'keep' END AS gate FROM v""")
def gain_gates(spark, sf_dir):
    v = S.events(spark, sf_dir)
    return v.select("i", packing.gain_gate(F.col("x") / 100, (F.col("i") % 11) / 4e4, (F.col("i") % 5).cast("int")).alias("gate"))


@query("""WITH RECURSIVE r AS (SELECT i // 2 AS i, sum(value) AS x FROM (SELECT event_id AS i, value FROM events) GROUP BY 1),
    e AS (SELECT i, 0.98 * 0.006 + 0.01 * x AS level FROM r WHERE i = 0 UNION ALL SELECT r.i, 0.98 * e.level + 0.01 * r.x FROM e JOIN r ON r.i = e.i + 1)
    SELECT i, round(level, 7) AS level FROM e""")
def stereo_loudness(spark, sf_dir):
    pairs = S.events(spark, sf_dir).withColumn("i", F.floor(F.col("i") / 2)).groupBy("track", "ch", "i").agg((F.sum("x") / 2).alias("x"))
    return Q.decayed(pairs).select("i", F.round("level", 7).alias("level"))


# --- Coding ---

_STEPS = f"SELECT vec_id, line, line // 16 AS unit, CAST(least(7, greatest(-7, round_even(c * 20, 0))) AS INT) AS q FROM ({LINES})"


@query(f"""WITH q AS ({_STEPS}), c AS (SELECT vec_id, unit, count(*) * 4 AS fixed_bits, sum(CASE WHEN abs(q) = 0 THEN 2 WHEN abs(q) = 1 THEN 3 WHEN abs(q) < 4 THEN 4 WHEN abs(q) = 4 THEN 5 WHEN abs(q) < 7 THEN 6 ELSE 4 END) AS variable_bits FROM q GROUP BY 1, 2)
    SELECT vec_id, CAST(unit AS INT) AS unit, CAST(fixed_bits AS INT) AS fixed_bits, CAST(variable_bits AS INT) AS variable_bits, CASE WHEN fixed_bits <= variable_bits THEN 'fixed' ELSE 'variable' END AS mode FROM c""")
def spectrum_bits(spark, sf_dir):
    """Both codings of units of 16 lines with 15 levels, by the format's code lengths."""
    q = F.transform("x", lambda v: F.least(F.lit(7), F.greatest(F.lit(-7), F.rint(v * 20))).cast("int"))
    units = S.vectors(spark, sf_dir).select("vec_id", F.posexplode(F.array(*(F.slice(q, u * 16 + 1, 16) for u in range(4)))).alias("unit", "q"))
    fixed, variable = packing.spectrum_bits(F.col("q"), 5)
    return units.select("vec_id", "unit", fixed.alias("fixed_bits"), variable.alias("variable_bits")).withColumn("mode", F.when(F.col("fixed_bits") <= F.col("variable_bits"), "fixed").otherwise("variable"))


@query(f"""WITH q AS (SELECT vec_id, line // 2 AS pair, CAST(sum(CASE WHEN line % 2 = 0 THEN greatest(-1, least(1, round_even(c * 5, 0))) END) AS INT) AS a, CAST(sum(CASE WHEN line % 2 = 1 THEN greatest(-1, least(1, round_even(c * 5, 0))) END) AS INT) AS b FROM ({LINES}) GROUP BY 1, 2)
    SELECT vec_id, CAST(4 * count(*) AS INT) AS fixed_bits, CAST(sum(CASE WHEN a = 0 AND b = 0 THEN 1 WHEN a = 0 THEN 3 WHEN b = 0 THEN 4 ELSE 5 END) AS INT) AS variable_bits FROM q GROUP BY 1""")
def spectrum_pair_bits(spark, sf_dir):
    q = F.transform("x", lambda v: F.greatest(F.lit(-1), F.least(F.lit(1), F.rint(v * 5))).cast("int"))
    fixed, variable = packing.spectrum_bits(F.col("q"), 1)
    return S.vectors(spark, sf_dir).select("vec_id", q.alias("q")).select("vec_id", fixed.alias("fixed_bits"), variable.alias("variable_bits"))


_WORDS = [(t, r, s, n) for t, (counts, symbols) in enumerate(T.C3_WORD_CODES) for r, (s, n) in enumerate(zip(symbols, [k + 1 for k, c in enumerate(counts) for _ in range(c)], strict=True))]


@query(f"""WITH RECURSIVE w AS (SELECT * FROM (VALUES {", ".join(map(str, _WORDS))}) AS v(tab, rank, symbol, length)),
    c AS (SELECT tab, rank, symbol, length, 0 AS code FROM w WHERE rank = 0 UNION ALL SELECT w.tab, w.rank, w.symbol, w.length, (c.code + 1) << (w.length - c.length) FROM c JOIN w ON w.tab = c.tab AND w.rank = c.rank + 1)
    SELECT CAST(tab AS INT) AS tab, CAST(symbol AS INT) AS symbol, CAST(length AS INT) AS length, CAST(code AS INT) AS code FROM c""")
def canonical_codes(spark, sf_dir):
    rows = spark.createDataFrame(_WORDS, "tab int, rank int, symbol int, length int")
    return packing.canonical(rows, ["tab"]).select("tab", "symbol", "length", "code")


_WL = f"SELECT vec_id, list_transform(x[1:32], lambda v: CAST(floor(abs(v) * 20) AS INT) & 7) AS a, list_transform(x[33:64], lambda v: CAST(floor(abs(v) * 20) AS INT) & 7) AS b FROM ({V})"


def _word_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = lambda first: F.transform(F.slice("x", first, 32), lambda v: F.floor(F.abs(v) * 20).cast("int").bitwiseAND(7))
    return S.vectors(spark, sf_dir).select("vec_id", w(1).alias("a"), w(33).alias("b"))


@query(f"""SELECT vec_id, list_transform(a, lambda v, i: CAST(CASE WHEN i = 1 THEN v ELSE v - a[i - 1] END & 7 AS INT)) AS own, list_transform(b, lambda v, i: CAST((v - a[i]) & 7 AS INT)) AS between_channels FROM ({_WL})""")
def word_length_deltas(spark, sf_dir):
    return _word_lengths(spark, sf_dir).select("vec_id", packing.delta_words(F.col("a")).alias("own"), packing.delta_words(F.col("b"), F.col("a")).alias("between_channels"))


@query(f"""WITH d AS (SELECT vec_id, list_transform(a, lambda v, i: CASE WHEN i = 1 THEN v ELSE v - a[i - 1] END & 7) AS d FROM ({_WL})), e AS (SELECT vec_id, unnest(d[2:]) AS d FROM d),
    t AS (SELECT vec_id, sum(({_ints(T.C3_WORD_LENGTHS[2])})[d + 1]) AS t2, sum(({_ints(T.C3_WORD_LENGTHS[3])})[d + 1]) AS t3 FROM e GROUP BY 1)
    SELECT vec_id, CAST(CASE WHEN t3 < t2 THEN 3 ELSE 2 END AS INT) AS tab, CAST(least(t2, t3) AS INT) AS bits FROM t""")
def best_word_length_table(spark, sf_dir):
    best = packing.best_delta_table(packing.delta_words(F.col("a")), 2, 3)
    return _word_lengths(spark, sf_dir).select("vec_id", best.alias("b")).select("vec_id", F.col("b.table").alias("tab"), "b.bits")


@query(f"""WITH v AS (SELECT i, CAST(i * 7 % 130 AS INT) AS bits, CAST(i % 33 AS INT) AS fixed FROM ({E})), m AS (SELECT *, CASE WHEN fixed = 0 THEN 32 ELSE fixed END AS most FROM v)
    SELECT i, CAST(greatest(1, CASE WHEN bits >= 101 THEN most WHEN bits > 5 THEN least(most, greatest(1, (bits - 5) // 3)) ELSE 1 END) AS INT) AS units FROM m""")
def initial_units(spark, sf_dir):
    v = S.events(spark, sf_dir)
    return v.select("i", packing.initial_units((F.col("i") * 7 % 130).cast("int"), (F.col("i") % 33).cast("int")).alias("units"))


@query(f"""WITH b AS (SELECT vec_id, line, CAST(floor(greatest(0, abs(c) * 8 - line / 16.0)) AS INT) AS bits FROM ({LINES})) SELECT vec_id, CAST(greatest(1, coalesce(max(line + 1) FILTER (bits > 0), 0)) AS INT) AS units FROM b GROUP BY 1""")
def trimmed_units(spark, sf_dir):
    bits = F.transform("x", lambda v, i: F.floor(F.greatest(F.lit(0.0), F.abs(v) * 8 - i / 16.0)).cast("int"))
    return S.vectors(spark, sf_dir).select("vec_id", packing.trimmed_units(bits).alias("units"))


@query(f"""WITH u AS (SELECT vec_id, line, CAST(line % 8 AS INT) AS b, abs(c) * 6 AS e FROM ({LINES}) WHERE line < 32)
    SELECT vec_id, list(CASE WHEN line < 10 AND b < 7 AND (e > 0 AND e < 0.7 OR e > 1.2) THEN b + 1 ELSE b END ORDER BY line) AS bits FROM u GROUP BY 1""")
def boosted_units(spark, sf_dir):
    v = S.vectors(spark, sf_dir).select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: i % 8).alias("b"), F.transform(F.slice("x", 1, 32), lambda s: F.abs(s) * 6).alias("e"))
    return v.select("vec_id", packing.boosted(F.col("b"), F.col("e")).alias("bits"))


@query(f"""WITH c AS (SELECT vec_id, line + 1 AS n, sum(abs(c) * 100) OVER (PARTITION BY vec_id ORDER BY line) AS cost FROM ({LINES}) WHERE line < 32)
    SELECT vec_id, CAST(coalesce(max(n) FILTER (cost <= 150 AND n NOT IN (29, 30, 31)), 1) AS INT) AS units FROM c GROUP BY 1""")
def units_that_fit(spark, sf_dir):
    costs = F.transform(F.slice("x", 1, 32), lambda v: F.abs(v) * 100)
    return S.vectors(spark, sf_dir).select("vec_id", costs.alias("c")).select("vec_id", packing.units_that_fit(F.col("c"), F.lit(150.0)).alias("units"))


def _c2_units() -> str:
    return f"SELECT unnest({_ints(T.C2_WIDTHS)}) AS width, unnest({_ints(T.C2_STARTS[:32])}) AS begin, unnest(range(0, 32)) AS unit"


@query(f"""WITH b AS ({_bands_sql(1, 1024)}), u AS ({_c2_units()}), f AS (
      SELECT frame, unit, exp(avg(ln(greatest(x * x, 1e-12)))) AS g, avg(x * x) AS a FROM b JOIN u ON p >= begin AND p < begin + width GROUP BY 1, 2)
    SELECT frame, CAST(unit AS INT) AS unit, CASE WHEN a <= 1e-12 THEN 1 ELSE least(1.0, greatest(0.0, g / a)) END < 0.6 AND unit BETWEEN 8 AND 28 AS tonal FROM f""")
def tonal_units(spark, sf_dir):
    """The gate on layout and frames of codec 2; events are noise, so the limit is raised to where it divides them."""
    frames = bands(spark, sf_dir, 1, 1024).select("frame", F.posexplode("x").alias("line", "c"))
    units = F.broadcast(T.unit_table(spark, T.C2_WIDTHS, T.C2_BAND_UNITS))  # a row a line
    return A.flatness(frames.join(units, "line"), ["frame"]).select("frame", "unit", packing.is_tonal(F.col("flatness"), F.col("unit"), 0.6).alias("tonal"))


# --- Tables and helpers ---


@query(f"SELECT i, CAST(CASE WHEN i % 100 = 0 THEN 536870912 ELSE (i % 100 + 7) // 8 END AS BIGINT) AS n FROM ({E})")
def byte_count(spark, sf_dir):
    return S.events(spark, sf_dir).select("i", packing.byte_count(F.col("i") % 100).alias("n"))


@query(f"""WITH v AS (SELECT i, i * 2654435761 % 4294967296 AS v FROM ({E})) SELECT i, ((v & 255) * 16777216) + (((v // 256) & 255) * 65536) + (((v // 65536) & 255) * 256) + v // 16777216 AS four, ((v & 255) * 256) + ((v // 256) & 255) AS two FROM v""")
def endian_swap(spark, sf_dir):
    v = S.events(spark, sf_dir).select("i", (F.col("i") * 2654435761 % 4294967296).alias("v"))
    return v.select("i", packing.endian_swapped(F.col("v"), 4).alias("four"), packing.endian_swapped(F.col("v").bitwiseAND(65535), 2).alias("two"))


@query(f"""WITH v AS (SELECT i, i % 9 AS k, CAST(i % 20 AS INT) AS m, CAST(i % 3 AS INT) AS r FROM ({E}))
    SELECT i, CASE WHEN k IN (0, 1, 3) THEN m END AS ghadbg, CASE WHEN k IN (1, 2, 3) THEN r END AS ghawbrefine,
      CASE WHEN k = 4 THEN 'unknown key' WHEN k = 5 THEN 'no value' WHEN k = 6 THEN 'two equals signs' WHEN k IN (0, 1, 3) AND m > 15 OR k IN (1, 2, 3) AND r > 1 THEN 'out of range' END AS error FROM v""")
def advanced_options(spark, sf_dir):
    m, r, k = (F.col("i") % 20).cast("string"), (F.col("i") % 3).cast("string"), F.col("i") % 9
    cat = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    text = F.when(k == 0, cat("ghadbg=", m)).when(k == 1, cat("ghadbg=", m, ",ghawbrefine=", r)).when(k == 2, cat("ghawbrefine=", r)).when(k == 3, cat("ghawbrefine=", r, ",ghadbg=7,ghadbg=", m))
    text = text.when(k == 4, "other=1").when(k == 5, "ghadbg").when(k == 6, "ghadbg==").when(k == 7, "ghadbg=,ghawbrefine=")
    parsed = S.events(spark, sf_dir).select("i", packing.advanced_options(text).alias("o"))
    return parsed.select("i", "o.ghadbg", "o.ghawbrefine", "o.error")


@query(f"""SELECT CAST(i AS INT) AS word_length, CASE WHEN i > 0 THEN round(1 / ({_doubles(T.C3_MANTISSA)})[i + 1], 9) ELSE 0 END AS factor FROM range(0, 8) AS r(i)""")
def inverse_mantissas(spark, sf_dir):
    return spark.range(8).select(F.col("id").cast("int").alias("word_length"), F.round(F.get(F.lit(T.C3_INVERSE_MANTISSA), F.col("id").cast("int")), 9).alias("factor"))


@query("""SELECT CAST(i AS INT) AS i, round(sin((i + 0.5) * pi() / 64), 9) AS sine FROM range(0, 32) AS r(i)""")
def short_sine_window(spark, sf_dir):
    return spark.range(32).select(F.col("id").cast("int").alias("i"), F.round(F.get(F.lit(T.SINE_32), F.col("id").cast("int")), 9).alias("sine"))


@query("""WITH w AS (SELECT i, least(i, 63 - i) AS d FROM range(0, 64) AS r(i)) SELECT CAST(i AS INT) AS i, round(CASE WHEN d = 0 THEN 0 WHEN d >= 9 THEN 1 ELSE 1 / (1 + exp(9.0 / d - 9.0 / (9 - d))) END, 9) AS taper FROM w""")
def taper_window(spark, sf_dir):
    return spark.range(64).select(F.col("id").cast("int").alias("i"), F.round(F.get(F.lit(L.planck_window(64)), F.col("id").cast("int")), 9).alias("taper"))


_FORMATS = ("wav", "AT3", "raw", "dat", "rm", "oma", "aea", "")


@query(f"""WITH f AS (SELECT i, 'c' || (i % 3 + 1) AS codec, lower(({list(_FORMATS)})[i % 8 + 1]) AS ext, CASE WHEN i % 5 = 0 THEN (['aea', 'OMA', 'riff', 'rm', 'raw'])[i // 5 % 5 + 1] END AS named FROM ({E})),
    c AS (SELECT i, codec, coalesce(lower(named), CASE WHEN ext IN ('raw', 'dat') THEN 'raw' WHEN codec = 'c1' THEN 'aea' WHEN ext IN ('wav', 'at3') THEN 'riff' WHEN ext = 'rm' THEN 'rm' ELSE 'oma' END) AS container FROM f)
    SELECT i, container, (codec || container) NOT IN ('c1oma', 'c1riff', 'c1rm', 'c2aea', 'c3aea', 'c3rm') AS legal FROM c""")
def container_legality(spark, sf_dir):
    i = F.col("i")
    named = F.when(i % 5 == 0, F.get(F.lit(["aea", "OMA", "riff", "rm", "raw"]), (F.floor(i / 5) % 5).cast("int")))
    c = packing.chosen_container(F.concat(F.lit("c"), (i % 3 + 1).cast("string")), F.get(F.lit(list(_FORMATS)), (i % 8).cast("int")), named)
    return S.events(spark, sf_dir).select("i", c.alias("c")).select("i", "c.container", "c.legal")


_HEARING = f"""SELECT line, pow(10.0, (0.01 * (({_doubles(T.HEARING)})[CAST(floor(t) AS INT) + 1] * (1 + floor(t) - t) + ({_doubles(T.HEARING)})[CAST(floor(t) AS INT) + 2] * (t - floor(t))) - 100 - f * f / 1e6 * 0.015) / 10) AS power
    FROM (SELECT line, f, 40 * log10(0.1 * f) AS t FROM (SELECT line, least(29853.0, greatest(10.0, (line + 1) * 22050 / 1024.0)) AS f FROM range(0, 1024) AS r(line)))"""


@query(f"""WITH u AS ({_c2_units()}), h AS ({_HEARING}), m AS (SELECT unit, min(power) AS power FROM u JOIN h ON line >= begin AND line < begin + width GROUP BY 1)
    SELECT CAST(unit AS INT) AS unit, round(log10(power), 7) AS log_threshold FROM m""")
def unit_thresholds(spark, sf_dir):
    values = [math.log10(v) for v in T.threshold_by_unit(T.C2_WIDTHS)]
    return spark.range(len(values)).select(F.col("id").cast("int").alias("unit"), F.round(F.get(F.lit(values), F.col("id").cast("int")), 7).alias("log_threshold"))


@query(f"""WITH u AS ({_c2_units()}), h AS ({_HEARING}), m AS (SELECT unit, any_value(begin) AS begin, any_value(width) AS width, min(power) AS power FROM u JOIN h ON line >= begin AND line < begin + width GROUP BY 1),
      b AS ({_bands_sql(1, 1024)}), e AS (SELECT frame, unit, sum(x * x) * 1e-13 AS energy, any_value(power) AS power FROM b JOIN m ON p >= begin AND p < begin + width GROUP BY 1, 2)
    SELECT frame, CAST(unit AS INT) AS unit, energy >= power * 0.006 AS audible FROM e""")
def audible_units(spark, sf_dir):
    frames = bands(spark, sf_dir, 1, 1024).select("frame", F.posexplode("x").alias("line", "c"))
    units = F.broadcast(T.unit_table(spark, T.C2_WIDTHS, T.C2_BAND_UNITS))  # a row a line
    energy = frames.join(units, "line").groupBy("frame", "unit").agg((F.sum(F.col("c") * F.col("c")) * 1e-13).alias("energy"))
    limit = F.get(F.lit(T.threshold_by_unit(T.C2_WIDTHS)), F.col("unit"))
    return energy.select("frame", F.col("unit").cast("int").alias("unit"), packing.audible(F.col("energy"), limit, F.lit(0.006)).alias("audible"))

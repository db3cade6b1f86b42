"""Registered queries of the signal operators, each with equivalent DuckDB SQL.

Keys name the operator. Results are rounded where a float result could differ in its last
bits between two engines.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import tables as T
from framewright.operators import coding as C
from framewright.operators import framing as P
from framewright.operators import sequence as Q
from framewright.operators import stats as A
from framewright.operators import transforms as L
from framewright.plans import codec_queries, frame_queries, kernels
from framewright.plans import signals as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def values(numbers: list, name: str = "v") -> str:
    """A DuckDB list literal."""
    return "[" + ", ".join(repr(float(x)) + "::DOUBLE" if isinstance(x, float) else str(x) for x in numbers) + "]"


E, V, LINES = S.EVENTS_SQL, S.VECTORS_SQL, S.LINES_SQL
#: A layout of 64 lines in 4 bands: units of 8 lines, two units a band.
W64, B64 = [8] * 8, [0, 2, 4, 6, 8]


def profile(size: int) -> str:
    return f"SELECT i // {size} AS frame, list(x ORDER BY i) AS x FROM ({E}) GROUP BY 1 HAVING count(*) = {size}"


def full_frames(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """(frame, x) of the frames that have all their samples."""
    cut = P.block_step(S.events(spark, sf_dir), size)
    return cut.groupBy("frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("x")).where(F.size("x") == size)


def sql_round(x: Column, digits: int) -> Column:
    """A double rounded as DuckDB does it: scaled up, to the nearest whole number (halves away from zero), scaled back.

    F.round rounds a number's shortest decimals instead. The two differ where these end in a half that the
    scaled number misses, and where the scaled number is above 2^53, so that scaling back is not exact.
    """
    scale = 10.0**digits
    return Q.let(F.round(x * scale) / scale, lambda r: F.when(F.abs(r) < math.inf, r).otherwise(x))


# --- Framing and reshaping ---


@query(f"SELECT i, i // 64 AS frame, CAST(i % 64 AS INT) AS pos, x FROM ({E})")
def block_step(spark, sf_dir):
    return P.block_step(S.events(spark, sf_dir), 64).select("i", "frame", "pos", "x")


@query(f"SELECT CAST(i % 2 AS INT) AS ch, i // 2 AS i, x FROM ({E})")
def deinterleave(spark, sf_dir):
    return P.deinterleave(S.events(spark, sf_dir), 2).select("ch", "i", "x")


@query(f"""SELECT vec_id, list_transform(range(0, 64), lambda k: round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, 3 * x[1 + 32 * (k % 2) + k // 2])), 9)) AS y FROM ({V})""")
def interleave_clip(spark, sf_dir):
    v = S.vectors(spark, sf_dir)
    loud = F.transform("x", lambda s: s * 3)
    return v.select("vec_id", F.transform(P.interleave_clip(F.slice(loud, 1, 32), F.slice(loud, 33, 32)), lambda s: F.round(s, 9)).alias("y"))


@query(f"""SELECT vec_id, list_reverse(x) AS rev, list_transform(x, lambda s, i: CASE WHEN i % 2 = 1 THEN -s ELSE s END) AS flip,
           CASE WHEN label % 2 = 1 THEN list_reverse(x) ELSE x END AS band FROM ({V})""")
def band_reverse_and_flip(spark, sf_dir):
    v = S.vectors(spark, sf_dir)
    return v.select("vec_id", F.reverse("x").alias("rev"), P.spectral_flip(F.col("x")).alias("flip"), P.band_reverse(F.col("x"), F.col("label")).alias("band"))


@query("""WITH c AS (SELECT event_type, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i FROM events)
    SELECT l.i, (l.x + r.x) / 2 AS mid, (l.x - r.x) / 2 AS side FROM c l JOIN c r ON l.i = r.i AND l.event_type = 'click' AND r.event_type = 'view'""")
def mid_side(spark, sf_dir):
    return P.mid_side(S.channel(spark, sf_dir, "click"), S.channel(spark, sf_dir, "view")).select("i", "mid", "side")


@query(f"""WITH f AS (SELECT i // 64 AS frame, round(sum(x * x), 4) AS energy FROM ({E}) GROUP BY 1)
    SELECT frame, energy, coalesce(lead(energy) OVER w, 0) AS next, coalesce(lag(energy) OVER w, 0) AS previous FROM f WINDOW w AS (ORDER BY frame)""")
def look_ahead(spark, sf_dir):
    f = P.block_step(S.events(spark, sf_dir), 64).groupBy("track", "ch", "frame").agg(F.round(F.sum(F.col("x") * F.col("x")), 4).alias("energy"))
    return P.look_ahead(f, "energy").select("frame", "energy", "next", "previous")


@query("""SELECT doc_id, md5(source || source) AS doubled, reverse(source) AS reversed FROM documents""")
def payload_double_and_reverse(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    s = F.col("source").cast("binary")
    return d.select("doc_id", F.md5(P.double_mono(s)).alias("doubled"), P.byte_reverse(s).cast("string").alias("reversed"))


@query()
def payload_text_double_and_reverse(spark, sf_dir):
    """``payload_double_and_reverse`` for the bytes of texts; DuckDB reverses characters, not bytes."""
    t = F.col("text").cast("binary")
    return S.table(spark, sf_dir, "documents").select("doc_id", F.md5(P.double_mono(t)).alias("doubled"), P.byte_reverse(t).alias("reversed"))


@query(f"""SELECT vec_id, 0 AS ch, x FROM ({V}) UNION ALL SELECT vec_id, 1, list_transform(x, lambda v: v * 0.0) FROM ({V})""")
def silent_side(spark, sf_dir):
    return P.silent_side(S.vectors(spark, sf_dir).select("vec_id", F.lit(0).alias("ch"), "x"))


@query("""SELECT event_id, CAST(round_even(value, 0) AS INT) / 32768.0::DOUBLE AS x FROM events""")
def sample_conversion(spark, sf_dir):
    return S.table(spark, sf_dir, "events").select("event_id", (F.rint("value").cast("int") / 32768.0).alias("x"))


# --- Aggregates ---


@query(f"""SELECT i // 64 AS frame, CAST(i % 64 // 8 AS INT) AS sub, round(sqrt(avg(x * x)), 8) AS rms, max(abs(x)) AS peak, round(sum(x * x), 4) AS energy FROM ({E}) GROUP BY 1, 2""")
def block_profile(spark, sf_dir):
    p = A.block_profile(S.events(spark, sf_dir), 64, 8)
    return p.select("frame", "sub", F.round("rms", 8).alias("rms"), "peak", F.round("energy", 4).alias("energy"))


@query(f"""WITH s AS (SELECT i // 512 AS frame, i % 512 // 64 AS sub, i % 64 // 8 AS chunk, sqrt(avg(x * x)) AS r, sum(x * x) AS e, count(*) AS n FROM ({E}) GROUP BY 1, 2, 3),
    w AS (SELECT frame, sub, sqrt(sum(e) / sum(n)) AS level, list_sort(list(r)) AS s FROM s GROUP BY 1, 2)
    SELECT frame, CAST(sub AS INT) AS sub, round(level, 8) AS level, round(s[len(s) // 4 + 1], 8) AS low, round(s[len(s) * 3 // 4 + 1], 8) AS high FROM w""")
def inner_quartiles(spark, sf_dir):
    q = A.inner_quartiles(S.events(spark, sf_dir), 512, 64)
    return q.select("frame", "sub", *(F.round(c, 8).alias(c) for c in ("level", "low", "high")))


@query(f"SELECT vec_id, list_sort(x)[(len(x) - 1) // 2 + 1] AS median, round(list_sum(list_transform(x, lambda v: v * v)), 9) AS energy FROM ({V})")
def median_and_energy(spark, sf_dir):
    return S.vectors(spark, sf_dir).select("vec_id", A.lower_median(F.col("x")).alias("median"), F.round(A.energy(F.col("x")), 9).alias("energy"))


def scaled_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = A.by_unit(A.spectrum_rows(S.vectors(spark, sf_dir)), W64, B64)
    return A.scale_units(units, ["vec_id", "label"])


SCALED = f"""SELECT *, CAST(least(63, len(list_filter({values(T.SCALE)}, lambda t: t < m))) AS INT) AS sf FROM (
    SELECT vec_id, label, CAST(line // 16 AS INT) AS band, CAST(line // 8 AS INT) AS unit, max(abs(c)) AS m, sum(c * c) AS energy FROM ({LINES}) GROUP BY 1, 2, 3, 4)"""


@query(f"SELECT vec_id, band, unit, sf, round(pow(2.0, sf / 3.0 - 21), 12) AS scale, round(energy, 9) AS energy FROM ({SCALED})")
def scale_units(spark, sf_dir):
    return scaled_units(spark, sf_dir).select("vec_id", "band", "unit", "sf", F.round("scale", 12).alias("scale"), F.round("energy", 9).alias("energy"))


@query(f"""WITH u AS (SELECT vec_id, CAST(line // 8 AS INT) AS unit, avg(ln(greatest(c * c, 1e-12))) AS l, avg(c * c) AS a FROM ({LINES}) GROUP BY 1, 2)
    SELECT vec_id, unit, round(CASE WHEN a <= 1e-12 THEN 1.0 ELSE least(1.0, greatest(0.0, exp(l) / a)) END, 8) AS flatness FROM u""")
def flatness(spark, sf_dir):
    units = A.by_unit(A.spectrum_rows(S.vectors(spark, sf_dir)), W64, B64)
    return A.flatness(units, ["vec_id"]).select("vec_id", "unit", F.round("flatness", 8).alias("flatness"))


@query(f"SELECT vec_id, round(least(stddev_pop(sf), 14) / 14, 9) AS spread, round(coalesce(avg(sf) FILTER (band = 0) - avg(sf) FILTER (band = 1), 0), 9) AS tilt FROM ({SCALED}) GROUP BY 1")
def scale_spread_and_tilt(spark, sf_dir):
    s = scaled_units(spark, sf_dir)
    return A.scale_spread(s, ["vec_id"]).join(A.tilt(s, ["vec_id"]), "vec_id").select("vec_id", F.round("spread", 9).alias("spread"), F.round("tilt", 9).alias("tilt"))


@query(f"SELECT vec_id, round(sum(c * c * ({values(T.loudness_curve(64))})[line + 1]), 8) AS loudness FROM ({LINES}) GROUP BY 1")
def weighted_loudness(spark, sf_dir):
    return A.weighted_loudness(A.spectrum_rows(S.vectors(spark, sf_dir)), ["vec_id"], 64).select("vec_id", F.round("loudness", 8).alias("loudness"))


@query(f"""WITH h AS (SELECT vec_id, sum(c * c) FILTER (line < 32) AS a, sum(c * c) FILTER (line >= 32) AS b FROM ({LINES}) GROUP BY 1)
    SELECT vec_id, round(CASE WHEN a <= 1e-20 OR b <= 1e-20 THEN 1 ELSE a / b END, 8) AS ratio FROM h""")
def overlap_energy_ratio(spark, sf_dir):
    e = F.col("c") * F.col("c")
    h = A.spectrum_rows(S.vectors(spark, sf_dir)).groupBy("vec_id").agg(F.sum(F.when(F.col("line") < 32, e)).alias("a"), F.sum(F.when(F.col("line") >= 32, e)).alias("b"))
    return h.select("vec_id", F.round(A.safe_energy_ratio(F.col("a"), F.col("b")), 8).alias("ratio"))


@query(f"""WITH l AS (SELECT vec_id, c, c / CASE WHEN line < 32 THEN 2.0 ELSE 1.0 END AS m, ({values([T.ENCODE_WINDOW[255 - 4 * k] for k in range(64)])})[line + 1] AS wc, ({values([T.ENCODE_WINDOW[4 * k] for k in range(64)])})[line + 1] AS wn FROM ({LINES})),
    s AS (SELECT vec_id, sum(c*wc*c*wc) AS co, sum(m*wc*m*wc) AS cm, sum(c*wn*c*wn) AS no, sum(m*wn*m*wn) AS nm FROM l GROUP BY 1)
    SELECT vec_id, round(CASE WHEN co <= 1e-20 OR cm <= 1e-20 THEN 1 ELSE co / cm END, 8) AS cur, round(CASE WHEN no <= 1e-20 OR nm <= 1e-20 THEN 1 ELSE no / nm END, 8) AS next FROM s""")
def gain_energy_scale(spark, sf_dir):
    wc, wn = (F.get(F.lit(w), F.col("line")) for w in ([T.ENCODE_WINDOW[255 - 4 * k] for k in range(64)], [T.ENCODE_WINDOW[4 * k] for k in range(64)]))
    rows = A.spectrum_rows(S.vectors(spark, sf_dir)).withColumn("m", F.col("c") / F.when(F.col("line") < 32, 2.0).otherwise(1.0))
    sq = lambda a, w: F.sum(a * w * a * w)
    s = rows.groupBy("vec_id").agg(sq(F.col("c"), wc).alias("co"), sq(F.col("m"), wc).alias("cm"), sq(F.col("c"), wn).alias("no"), sq(F.col("m"), wn).alias("nm"))
    return s.select("vec_id", F.round(A.safe_energy_ratio(F.col("co"), F.col("cm")), 8).alias("cur"), F.round(A.safe_energy_ratio(F.col("no"), F.col("nm")), 8).alias("next"))


@query(f"""SELECT vec_id, line // 16 AS "group", count(*) AS n FROM ({LINES}) WHERE abs(c) > 0.1 GROUP BY 1, 2""")
def component_counts(spark, sf_dir):
    rows = A.spectrum_rows(S.vectors(spark, sf_dir)).where(F.abs("c") > 0.1)
    return A.window_counts(rows, ["vec_id"], "line", 16)


@query(f"""SELECT vec_id, round(sum(pow(c - 0.3 * sin(0.2 * line + 0.5) - 0.1 * sin(1.1 * line), 2)), 8) AS sse FROM ({LINES}) GROUP BY 1""")
def tone_residual(spark, sf_dir):
    model = 0.3 * F.sin(0.2 * F.col("line") + 0.5) + 0.1 * F.sin(1.1 * F.col("line"))
    return A.spectrum_rows(S.vectors(spark, sf_dir)).groupBy("vec_id").agg(F.round(F.sum(F.pow(F.col("c") - model, 2)), 8).alias("sse"))


@query(f"SELECT label, max(line // 16) FILTER (abs(c) > 0.35) + 1 AS bands FROM ({LINES}) GROUP BY 1")
def max_band_with_tones(spark, sf_dir):
    rows = A.spectrum_rows(S.vectors(spark, sf_dir))
    return rows.groupBy("label").agg((F.max(F.when(F.abs("c") > 0.35, F.floor(F.col("line") / 16))) + 1).alias("bands"))


# --- Filters and transforms ---


def _mdct_sql(n: int) -> str:
    return f"""WITH l AS ({LINES}) SELECT vec_id, CAST(k AS INT) AS k, round(sum(c * cos(2 * pi() / {n} * (line + 0.5 + {n} / 4.0) * (k + 0.5))), 6) + 0.0 AS c FROM l, range(0, {n // 2}) AS t(k) WHERE line < {n} GROUP BY 1, 2"""


def _rows(df: DataFrame, y: str = "y") -> DataFrame:
    return df.select("vec_id", F.posexplode(y).alias("k", "c")).withColumn("c", F.round("c", 6) + 0.0)


@query(_mdct_sql(64))
def mdct64(spark, sf_dir):
    return _rows(S.vectors(spark, sf_dir).select("vec_id", L.mdct(F.col("x"), 64).alias("y")))


@query(_mdct_sql(64))
def mdct64_basis_join(spark, sf_dir):
    return L.basis_join(S.vectors(spark, sf_dir), ["vec_id"], L.mdct_basis(64)).withColumn("c", F.round("c", 6) + 0.0)


@query(f"""WITH l AS ({LINES}) SELECT vec_id, CAST(t AS INT) AS k, round(sum(c * cos(2 * pi() / 128 * (t + 0.5 + 32) * (line + 0.5))), 6) + 0.0 AS c FROM l, range(0, 128) AS g(t) GROUP BY 1, 2""")
def imdct128(spark, sf_dir):
    return _rows(S.vectors(spark, sf_dir).select("vec_id", L.imdct(F.col("x"), 128).alias("y")))


@query(f"""WITH l AS ({LINES}) SELECT vec_id, CAST(k AS INT) AS k, round(sum(c * cos(pi() / 16 * (line + 0.5) * (k + 0.5))), 6) + 0.0 AS c FROM l, range(0, 16) AS g(k) WHERE line < 16 GROUP BY 1, 2""")
def dct4_16(spark, sf_dir):
    return _rows(S.vectors(spark, sf_dir).select("vec_id", L.dct4(F.slice("x", 1, 16), 16).alias("y")))


@query(f"""WITH l AS ({LINES}) SELECT vec_id, CAST(line // 16 AS INT) AS block, CAST(k AS INT) AS k, round(sum(c * cos(pi() / 16 * (line % 16 + 0.5) * (k + 0.5))), 6) + 0.0 AS c FROM l, range(0, 16) AS g(k) GROUP BY 1, 2, 3""")
def dct4_16_blocks(spark, sf_dir):
    """``dct4_16`` for all four blocks of a vector."""
    cut = S.vectors(spark, sf_dir).select("vec_id", F.posexplode(F.array(*(F.slice("x", b * 16 + 1, 16) for b in range(4)))).alias("block", "x"))
    y = cut.select("vec_id", "block", L.dct4(F.col("x"), 16).alias("y"))
    return y.select("vec_id", "block", F.posexplode("y").alias("k", "c")).withColumn("c", F.round("c", 6) + 0.0)


@query(f"""WITH l AS ({LINES}), s AS (SELECT vec_id, k, sum(c * cos(2 * pi() * k * line / 64)) AS a, sum(c * sin(2 * pi() * k * line / 64)) AS b FROM l, range(0, 33) AS g(k) GROUP BY 1, 2)
    SELECT vec_id, CAST(k AS INT) AS k, round(a * a + b * b, 6) + 0.0 AS c FROM s""")
def power_spectrum(spark, sf_dir):
    return _rows(S.vectors(spark, sf_dir).select("vec_id", L.power_spectrum(F.col("x")).alias("y")))


@query(f"""WITH w AS (SELECT vec_id, line, c * ({values(L.planck_window(64))})[line + 1] AS c FROM ({LINES})),
    s AS (SELECT vec_id, k, sum(c * cos(2 * pi() * k * line / 64)) AS a, sum(c * sin(2 * pi() * k * line / 64)) AS b FROM w, range(0, 33) AS g(k) GROUP BY 1, 2),
    g AS (SELECT vec_id, k, a * a + b * b AS p, CASE WHEN k = 0 THEN 0 ELSE 0.5 - 0.5 * cos(pi() * least(1.0, greatest(0.0, (k - 8 + 1.5) / 3))) END AS gain FROM s)
    SELECT vec_id, round(sum(p * gain * gain) / sum(p), 8) AS ratio FROM g GROUP BY 1""")
def high_frequency_ratio(spark, sf_dir):
    return S.vectors(spark, sf_dir).select("vec_id", F.round(L.upsample(F.col("x"), 64.0, 8.0)["ratio"], 8).alias("ratio"))


_FIR = f"SELECT s.i + t.k AS i, sum(s.x * ({{taps}})[t.k + 1]) AS y FROM ({E}) s, range(0, {{n}}) AS t(k) GROUP BY 1 HAVING s.i + t.k <= (SELECT max(event_id) FROM events)"


@query(f"SELECT i, round(y, 6) + 0.0 AS y FROM ({_FIR.format(taps=values(T.high_pass_taps()), n=21)})")
def high_pass(spark, sf_dir):
    return L.fir(S.events(spark, sf_dir), T.high_pass_taps()).select("i", (F.round("y", 6) + 0.0).alias("y"))


@query(f"""WITH f AS (SELECT s.i + t.k AS i, sum(CASE WHEN t.k % 2 = 0 THEN s.x * ({values(T.QMF_TAPS)})[t.k + 1] ELSE 0 END) AS a, sum(CASE WHEN t.k % 2 = 1 THEN s.x * ({values(T.QMF_TAPS)})[t.k + 1] ELSE 0 END) AS b FROM ({E}) s, range(0, 48) AS t(k) GROUP BY 1)
    SELECT i // 2 AS i, round(a + b, 6) + 0.0 AS low, round(a - b, 6) + 0.0 AS high FROM f WHERE i % 2 = 1 AND i <= (SELECT max(event_id) FROM events)""")
def qmf_analysis(spark, sf_dir):
    return L.qmf_analysis(S.events(spark, sf_dir)).select("i", (F.round("low", 6) + 0.0).alias("low"), (F.round("high", 6) + 0.0).alias("high"))


@query(f"""WITH f AS (SELECT s.i + t.k AS i, sum(CASE WHEN t.k % 2 = 0 THEN s.x * ({values(T.QMF_TAPS)})[t.k + 1] ELSE 0 END) AS a, sum(CASE WHEN t.k % 2 = 1 THEN s.x * ({values(T.QMF_TAPS)})[t.k + 1] ELSE 0 END) AS b FROM ({E}) s, range(0, 48) AS t(k) GROUP BY 1),
    h AS (SELECT i // 2 AS j, a, b FROM f WHERE i % 2 = 1 AND i <= (SELECT max(event_id) FROM events)),
    y AS (SELECT 2 * (j + r) + 1 AS i, a * ({values(T.QMF_TAPS)})[2 * (23 - r) + 1] AS v FROM h, range(0, 24) AS t(r) UNION ALL SELECT 2 * (j + r), b * ({values(T.QMF_TAPS)})[2 * (23 - r) + 2] FROM h, range(0, 24) AS t(r))
    SELECT i, round(sum(v), 6) + 0.0 AS x FROM y GROUP BY i HAVING i <= (SELECT max(event_id) FROM events)""")
def qmf_synthesis(spark, sf_dir):
    """Halves of the events put together again."""
    halves = L.qmf_analysis(S.events(spark, sf_dir)).withColumns({c: F.col(c) / 2 for c in ("low", "high")})
    return L.qmf_synthesis(halves).select("i", (F.round("x", 6) + 0.0).alias("x"))


# --- Windows and sequences ---


@query(f"""WITH f AS ({_FIR.format(taps=values(T.high_pass_taps()), n=21)}), b AS (SELECT i // 16 AS i, round(sqrt(avg(y * y)), 9) AS x FROM f GROUP BY 1),
    l AS (SELECT i, x, CASE WHEN x > 0 THEN 19 * log10(x) END AS db, lag(x) OVER w AS px, row_number() OVER w AS n FROM b WINDOW w AS (ORDER BY i)),
    d AS (SELECT i, x, n, px, db, CASE WHEN n = 1 THEN 0 WHEN px > 0 THEN 19 * log10(px) END AS pdb FROM l)
    SELECT i, CASE WHEN x <= 0 AND n > 1 AND px <= 0 THEN false WHEN x <= 0 OR (n > 1 AND px <= 0) THEN true ELSE db - pdb > 16 OR pdb - db > 20 END AS transient FROM d""")
def transient_blocks(spark, sf_dir):
    y = L.fir(S.events(spark, sf_dir), T.high_pass_taps())
    blocks = y.groupBy("track", "ch", F.floor(F.col("i") / 16).alias("i")).agg(F.round(A.rms("y"), 9).alias("x"))
    return Q.rise_and_fall(blocks).select("i", "transient")


@query(f"""WITH w AS (SELECT i, list_sort(list(x) OVER (ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS s FROM ({E})) SELECT i, s[len(s) // 2 + 1] AS y FROM w""")
def median3(spark, sf_dir):
    return P.over_track(S.events(spark, sf_dir), 1, 1, lambda w: {"y": Q.median3("x", w)}).select("i", "y")


_SMOOTH = "list_transform(x, lambda v, k: list_sort(x[greatest(k - 1, 1):least(k + 1, len(x))])[least(k + 1, len(x)) - greatest(k - 1, 1) + 1 - (least(k + 1, len(x)) - greatest(k - 1, 1) + 1) // 2 + CASE WHEN (least(k + 1, len(x)) - greatest(k - 1, 1) + 1) % 2 = 0 THEN 1 ELSE 0 END])"


@query(f"""WITH f AS ({profile(32)}), m AS (SELECT frame, x, {_SMOOTH} AS s FROM f),
    p AS (SELECT *, list_transform(range(1, 31), lambda j: list_min(s[j:j + 2])) AS w FROM m), b AS (SELECT *, greatest(list_max(w), 0) AS level FROM p),
    c AS (SELECT *, list_position(w, level) + 2 AS begin FROM b),
    e AS (SELECT *, begin + coalesce(list_position(list_transform(s[begin + 1:], lambda v: v >= level), false) - 1, len(s) - begin) AS "end" FROM c),
    r AS (SELECT *, CASE WHEN list_position(list_transform(s[begin + 1:], lambda v: v >= level), false) = 0 THEN 32 ELSE "end" END AS last1 FROM e)
    SELECT frame, CASE WHEN level >= 1e-6 THEN level ELSE 0 END AS level, CAST(CASE WHEN level >= 1e-6 THEN last1 - 1 ELSE -1 END AS INT) AS last,
      CASE WHEN level >= 1e-6 THEN last1 < 32 AND (x[32] < level * 0.1 OR (len(list_filter(x[last1 + 1:], lambda v: v >= level * 0.7)) = 0 AND x[32] < level * 0.5)) ELSE false END AS release FROM r""")
def plateau(spark, sf_dir):
    return full_frames(spark, sf_dir, 32).withColumn("p", Q.plateau(F.col("x"))).select("frame", "p.level", "p.last", "p.release")


@query(f"""WITH f AS ({profile(32)}) SELECT frame, list_transform(range(1, 32), lambda k: round(greatest(
      (list_max(x[greatest(k - 3, 0) + 1:k]) + 1e-9) / (list_max(x[k + 1:k + 3]) + 1e-9), (list_max(x[k + 1:k + 3]) + 1e-9) / (list_max(x[greatest(k - 3, 0) + 1:k]) + 1e-9)), 8)) AS score FROM f""")
def boundary_score(spark, sf_dir):
    return full_frames(spark, sf_dir, 32).select("frame", F.transform(Q.boundary_scores(F.col("x")), lambda s: sql_round(s, 8)).alias("score"))


_LEVEL = "CAST(CASE WHEN {r} <= 0.5 THEN 4 + floor(log2(floor(1 / greatest({r}, pow(2.0, -11))))) ELSE 4 - floor(log2(greatest(floor(least({r}, 16.0)), 1))) END AS INT)"


@query(f"SELECT i, {_LEVEL.format(r='(x / 40.0)')} AS level FROM ({E})")
def level_index(spark, sf_dir):
    return S.events(spark, sf_dir).select("i", Q.level_index(F.col("x") / 40.0).alias("level"))


@query(f"""WITH f AS ({profile(32)}), t AS (SELECT frame, generate_subscripts(x, 1) AS loc, unnest(x) AS x FROM f), l AS (SELECT frame, loc, {_LEVEL.format(r='(x / 40.0)')} AS level FROM t),
    d AS (SELECT *, abs(level - lag(level) OVER (PARTITION BY frame ORDER BY loc)) AS delta FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY delta DESC, loc DESC) AS n FROM d WHERE delta > 0)
    SELECT frame, CAST(loc AS INT) AS loc, level, delta FROM r WHERE n <= 6""")
def top_transitions(spark, sf_dir):
    f = full_frames(spark, sf_dir, 32).withColumn("l", F.transform("x", lambda v: Q.level_index(v / 40.0)))
    points = F.filter(F.transform("l", lambda v, i: F.struct(v.alias("level"), (i + 1).alias("loc"), F.when(i > 0, F.abs(v - F.get(F.col("l"), F.greatest(i - 1, F.lit(0))))).otherwise(0).alias("delta"))), lambda p: p["delta"] > 0)
    return f.select("frame", F.explode(Q.top_points(points)).alias("p")).select("frame", "p.loc", "p.level", "p.delta")


@query(f"""WITH t AS (SELECT i // 64 AS frame, i % 64 AS pos, x FROM ({E}) WHERE x > 40), r AS (SELECT *, pos - row_number() OVER (PARTITION BY frame ORDER BY pos) AS g FROM t),
    q AS (SELECT *, (row_number() OVER (PARTITION BY frame, g ORDER BY pos) - 1) // 7 AS part FROM r)
    SELECT frame, min(pos) AS run, count(*) AS n FROM q GROUP BY frame, g, part""")
def run_islands(spark, sf_dir):
    rows = P.block_step(S.events(spark, sf_dir), 64).where("x > 40").withColumn("pos", F.col("pos").cast("long"))
    return Q.islands(rows, ["frame"], "pos", 7).groupBy("frame", "run").agg(F.count("*").alias("n"))


@query(f"""WITH t AS (SELECT i // 64 AS frame, i % 64 AS pos, x > 30 AS f FROM ({E}) WHERE i // 64 < (SELECT count(*) // 64 FROM events)), r AS (SELECT frame, pos, pos - row_number() OVER (PARTITION BY frame ORDER BY pos) AS g FROM t WHERE f),
    q AS (SELECT frame, min(pos) AS start, count(*) AS n FROM r GROUP BY frame, g), b AS (SELECT frame, arg_max(start, n * 1000 - start) AS start, max(n) AS n FROM q GROUP BY frame), a AS (SELECT DISTINCT frame FROM t)
    SELECT a.frame, CAST(CASE WHEN coalesce(n, 0) >= 4 THEN start ELSE 0 END AS INT) AS start, CAST(CASE WHEN coalesce(n, 0) >= 4 THEN n ELSE 0 END AS INT) AS length FROM a LEFT JOIN b ON a.frame = b.frame""")
def longest_run(spark, sf_dir):
    f = full_frames(spark, sf_dir, 64)
    return f.withColumn("r", Q.longest_run(F.transform("x", lambda v: v > 30), 4)).select("frame", "r.start", "r.length")


@query(f"""WITH v AS ({V}), c AS (SELECT vec_id, i, k, round(list_sum(list_transform(x[i:i + k - 1], lambda s: abs(s))), 9) AS score FROM v, range(1, 65) AS a(i), range(1, 6) AS b(k) WHERE i + k <= 65),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, i, k) AS n FROM c) SELECT vec_id, score, CAST(i - 1 AS INT) AS start, CAST(k AS INT) AS length FROM r WHERE n = 1""")
def strongest_run(spark, sf_dir):
    return S.vectors(spark, sf_dir).withColumn("r", Q.strongest_run(F.col("x"))).select("vec_id", "r.score", "r.start", "r.length")


@query(f"""WITH s AS (SELECT vec_id, list(sf ORDER BY unit) AS s FROM ({SCALED}) GROUP BY 1) SELECT vec_id, list_transform(s, lambda v, i: CAST(CASE WHEN i = 1 THEN v & 7 ELSE (v - s[i - 1]) & 7 END AS INT)) AS d FROM s""")
def delta_code(spark, sf_dir):
    s = scaled_units(spark, sf_dir).groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("unit", "sf"))), lambda u: u["sf"]).alias("s"))
    return s.select("vec_id", Q.delta_code(F.col("s")).alias("d"))


_IDX = f"SELECT vec_id, list_sort(list_distinct(list_transform(x[1:6], lambda v: CAST(floor(abs(v) * 1000) AS INT) & 1023))) AS s FROM ({V})"


@query(f"""WITH s AS ({_IDX}), b AS (SELECT vec_id, len(s) AS n, 10 + coalesce(list_sum(list_transform(s[1:len(s) - 1], lambda v: length(bin(1023 - v)))), 0) AS a, 10 + coalesce(list_sum(list_transform(s[2:], lambda v: length(bin(v)))), 0) AS d FROM s)
    SELECT vec_id, CASE WHEN n = 1 OR a < d THEN 'asc' ELSE 'desc' END AS "order", CAST(CASE WHEN n = 1 OR a < d THEN a ELSE d END AS INT) AS bits FROM b""")
def frequency_pack(spark, sf_dir):
    idx = F.sort_array(F.array_distinct(F.transform(F.slice("x", 1, 6), lambda v: F.floor(F.abs(v) * 1000).cast("int").bitwiseAND(1023))))
    return S.vectors(spark, sf_dir).select("vec_id", idx.alias("s")).withColumn("p", Q.frequency_pack(F.col("s"))).select("vec_id", "p.order", "p.bits")


@query("""WITH RECURSIVE r AS (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events),
    e AS (SELECT user_id, i, 0.98 * 0.006 + 0.02 * x AS level FROM r WHERE i = 0 UNION ALL SELECT r.user_id, r.i, 0.98 * e.level + 0.02 * r.x FROM e JOIN r ON r.user_id = e.user_id AND r.i = e.i + 1)
    SELECT user_id, i, round(level, 7) AS level FROM e""")
def loudness_mean(spark, sf_dir):
    rows = S.table(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").alias("x"))
    rows = P.dense_index(rows, "user_id", "event_id").select(F.col("user_id").alias("track"), F.lit(0).alias("ch"), "i", "x")
    return Q.decayed(rows).select(F.col("track").alias("user_id"), "i", F.round("level", 7).alias("level"))


# --- Tones ---

_GX = [10.0 * 10 ** (k / 40) for k in range(140)]
_GY = [v / 100 for v in T.HEARING[:140]]


@query(f"""WITH g AS (SELECT unnest({values(_GX)}) AS gx, unnest({values(_GY)}) AS gy), h AS (SELECT gx, gy, lead(gx) OVER (ORDER BY gx) AS nx, lead(gy) OVER (ORDER BY gx) AS ny FROM g)
    SELECT i, round(coalesce(gy + (ny - gy) * (greatest(x, 10.0) - gx) / (nx - gx), gy), 7) AS y FROM ({E}) ASOF JOIN h ON greatest(x, 10.0) >= gx""")
def as_of_lerp(spark, sf_dir):
    return S.events(spark, sf_dir).select("i", F.round(Q.as_of(F.col("x"), _GX, _GY), 7).alias("y"))


@query(f"""SELECT vec_id, (CAST(round_even(1024 * abs(x[1]) / pi(), 0) AS INT) & 1023) | (CAST(label AS INT) << 10) AS freq_idx, CAST(round_even(32 * x[2] / (2 * pi()), 0) AS INT) & 31 AS phase_idx,
    CAST(greatest(0, len(list_filter({values(T.TONE_AMPLITUDE)}, lambda t: t <= abs(x[3]) * 1000)) - 1) AS INT) AS amp_sf FROM ({V})""")
def tone_quantisers(spark, sf_dir):
    v = S.vectors(spark, sf_dir)
    amp = F.greatest(F.lit(0), F.size(F.filter(F.lit(T.TONE_AMPLITUDE), lambda t: t <= F.abs(F.get("x", 2)) * 1000)) - 1)
    return v.select("vec_id", Q.tone_index(F.abs(F.get("x", 0)), F.col("label")).alias("freq_idx"), Q.phase_index(F.get("x", 1)).alias("phase_idx"), amp.alias("amp_sf"))


_TONES = f"SELECT DISTINCT vec_id // 20 AS frame, line // 16 AS sb, line AS freq_idx, label % 2 AS ch FROM ({LINES}) WHERE abs(c) > 0.28"


@query(f"""WITH t AS ({_TONES}), n AS (SELECT frame, count(DISTINCT sb) FILTER (ch = 0) AS a, count(DISTINCT sb) FILTER (ch = 1) AS b FROM t GROUP BY 1),
    k AS (SELECT t.frame, sb, freq_idx, ch = CASE WHEN b > a THEN 1 ELSE 0 END AS leads FROM t JOIN n USING (frame)),
    j AS (SELECT coalesce(l.frame, f.frame) AS frame, coalesce(l.sb, f.sb) AS sb, l.frame IS NOT NULL AS l, f.frame IS NOT NULL AS f FROM (SELECT * FROM k WHERE leads) l FULL JOIN (SELECT * FROM k WHERE NOT leads) f ON l.frame = f.frame AND l.sb = f.sb AND l.freq_idx = f.freq_idx)
    SELECT frame, sb, CASE WHEN NOT bool_or(f) THEN 'none' WHEN bool_and(l OR NOT f) THEN 'share' ELSE 'own' END AS follower FROM j GROUP BY 1, 2""")
def leader_follower(spark, sf_dir):
    rows = A.spectrum_rows(S.vectors(spark, sf_dir)).where(F.abs("c") > 0.28)
    t = rows.select(F.lit("vectors").alias("track"), F.floor(F.col("vec_id") / 20).alias("frame"), F.floor(F.col("line") / 16).alias("sb"), F.col("line").alias("freq_idx"), (F.col("label") % 2).alias("ch")).distinct()
    from framewright.operators.tones import leader_follower as merge

    return merge(t).drop("track")


@query(f"""WITH e AS (SELECT vec_id // 20 AS frame, line // 16 AS sb, min(line % 16) AS a, max(line % 16) + 1 AS b FROM ({LINES}) WHERE abs(c) > 0.28 GROUP BY 1, 2)
    SELECT frame, sb, CAST(a // 4 AS INT) AS start, CAST((b - 1) // 4 AS INT) AS stop, coalesce(lag(b = 16) OVER (PARTITION BY sb ORDER BY frame), false) AS opened FROM e""")
def envelope_commit(spark, sf_dir):
    from framewright.operators.tones import commit_envelopes

    rows = A.spectrum_rows(S.vectors(spark, sf_dir)).where(F.abs("c") > 0.28)
    e = rows.select(F.lit("vectors").alias("track"), F.lit(0).alias("ch"), F.floor(F.col("vec_id") / 20).alias("frame"), F.floor(F.col("line") / 16).alias("sb"), (F.col("line") % 16).alias("start"), (F.col("line") % 16 + 1).alias("stop"))
    return commit_envelopes(e, 16).drop("track", "ch")


@query(f"""SELECT vec_id, CAST(i AS INT) AS i, round(abs(x[1]) * sin(2 * pi() * ((CAST(floor(abs(x[2]) * 2048) AS INT) + CAST(floor(abs(x[3]) * 2048) AS INT) * i) % 2048) / 2048), 8) + 0.0 AS y FROM ({V}), range(0, 16) AS g(i)""")
def tone_generation(spark, sf_dir):
    from framewright.operators.tones import generate

    v = S.vectors(spark, sf_dir)
    step = lambda k: F.floor(F.abs(F.get("x", k)) * 2048).cast("int")
    wave = generate(F.abs(F.get("x", 0)), step(1), step(2), 16)
    return v.select("vec_id", F.posexplode(wave).alias("i", "y")).withColumn("y", F.round("y", 8) + 0.0)


# --- Allocation and coding ---

_TILTS = f"SELECT vec_id, coalesce(avg(sf) FILTER (band = 0) - avg(sf) FILTER (band = 1), 0) AS tilt FROM ({SCALED}) GROUP BY 1"


@query(f"""WITH s AS (SELECT vec_id, unit, band, sf, energy FROM ({SCALED})), l AS (SELECT s.*, tilt, shift FROM s JOIN ({_TILTS}) USING (vec_id), (SELECT unnest([-3.0, 0.0, 3.0, 6.0]) AS shift)),
    b AS (SELECT *, CASE WHEN band = 0 THEN 0 WHEN band = 1 THEN least(1.5, 0.3 * greatest(0, tilt - 7)) ELSE least(1.5, 0.3 * greatest(0, tilt - 7)) / 2 END AS bias FROM l),
    a AS (SELECT *, CAST(trunc(0.4::DOUBLE * sf / 3.2::DOUBLE + (1 - 0.4::DOUBLE) * ({values([float(v) for v in T.C1_FIXED_LONG])})[unit + 1] - shift + bias) AS INT) AS t FROM b)
    SELECT vec_id, CAST(shift AS DOUBLE) AS shift, CAST(sum(8 * CASE WHEN energy < ({values(T.threshold_by_unit(T.C1_WIDTHS))})[unit + 1] * 0.006 OR t < 2 THEN 0 ELSE least(t, 16) END) AS BIGINT) AS bits FROM a GROUP BY 1, 2""")
def allocation_grid(spark, sf_dir):
    s = scaled_units(spark, sf_dir)
    rows = s.join(A.tilt(s, ["vec_id"]), "vec_id").withColumn("shift", F.explode(F.lit([-3.0, 0.0, 3.0, 6.0])))
    bits = C.c1_allocation(F.col("sf"), F.col("unit"), F.col("band"), F.col("energy"), F.col("shift"), F.col("tilt"), F.lit(0.006))
    return rows.groupBy("vec_id", "shift").agg(F.sum(8 * bits).cast("long").alias("bits"))


@query(f"""WITH s AS (SELECT vec_id, unit, sf FROM ({SCALED})), t AS (SELECT *, CASE WHEN unit < 3 THEN 2.8::DOUBLE WHEN unit < 10 THEN 2.6::DOUBLE ELSE 3.3::DOUBLE END AS d, least(63.0, greatest(0.0, sf + 1.5 * log2(2.0))) AS idx FROM s)
    SELECT vec_id, unit, CAST(CASE WHEN b > 7 THEN 7 WHEN b < 0 THEN 0 WHEN b = 0 THEN 1 ELSE b END AS INT) AS bits FROM (SELECT vec_id, unit, CAST(trunc(0.4::DOUBLE * (idx / d) + (1 - 0.4::DOUBLE) * 4 - 1.0) AS INT) AS b FROM t)""")
def allocation_second_codec(spark, sf_dir):
    bits = C.c2_allocation(F.col("sf"), F.col("unit"), F.lit(4), F.lit(1.0), F.lit(0.4), F.lit(2.0))
    return scaled_units(spark, sf_dir).select("vec_id", "unit", bits.alias("bits"))


_QUANT = f"SELECT vec_id, line, CAST(round_even(c * 7.5, 0) AS BIGINT) AS q FROM ({LINES})"


@query(f"SELECT vec_id, CAST(line AS INT) AS line, q FROM ({_QUANT})")
def quantised_lines(spark, sf_dir):
    return A.spectrum_rows(S.vectors(spark, sf_dir)).select("vec_id", "line", C.quantised(F.col("c"), F.lit(7.5)).alias("q"))


@query(f"""WITH q AS (SELECT vec_id, line // 16 AS unit, q, CASE WHEN q > 0 THEN 2 * q - 1 ELSE -2 * q END AS z FROM ({_QUANT})), c AS (SELECT vec_id, unit, sum(4) AS fixed_bits, sum(CASE WHEN z = 0 THEN 1 ELSE 2 * length(bin(z)) END) AS variable_bits FROM q GROUP BY 1, 2)
    SELECT vec_id, unit, CAST(fixed_bits AS BIGINT) AS fixed_bits, CAST(variable_bits AS BIGINT) AS variable_bits, CASE WHEN fixed_bits <= variable_bits THEN 'fixed' ELSE 'variable' END AS mode FROM c""")
def cheaper_mode(spark, sf_dir):
    rows = A.spectrum_rows(S.vectors(spark, sf_dir)).select("vec_id", F.floor(F.col("line") / 16).alias("unit"), C.zigzag(C.quantised(F.col("c"), F.lit(7.5))).alias("z"))
    rows = rows.withColumn("fixed", F.lit(T.C2_CLC_BITS[5])).withColumn("variable", F.when(F.col("z") == 0, 1).otherwise(2 * F.length(F.bin("z"))))
    return A.cheaper_mode(rows, ["vec_id", "unit"], "fixed", "variable")


@query(f"""WITH q AS (SELECT vec_id, line // 16 AS unit, abs(q) AS q FROM ({_QUANT})), c AS (SELECT vec_id, unit, t, sum(1 + t + (q >> t)) AS cost FROM q, range(0, 4) AS g(t) GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id, unit ORDER BY cost, t) AS n FROM c)
    SELECT vec_id, unit, CAST(t AS INT) AS "table", CAST(cost AS BIGINT) AS cost FROM r WHERE n = 1""")
def best_table(spark, sf_dir):
    rows = A.spectrum_rows(S.vectors(spark, sf_dir)).select("vec_id", F.floor(F.col("line") / 16).alias("unit"), F.abs(C.quantised(F.col("c"), F.lit(7.5))).alias("q")).withColumn("table", F.explode(F.lit([0, 1, 2, 3])))
    costs = rows.groupBy("vec_id", "unit", "table").agg(F.sum(1 + F.col("table") + F.expr("shiftright(q, `table`)")).alias("cost"))
    return A.best_table(costs, ["vec_id", "unit"])


@query(f"""WITH q AS (SELECT vec_id, line, greatest(-1, least(1, q)) AS q FROM ({_QUANT})) SELECT a.vec_id, CAST(a.line // 2 AS INT) AS pair, CAST(({values(T.C2_PAIR_INDEX)})[3 * (a.q + 1) + b.q + 2] AS INT) AS symbol
    FROM q a JOIN q b ON a.vec_id = b.vec_id AND b.line = a.line + 1 WHERE a.line % 2 = 0""")
def pair_symbols(spark, sf_dir):
    q = F.transform("x", lambda v: F.greatest(F.lit(-1), F.least(F.lit(1), F.rint(v * 7.5).cast("int"))))
    v = S.vectors(spark, sf_dir).select("vec_id", q.alias("q"))
    symbols = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda p: C.pair_index(F.get("q", 2 * p), F.get("q", 2 * p + 1)))
    return v.select("vec_id", F.posexplode(symbols).alias("pair", "symbol"))


@query("""WITH r AS (SELECT conv_id, turn, length(coalesce(text, '')) % 23 + 1 AS bits FROM conversations)
    SELECT conv_id, turn, bits, CAST(coalesce(sum(bits) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM r""")
def bit_offsets(spark, sf_dir):
    r = S.table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length(F.coalesce("text", F.lit(""))) % 23 + 1).cast("long").alias("bits"))
    return C.bit_offsets(r, ["conv_id"], "turn", "bits")


@query("""SELECT event_id, xor(CAST(event_id AS BIGINT), 1400856835::BIGINT) AS word, CAST(event_id % 3 AS INT) AS in_packet, event_id // 3 * 3 * 1024 * 1000 // 44100 AS stamp,
    CAST(CASE WHEN event_id % 128 >= 64 THEN event_id % 128 - 128 ELSE event_id % 128 END AS INT) AS signed FROM events""".replace("1400856835", str(0x537F6103)))
def packet_words(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").select("event_id")
    i = F.col("event_id")
    return e.select("event_id", C.scrambled(i).alias("word"), (i % 3).cast("int").alias("in_packet"), F.floor(F.floor(i / 3) * 3 * 1024 * 1000 / 44100).alias("stamp"), C.sign_extended(i % 128, 7).alias("signed"))


@query(f"""WITH b AS (SELECT vec_id, list_transform({T.C1_UNIT_COUNTS}, lambda c: c) AS t, list_transform(x[1:52], lambda v: CAST(greatest(0, floor(v * 20)) AS INT)) AS bits FROM ({V})),
    l AS (SELECT *, list_max(list_transform(bits, lambda v, i: CASE WHEN v > 0 THEN i ELSE 0 END)) AS last FROM b) SELECT vec_id, CAST(len(list_filter(t[1:7], lambda c: c < last)) AS INT) AS idx FROM l""")
def units_used(spark, sf_dir):
    bits = F.transform(F.slice("x", 1, 52), lambda v: F.greatest(F.lit(0), F.floor(v * 20).cast("int")))
    return S.vectors(spark, sf_dir).select("vec_id", C.units_used(bits).alias("idx"))


@query(f"""WITH p AS (SELECT unnest({[r[0] for r in T.C2_CONTAINERS]}) AS bitrate, unnest({[r[1] for r in T.C2_CONTAINERS]}) AS frame_bytes), r AS (SELECT event_id, event_id * 997 % 393217 AS wanted FROM events),
    w AS (SELECT *, CASE WHEN wanted = 0 THEN 132300 ELSE wanted END AS need FROM r)
    SELECT event_id, wanted, (SELECT frame_bytes FROM p WHERE bitrate >= least(need, 352800) ORDER BY bitrate LIMIT 1) AS frame_bytes FROM w""")
def container_for_bitrate(spark, sf_dir):
    r = S.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 997 % 393217).alias("wanted"))
    return r.select("event_id", "wanted", F.get(F.lit([x[1] for x in T.C2_CONTAINERS]), C.container_for(F.col("wanted"))).alias("frame_bytes"))


@query(f"""WITH e AS (SELECT vec_id, sum(c * c) FILTER (line < 32) AS m, sum(c * c) FILTER (line >= 32) AS s FROM ({LINES}) GROUP BY 1) SELECT vec_id, CAST(greatest(-100, least(100, trunc(384 * (m / (m + s) - 0.5)))) AS INT) AS shift FROM e""")
def side_bytes(spark, sf_dir):
    e = F.col("c") * F.col("c")
    h = A.spectrum_rows(S.vectors(spark, sf_dir)).groupBy("vec_id").agg(F.sum(F.when(F.col("line") < 32, e)).alias("m"), F.sum(F.when(F.col("line") >= 32, e)).alias("s"))
    return h.select("vec_id", C.side_bytes(F.col("m"), F.col("s"), 384, 100).alias("shift"))


# --- Generated tables ---


@query("SELECT CAST(i AS INT) AS idx, round(pow(2.0, i / 3.0 - 21), 12) AS value FROM range(0, 64) AS g(i)")
def scale_table(spark, sf_dir):
    return T.scale_table(spark).withColumn("value", F.round("value", 12))


@query("SELECT CAST(i AS INT) AS idx, CASE WHEN i < 16 THEN pow(2.0, 4 - i) END AS level, round(pow(2.0, -(i - 15) / 8.0), 10) AS step FROM range(0, 31) AS g(i)")
def gain_tables(spark, sf_dir):
    return T.gain_tables(spark).withColumn("step", F.round("step", 10))


@query("""WITH w AS (SELECT i, sin(((i + 0.5) / 256 - 0.5) * pi()) + 1 AS a, sin(((255 - i + 0.5) / 256 - 0.5) * pi()) + 1 AS b FROM range(0, 256) AS g(i))
    SELECT CAST(i AS INT) AS i, round(a, 9) AS encode, round(2 * a / (a * a + b * b), 9) AS decode, round(sin((i + 0.5) * pi() / 512), 9) AS sine FROM w""")
def window_tables(spark, sf_dir):
    return T.windows(spark).select("i", *(F.round(c, 9).alias(c) for c in ("encode", "decode", "sine")))


@query(f"""WITH l AS (SELECT i, (i + 1) * 22050 / 512.0 AS f FROM range(0, 512) AS g(i)), c AS (SELECT i, least(29853.0, greatest(10.0, f)) AS f FROM l), k AS (SELECT i, f, 40 * log10(0.1 * f) AS t FROM c)
    SELECT CAST(i AS INT) AS line, round(0.01 * (({values(T.HEARING)})[CAST(floor(t) AS INT) + 1] * (1 + floor(t) - t) + ({values(T.HEARING)})[CAST(floor(t) AS INT) + 2] * (t - floor(t))) - 100 - f * f / 1e6 * 0.015, 7) AS db FROM k""")
def hearing_threshold(spark, sf_dir):
    f = F.least(F.lit(29853.0), F.greatest(F.lit(10.0), (F.col("id") + 1) * 22050 / 512.0))
    t = 40 * F.log10(0.1 * f)
    k = F.floor(t).cast("int")
    tab = F.lit([float(v) for v in T.HEARING])
    db = 0.01 * (F.get(tab, k) * (1 + k - t) + F.get(tab, k + 1) * (t - k)) - 100 - f * f / 1e6 * 0.015
    return spark.range(512).select(F.col("id").cast("int").alias("line"), F.round(db, 7).alias("db"))


@query("""WITH f AS (SELECT i, (i + 3) * 0.5 * 44100 / 512 AS f FROM range(0, 512) AS g(i)), t AS (SELECT i, f, log10(f) - 3.5 AS t FROM f) SELECT CAST(i AS INT) AS line, round(pow(10, 0.1 * (-10 * t * t + 3 - f / 3000)), 9) AS weight FROM t""")
def loudness_curve(spark, sf_dir):
    f = (F.col("id") + 3) * 0.5 * 44100 / 512
    t = F.log10(f) - 3.5
    return spark.range(512).select(F.col("id").cast("int").alias("line"), F.round(F.pow(F.lit(10.0), 0.1 * (-10 * t * t + 3 - f / 3000)), 9).alias("weight"))


QUERIES |= codec_queries.QUERIES | kernels.QUERIES  # frame_queries registers with codec_queries
ORACLE_SQL |= codec_queries.ORACLE_SQL | kernels.ORACLE_SQL

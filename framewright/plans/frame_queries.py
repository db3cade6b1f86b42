"""Registered queries of curve starts, tone rules and small coders, each with DuckDB SQL in another form than the operator's."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import tables as T
from framewright.operators import curve_start as U
from framewright.operators import tone_rules as R
from framewright.operators import transforms as L
from framewright.operators.framing import over_track
from framewright.plans import signals as S
from framewright.plans.codec_queries import _bands_sql, _doubles, bands, query

V, LINES = S.VECTORS_SQL, S.LINES_SQL

# --- The start of gain curves ---

#: Profiles of 32 subframes, up to two points, targets and bands, from the lines of a vector.
_CURVES = f"""v AS (SELECT vec_id, CAST(vec_id % 4 AS INT) AS band, CAST(vec_id % 3 AS INT) AS n, CAST(label % 5 AS INT) AS l1, CAST(2 + label % 5 AS INT) AS a1,
        CAST(label % 5 + 1 + vec_id % 7 AS INT) AS l2, CAST(3 + vec_id % 4 AS INT) AS a2, abs(x[33]) * 4 + 0.01 AS last_target, abs(x[34]) AS target FROM ({V})),
    g AS (SELECT vec_id, line AS s, abs(c) AS g FROM ({LINES}) WHERE line < 32),
    p AS (SELECT vec_id, 0 AS longer, a1 AS level, l1 AS loc FROM v WHERE n > 0 UNION ALL SELECT vec_id, 0, a2, l2 FROM v WHERE n > 1)"""
#: Divisors of (vec_id, longer, s) from the points p of curves c.
_DIVISORS = """q AS (SELECT *, lead(level, 1, 4) OVER (PARTITION BY vec_id, longer ORDER BY loc) AS following FROM p),
    f AS (SELECT vec_id, longer, min_by(level, loc) AS level FROM p GROUP BY 1, 2),
    m AS (SELECT c.vec_id, c.longer, r.s, max(q.loc) AS loc FROM c CROSS JOIN range(0, 32) AS r(s) LEFT JOIN q ON q.vec_id = c.vec_id AND q.longer = c.longer AND q.loc <= r.s GROUP BY 1, 2, 3),
    d AS (SELECT m.vec_id, m.longer, m.s, CASE WHEN m.loc IS NULL THEN pow(2.0, 4 - coalesce(f.level, 4)) WHEN m.loc < m.s THEN pow(2.0, 4 - q.following)
        ELSE list_sum(list_transform(range(0, 8), lambda j: pow(2.0, 4 - q.level - (q.following - q.level) * j / 8.0))) / 8 END AS d
      FROM m LEFT JOIN q ON q.vec_id = m.vec_id AND q.longer = m.longer AND q.loc = m.loc LEFT JOIN f ON f.vec_id = m.vec_id AND f.longer = m.longer)"""
#: Scores of curves from their divisors.
_SCORES = """e AS (SELECT c.vec_id, c.longer, any_value(v.target) AS target, greatest(3, coalesce(max(p.loc), 0) + 3) AS many FROM c JOIN v USING (vec_id) LEFT JOIN p ON p.vec_id = c.vec_id AND p.longer = c.longer GROUP BY 1, 2),
    w AS (SELECT d.*, g.g, e.target, lead(d.d) OVER o AS d2, lead(g.g) OVER o AS g2 FROM d JOIN e ON e.vec_id = d.vec_id AND e.longer = d.longer AND d.s < e.many JOIN g ON g.vec_id = d.vec_id AND g.s = d.s WINDOW o AS (PARTITION BY d.vec_id, d.longer ORDER BY d.s)),
    z AS (SELECT vec_id, longer, CASE WHEN any_value(target) <= 1e-9 THEN 0 ELSE avg(pow(log2(greatest(g / d, 1e-9)) - log2(target), 2))
        + 0.25 * sum(pow(log2(d2) - log2(d), 2) * (g + g2) / 2) / CASE WHEN sum((g + g2) / 2) FILTER (d2 IS NOT NULL) > 1e-9 THEN sum((g + g2) / 2) FILTER (d2 IS NOT NULL) ELSE 1 END END AS score FROM w GROUP BY 1, 2)"""


def _curves(spark, sf_dir):
    v = S.vectors(spark, sf_dir)
    point = lambda level, loc: F.struct(level.cast("int").alias("level"), loc.cast("int").alias("loc"))
    label, i = F.col("label"), F.col("vec_id")
    both = F.array(point(2 + label % 5, label % 5), point(3 + i % 4, label % 5 + 1 + i % 7))
    profile = F.transform(F.slice("x", 1, 32), lambda c: F.abs(c))
    return v.select(
        "vec_id", (i % 4).cast("int").alias("band"), F.slice(both, 1, (i % 3).cast("int")).alias("points"), profile.alias("profile"),
        (F.abs(F.get("x", 32)) * 4 + 0.01).alias("last_target"), F.abs(F.get("x", 33)).alias("target"),
    )


@query(f"WITH {_CURVES}, c AS (SELECT vec_id, 0 AS longer FROM v), {_DIVISORS} SELECT vec_id, CAST(s AS INT) AS s, round(d, 9) AS d FROM d")
def mean_divisors(spark, sf_dir):
    return _curves(spark, sf_dir).select("vec_id", F.posexplode(U.mean_divisors(F.col("points"))).alias("s", "d")).withColumn("d", F.round("d", 9))


@query(f"WITH {_CURVES}, c AS (SELECT vec_id, 0 AS longer FROM v), {_DIVISORS}, {_SCORES} SELECT vec_id, round(score, 7) AS score FROM z")
def curve_mismatch(spark, sf_dir):
    return _curves(spark, sf_dir).select("vec_id", F.round(U.early_mismatch(F.col("profile"), F.col("target"), F.col("points")), 7).alias("score"))


_FIRST_POINT = f"""WITH {_CURVES.replace("p AS (", "p0 AS (")},
    b AS (SELECT v.vec_id, avg(g) FILTER (n = 0 OR s < l1) / CASE WHEN any_value(n) = 0 THEN 1 ELSE pow(2.0, 4 - any_value(a1)) END AS start FROM v JOIN g USING (vec_id) GROUP BY 1),
    y AS (SELECT v.*, start, last_target / start AS ratio FROM v JOIN b USING (vec_id)),
    l AS (SELECT *, CAST(CASE WHEN ratio <= 0.5 THEN 4 + floor(log2(floor(1 / greatest(ratio, pow(2.0, -11))))) ELSE 4 - floor(log2(greatest(1.0, floor(least(ratio, 16.0))))) END AS INT) AS level FROM y),
    k AS (SELECT *, coalesce(band < 3 AND last_target > 1e-6 AND start > 1e-6 AND (level <> 4 OR n > 0), false) AS due FROM l),
    p AS (SELECT * FROM p0 UNION ALL SELECT vec_id, 1, p0.level, p0.loc FROM p0 UNION ALL SELECT vec_id, 1, level, 0 FROM k WHERE due),
    c AS (SELECT vec_id, 0 AS longer FROM v UNION ALL SELECT vec_id, 1 FROM v), {_DIVISORS}, {_SCORES},
    s AS (SELECT k.*, z0.score AS before, z1.score AS after, abs(CASE WHEN n = 0 THEN 0 ELSE 4 - a1 END - log2(least(16.0, greatest(ratio, pow(2.0, -11))))) AS old, abs(4 - level - log2(least(16.0, greatest(ratio, pow(2.0, -11))))) AS new
      FROM k JOIN z z0 ON z0.vec_id = k.vec_id AND z0.longer = 0 JOIN z z1 ON z1.vec_id = k.vec_id AND z1.longer = 1),
    t AS (SELECT *, CASE WHEN NOT due THEN 'none' WHEN new + 0.2 < old OR after <= before * 1.02 THEN 'kept' ELSE 'reverted' END AS verdict FROM s),
    o AS (SELECT *, [a1, a2][1:n] AS own_levels, [l1, l2][1:n] AS own_locs FROM t),
    i AS (SELECT *, verdict = 'kept' AND NOT (n > 0 AND level = a1) AS first FROM o)
    SELECT vec_id, round(start, 7) AS start, CASE WHEN due THEN level END AS level, CASE WHEN due THEN round(before, 6) END AS score_before, CASE WHEN due THEN round(after, 6) END AS score_after,
      CASE WHEN due THEN round(old, 6) END AS step_before, CASE WHEN due THEN round(new, 6) END AS step_after, verdict,
      CASE WHEN first THEN list_concat([level], own_levels) WHEN verdict <> 'kept' AND n = 2 AND l1 = 0 AND a1 = a2 THEN own_levels[2:] ELSE own_levels END AS levels,
      CASE WHEN first THEN list_concat([0], own_locs) WHEN verdict <> 'kept' AND n = 2 AND l1 = 0 AND a1 = a2 THEN own_locs[2:] ELSE own_locs END AS locs FROM i"""


@query(_FIRST_POINT)
def first_point(spark, sf_dir):
    """The point at the start of a curve, with all numbers that the decision log holds."""
    c = F.col
    found = _curves(spark, sf_dir).select("vec_id", U.with_first_point(c("profile"), c("last_target"), c("target"), c("points"), c("band")).alias("z")).select("vec_id", "z.*")
    digits = {"start": 7, "score_before": 6, "score_after": 6, "step_before": 6, "step_after": 6}
    return found.withColumns({k: F.round(k, n) for k, n in digits.items()}).select("vec_id", *digits, "level", "verdict", F.transform("points", lambda p: p["level"]).alias("levels"), F.transform("points", lambda p: p["loc"]).alias("locs"))


# --- Tones ---


@query(f"""WITH RECURSIVE c AS (SELECT vec_id, line, CAST(line % 2 AS INT) AS ch, CAST(line // 2 % 4 AS INT) AS sb, CAST(line // 2 % 4 * 1024 + floor(abs(c) * 4000) % 1024 AS INT) AS idx FROM ({LINES})),
    r AS (SELECT vec_id, line, ch, sb, idx, true AS kept, [(ch * 64 + sb) * 65536 + idx] AS held, CAST([] AS INT[]) AS closed FROM c WHERE line = 0
      UNION ALL SELECT vec_id, line, ch, sb, idx, open AND good, CASE WHEN open AND good THEN list_append(held, name * 65536 + idx) ELSE held END, CASE WHEN open AND NOT good THEN list_append(closed, name) ELSE closed END
      FROM (SELECT c.*, held, closed, c.ch * 64 + c.sb AS name, len(held) < 48 AND NOT list_contains(closed, c.ch * 64 + c.sb) AS open,
          len(list_filter(held, lambda h: h // 65536 = c.ch * 64 + c.sb)) = 0 OR len(list_filter(held, lambda h: h // 65536 = c.ch * 64 + c.sb)) < 15 AND len(list_filter(held, lambda h: h // 65536 // 64 = c.ch AND abs(h % 65536 - c.idx) < 20)) = 0 AS good
        FROM r JOIN c ON c.vec_id = r.vec_id AND c.line = r.line + 1))
    SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY line) - 1 AS INT) AS n, ch, sb, idx FROM r WHERE kept""")
def accepted_tones(spark, sf_dir):
    """Candidates from every line of a vector, four bands of two channels in turn."""
    made = F.transform("x", lambda v, i: F.struct((i % 2).alias("ch"), F.floor(i / 2 % 4).alias("sb"), (F.floor(i / 2 % 4) * 1024 + F.floor(F.abs(v) * 4000) % 1024).alias("idx")))
    return S.vectors(spark, sf_dir).select("vec_id", F.posexplode(R.accepted(made)).alias("n", "t")).select("vec_id", "n", "t.ch", "t.sb", "t.idx")


_TONES = "[{'idx': 3 + f % 200, 'scale': f % 12, 'phase': f % 32}, {'idx': 400 + f % 300, 'scale': 5, 'phase': f * 7 % 32}]"


def _tones(f):
    tone = lambda idx, scale, phase: F.struct(idx.cast("int").alias("idx"), scale.cast("int").alias("scale"), phase.cast("int").alias("phase"))
    return F.array(tone(3 + f % 200, f % 12, f % 32), tone(400 + f % 300, F.lit(5), f * 7 % 32))


@query(f"""WITH b AS ({_bands_sql(1, 128)}), t AS (SELECT frame AS f, unnest({_TONES.replace("f %", "frame %").replace("f *", "frame *")}) AS t FROM (SELECT DISTINCT frame FROM b)),
    y AS (SELECT f AS frame, p, sum(pow(2.0, (t.scale - 3) / 4.0) * sin(2 * pi() * ((t.phase * 64 + t.idx * p) % 2048) / 2048)) * (0.5 - 0.5 * cos(pi() * (p + 0.5) / 128)) AS y FROM t, range(0, 128) AS r(p) GROUP BY 1, 2
      UNION ALL SELECT f + 1, p, sum(pow(2.0, (t.scale - 3) / 4.0) * sin(2 * pi() * ((t.phase * 64 + t.idx * (p + 128)) % 2048) / 2048)) * (0.5 + 0.5 * cos(pi() * (p + 0.5) / 128)) FROM t, range(0, 128) AS r(p) GROUP BY 1, 2)
    SELECT b.frame, CAST(b.p AS INT) AS p, round(any_value(x) - sum(y), 6) + 0.0 AS x FROM b JOIN y ON y.frame = b.frame AND y.p = b.p GROUP BY 1, 2""")
def tone_residual(spark, sf_dir):
    """Event frames less two tones each, which fade over from frame to frame."""
    rows = bands(spark, sf_dir, 1, 128).withColumn("i", F.col("frame")).withColumn("now", _tones(F.col("frame")))
    rows = over_track(rows, 1, 0, lambda w: {"before": F.coalesce(F.lag("now").over(w), F.slice("now", 1, 0))}, 1024)
    out = R.without_tones(F.col("x"), F.col("before"), F.col("now"), 128)
    return rows.select("frame", F.posexplode(out).alias("p", "x")).withColumn("x", F.round("x", 6) + 0.0)


#: Tones in some subbands of some frames.
_BAND_TONES = "SELECT ch AS sb, frame, 5 + (frame * 3 + ch) % 900 AS idx, frame % 12 AS scale, (frame + ch) % 32 AS phase FROM (SELECT DISTINCT ch, frame FROM b) WHERE (frame + ch) % 3 = 0"


@query(f"""WITH b AS ({_bands_sql(8, 128)}), t AS ({_BAND_TONES}),
    y AS (SELECT sb, frame, p, pow(2.0, (scale - 3) / 4.0) * sin(2 * pi() * ((phase * 64 + idx * p) % 2048) / 2048) * (0.5 - 0.5 * cos(pi() * (p + 0.5) / 128)) AS y FROM t, range(0, 128) AS r(p)
      UNION ALL SELECT sb, frame + 1, p, pow(2.0, (scale - 3) / 4.0) * sin(2 * pi() * ((phase * 64 + idx * (p + 128)) % 2048) / 2048) * (0.5 + 0.5 * cos(pi() * (p + 0.5) / 128)) FROM t, range(0, 128) AS r(p))
    SELECT CAST(b.ch AS INT) AS sb, b.frame, CAST(b.p AS INT) AS p, round(any_value(x) - coalesce(sum(y), 0), 6) + 0.0 AS x FROM b LEFT JOIN y ON y.sb = b.ch AND y.frame = b.frame AND y.p = b.p GROUP BY 1, 2, 3""")
def tone_filter(spark, sf_dir):
    """Eight bands less the tones that some of their frames have."""
    rows = bands(spark, sf_dir, 8, 128).withColumnRenamed("ch", "sb").withColumn("ch", F.lit(0))
    n, c = F.col("frame"), F.col("sb")
    tones = rows.where((n + c) % 3 == 0).select("track", "ch", "sb", "frame", (5 + (n * 3 + c) % 900).cast("int").alias("idx"), (n % 12).cast("int").alias("scale"), ((n + c) % 32).cast("int").alias("phase"))
    return R.filtered(rows, tones, 128).select("sb", "frame", F.posexplode("x").alias("p", "x")).withColumn("x", F.round("x", 6) + 0.0)


@query(f"""WITH h AS (SELECT unnest({_doubles(L.polyphase_prototype().tolist())}) AS h, unnest(range(0, 384)) AS t),
    f AS (SELECT band, t, 2 * h * cos(pi() / 16 * (band + 0.5) * (t - 191.5) + CASE WHEN band % 2 = 0 THEN 1 ELSE -1 END * pi() / 4) AS f FROM h, range(0, 16) AS r(band)),
    y AS (SELECT k, band, pi() * (k + 0.5) / 1024 AS w, sum(f * sin(pi() * (k + 0.5) / 1024 * (15 - t))) AS y0, sum(f * sin(pi() * (k + 0.5) / 1024 * (31 - t))) AS y1 FROM f, range(0, 1024) AS r(k) GROUP BY 1, 2),
    o AS (SELECT *, acos(cos(16 * w)) AS v FROM y)
    SELECT CAST(k AS INT) AS k, CAST(band AS INT) AS band, round(v, 7) AS frequency, round(y0, 6) + 0.0 AS at_0, round(y1, 6) + 0.0 AS at_1 FROM o""")
def bank_response(spark, sf_dir):
    """The response table as the first two samples of its sines; the SQL filters the input's sines."""
    rows = L.polyphase_response(spark)
    at = lambda n: F.round(F.col("magnitude") * F.sin(F.col("frequency") * n + F.col("phase")), 6) + 0.0
    return rows.select("k", "band", F.round("frequency", 7).alias("frequency"), at(0).alias("at_0"), at(1).alias("at_1"))


@query(f"""WITH t AS (SELECT vec_id, line, c, 2 + vec_id % 40 AS idx, vec_id % 32 AS phase FROM ({LINES}))
    SELECT vec_id, sum(pow(c - pow(2.0, -5) * sin(2 * pi() * ((phase * 64 + idx * line) % 2048) / 2048), 2)) < sum(c * c) AS goes_on FROM t GROUP BY 1""")
def tones_go_on(spark, sf_dir):
    """A faint tone before a vector's 64 samples."""
    i = F.col("vec_id")
    tone = F.struct((2 + i % 40).cast("int").alias("idx"), F.lit(-17).alias("scale"), (i % 32).cast("int").alias("phase"))
    return S.vectors(spark, sf_dir).select("vec_id", R.goes_on(F.col("x"), F.array(tone), 64).alias("goes_on"))


@query(f"SELECT vec_id, x[1] + 2 AS frequency, x[3] + CASE WHEN label % 2 = 1 THEN -x[2] ELSE x[2] END AS phase, abs(x[4]) * abs(x[5]) AS magnitude FROM ({V})")
def tone_projection(spark, sf_dir):
    x = lambda k: F.get("x", k - 1)
    response = F.struct((x(1) + 2).alias("frequency"), x(3).alias("phase"), F.abs(x(5)).alias("magnitude"))
    return S.vectors(spark, sf_dir).select("vec_id", R.projected(F.col("label"), x(2), F.abs(x(4)), response).alias("p")).select("vec_id", "p.*")


@query(f"""WITH t AS (SELECT vec_id, label, line // 2 AS k, line // 2 * 30 + max(CASE WHEN line % 2 = 0 THEN CAST(floor(abs(c) * 60) AS INT) END) AS idx, max(CASE WHEN line % 2 = 1 THEN abs(c) + 0.04 END) AS m FROM ({LINES}) WHERE line < 6 GROUP BY 1, 2, 3)
    SELECT vec_id, count(DISTINCT idx) = 3 AND max(abs(idx - k * 30 - 8)) <= 40 AND max(greatest(m / 0.1, 0.1 / m)) <= 4 AND any_value(label % 3) < 2 AS holds FROM t GROUP BY 1""")
def tone_refit_rule(spark, sf_dir):
    tone = lambda idx, m: F.struct(idx.cast("int").alias("idx"), m.alias("magnitude"))
    refined = F.array_sort(F.array(*(tone(k * 30 + F.floor(F.abs(F.get("x", 2 * k)) * 60), F.abs(F.get("x", 2 * k + 1)) + 0.04) for k in range(3))))
    first = F.array(*(tone(F.lit(k * 30 + 8), F.lit(0.1)) for k in range(3)))
    return S.vectors(spark, sf_dir).select("vec_id", R.refit_holds(refined, first, (F.col("label") % 3).cast("double"), F.lit(2.0)).alias("holds"))


@query(f"""WITH RECURSIVE t AS (SELECT vec_id, CAST(greatest(2, least(7, line // 32 + 4)) AS INT) AS quant, CAST(1 + vec_id % 7 AS INT) AS length, CAST(line * 5 AS INT) AS pos, row_number() OVER (PARTITION BY vec_id, line // 32 ORDER BY line) - 1 AS k FROM ({LINES}) WHERE abs(c) > 0.02),
    r AS (SELECT *, pos - pos % 64 AS base, 0 AS run, true AS begins FROM t WHERE k = 0
      UNION ALL SELECT t.*, CASE WHEN t.pos - r.base < 64 AND r.run < 6 THEN r.base ELSE t.pos - t.pos % 64 END, CASE WHEN t.pos - r.base < 64 AND r.run < 6 THEN r.run + 1 ELSE 0 END, t.pos - r.base < 64 AND r.run = 6
      FROM r JOIN t ON t.vec_id = r.vec_id AND t.quant = r.quant AND t.k = r.k + 1)
    SELECT vec_id, quant, length, list(pos ORDER BY k) AS positions, list(CAST(k AS INT) ORDER BY k) FILTER (begins) AS starts FROM r GROUP BY 1, 2, 3""")
def tonal_sub_groups(spark, sf_dir):
    lines = S.vectors(spark, sf_dir).select("vec_id", F.posexplode("x").alias("line", "c")).where("abs(c) > 0.02")
    tones = lines.select("vec_id", F.floor(F.col("line") / 32).cast("int").alias("bits"), (1 + F.col("vec_id") % 7).cast("int").alias("length"), (F.col("line") * 5).cast("int").alias("pos"))
    return R.tonal_groups(tones, ["vec_id"])


# --- Coders ---


@query(f"SELECT vec_id, '00' || string_agg(lpad(bin(CAST(floor(abs(c) * 100) AS INT) & 63), 6, '0'), '' ORDER BY line) AS bits FROM ({LINES}) WHERE line < 32 GROUP BY 1")
def scale_index_bits(spark, sf_dir):
    scales = F.transform(F.slice("x", 1, 32), lambda v: F.floor(F.abs(v) * 100).cast("int").bitwiseAND(63))
    return S.vectors(spark, sf_dir).select("vec_id", R.scale_bits(scales).alias("bits"))


_SMALL = f"SELECT vec_id, line, CAST(greatest(-3, least(3, round_even(c * 10, 0))) AS INT) AS q FROM ({LINES})"


@query(f"""WITH q AS ({_SMALL}), a AS (SELECT vec_id, line // 4 AS n, CAST(sum(abs(q) * (1 << (line % 4 * 2))) AS INT) AS symbol, coalesce(string_agg(CASE WHEN q < 0 THEN '1' ELSE '0' END, '' ORDER BY line) FILTER (q <> 0), '') AS signs FROM q GROUP BY 1, 2),
    b AS (SELECT vec_id, line // 2 AS n, CAST(sum((q & 7) * (1 << (line % 2 * 3))) AS INT) AS symbol FROM q GROUP BY 1, 2)
    SELECT vec_id, list(symbol ORDER BY n) AS quads, string_agg(signs, ' ' ORDER BY n) AS signs, (SELECT list(symbol ORDER BY n) FROM b WHERE b.vec_id = a.vec_id) AS pairs FROM a GROUP BY 1""")
def spectral_symbols(spark, sf_dir):
    """Four magnitudes a symbol with signs behind, and two signed values a symbol."""
    q = F.transform("x", lambda v: F.greatest(F.lit(-3), F.least(F.lit(3), F.rint(v * 10))).cast("int"))
    quads, pairs = R.spectral_symbols(F.col("q"), 4, 2, False), R.spectral_symbols(F.col("q"), 2, 3, True)
    rows = S.vectors(spark, sf_dir).select("vec_id", q.alias("q")).select("vec_id", quads.alias("a"), pairs.alias("b"))
    return rows.select("vec_id", F.col("a.symbol").alias("quads"), F.array_join("a.signs", " ").alias("signs"), F.col("b.symbol").alias("pairs"))


_STEPS = [1 / m for m in T.C3_MANTISSA[1:]]


@query(f"SELECT vec_id, CAST(n AS INT) AS word_length, list(CAST(round_even(c * ({_doubles(_STEPS)})[n], 0) AS INT) ORDER BY line) AS q FROM ({LINES}), range(1, 8) AS r(n) GROUP BY 1, 2")
def all_word_lengths(spark, sf_dir):
    """Every vector at all seven word lengths, for coders that compare them."""
    v = S.vectors(spark, sf_dir).select("vec_id", F.posexplode(R.all_word_lengths(F.col("x"), _STEPS)).alias("n", "q"))
    return v.select("vec_id", (F.col("n") + 1).alias("word_length"), "q")

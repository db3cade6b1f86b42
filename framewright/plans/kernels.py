"""Registered queries of operators that SQL does not express: codec, gain curves, tones, filter banks, containers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import framing as P
from framewright.operators import gain as G
from framewright.operators import stats as A
from framewright.operators import tones as N
from framewright.operators import transforms as L
from framewright.plans import codec as K
from framewright.plans import codec2 as K2
from framewright.plans import signals as S
from framewright.sources import containers as B

FULL_SCALE = 600.0


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.events(spark, sf_dir).withColumn("x", F.col("x") / FULL_SCALE)


def codec_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of the first codec of the event values."""
    return K.encode(_scaled(spark, sf_dir))


def codec_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded and decoded again."""
    return K.decode(K.encode(_scaled(spark, sf_dir)))


def codec2_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound units of the second codec of the event values."""
    return K2.encode(_scaled(spark, sf_dir))


def profiles(signal: DataFrame) -> DataFrame:
    """(track, ch, frame, level, low, high): frames of 256 samples as 32 subframes; a frame without all of them is left out."""
    q = A.inner_quartiles(signal, 256, 8)
    ordered = F.array_sort(F.collect_list(F.struct("sub", "level", "low", "high")))
    rows = q.groupBy("track", "ch", "frame").agg(ordered.alias("s")).where(F.size("s") == 32)
    return rows.select("track", "ch", "frame", *(F.col(f"s.{c}").alias(c) for c in ("level", "low", "high")))


def gain_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain points of frames of 256 samples with 32 subframes."""
    return G.curves(profiles(S.events(spark, sf_dir)))


def gain_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What decides on the gain points of the same frames, the point at 0 among them."""
    return G.decisions(profiles(S.events(spark, sf_dir)), F.lit(0))


def tone_pursuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sinusoids of every vector: as many as the search finds above its gate, 48 at most."""
    v = S.vectors(spark, sf_dir)
    return N.tone_frames(v.select(F.col("label").cast("string").alias("track"), F.lit(0).alias("ch"), F.col("vec_id").alias("frame"), "x"))


def upsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors at eight times the rate without their low end."""
    u = S.vectors(spark, sf_dir).select("vec_id", L.upsample(F.col("x"), 64.0, 4.0).alias("u"))
    return u.select("vec_id", F.transform("u.signal", lambda v: F.round(v, 6) + 0.0).alias("signal"), F.round("u.ratio", 8).alias("ratio"))


def polyphase_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen subbands of the event values: blocks with the prototype's length as history."""
    hop, size = 16, 16384
    cut = P.with_halo(_scaled(spark, sf_dir), 384, 0, size)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        first = max(0, block * size - 384)
        last = int(pdf["i"].max())
        if last < block * size:
            return pd.DataFrame({"band": [], "n": [], "y": []})
        x = np.zeros(-(-(last + 1 - first) // hop) * hop)
        x[pdf["i"].to_numpy() - first] = pdf["x"].to_numpy()
        y = L.polyphase_split(x)[:, (block * size - first) // hop :]
        n = np.arange(y.shape[1]) + block * size // hop
        return pd.DataFrame({"band": np.repeat(np.arange(16), len(n)), "n": np.tile(n, 16), "y": y.reshape(-1)})

    return cut.groupBy("track", "ch", "block").applyInPandas(run, "band int, n long, y double").withColumn("y", F.round("y", 7) + 0.0)


def container_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded frames as one AEA file a track, read back into frames."""
    files = B.assemble(K.encode(_scaled(spark, sf_dir)), lambda f: B.aea_bytes(f, 1, "events"))

    def back(batches):
        for pdf in batches:
            for track, content in zip(pdf["track"], pdf["content"], strict=True):
                channels, title, frames = B.parse_aea(content)
                yield pd.DataFrame({"track": track, "channels": channels, "title": title, "n": range(len(frames)), "payload": frames})

    return files.mapInPandas(back, "track string, channels int, title string, n long, payload binary")


QUERIES = {f.__name__: f for f in (codec_encode, codec_decode, codec2_encode, gain_curves, gain_decisions, tone_pursuit, upsampled, polyphase_bands, container_round_trip)}

_TAPER = "CASE WHEN least(line, 63 - line) = 0 THEN 0 WHEN least(line, 63 - line) >= 9 THEN 1 ELSE 1 / (1 + exp(9.0 / least(line, 63 - line) - 9.0 / (9 - least(line, 63 - line)))) END"

#: DuckDB SQL of those that are sums; tests compare the others with plain Python.
ORACLE_SQL = {
    "upsampled": f"""
        WITH w AS (SELECT vec_id, line, c * ({_TAPER}) AS c FROM ({S.LINES_SQL})),
        s AS (SELECT vec_id, k, sum(c * cos(2 * pi() * k * line / 64)) AS a, sum(c * sin(2 * pi() * k * line / 64)) AS b FROM w, range(0, 33) AS r(k) GROUP BY 1, 2),
        g AS (SELECT vec_id, k, a, b, CASE WHEN k = 0 THEN 0 ELSE 0.5 - 0.5 * cos(pi() * least(1.0, greatest(0.0, (k - 4 + 1.5) / 3))) END AS g FROM s),
        y AS (SELECT vec_id, t, sum(2 * g * (a * cos(2 * pi() * k * t / 512) + b * sin(2 * pi() * k * t / 512))) / 64 AS y FROM g, range(0, 512) AS r(t) GROUP BY 1, 2),
        r AS (SELECT vec_id, round(sum((a * a + b * b) * g * g) / sum(a * a + b * b), 8) AS ratio FROM g GROUP BY 1)
        SELECT y.vec_id, list(round(y, 6) + 0.0 ORDER BY t) AS signal, any_value(ratio) AS ratio FROM y JOIN r USING (vec_id) GROUP BY 1""",
    "polyphase_bands": f"""
        WITH p AS (SELECT unnest([{", ".join(f"{v!r}::DOUBLE" for v in L.polyphase_prototype().tolist())}]) AS h, unnest(range(0, 384)) AS t),
        f AS (SELECT band, t, 2 * h * cos(pi() / 16 * (band + 0.5) * (t - 191.5) + CASE WHEN band % 2 = 0 THEN 1 ELSE -1 END * pi() / 4) AS f FROM p, range(0, 16) AS r(band)),
        x AS (SELECT event_id AS i, value / {FULL_SCALE} AS x FROM events)
        SELECT CAST(band AS INT) AS band, n, round(sum(f * coalesce(x, 0)), 7) + 0.0 AS y
        FROM f CROSS JOIN (SELECT DISTINCT i // 16 AS n FROM x) h LEFT JOIN x ON x.i = n * 16 + 15 - t GROUP BY band, n""",
}

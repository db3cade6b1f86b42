"""Framing and sequence operators on small signals, and the streaming twins."""

import math

from pyspark.sql import functions as F

from framewright.operators import framing as P
from framewright.operators import sequence as Q
from framewright.streaming import frames as R


def signal(spark, values):
    return spark.createDataFrame([("t", 0, i, float(v)) for i, v in enumerate(values)], "track string, ch int, i long, x double")


def test_short_last_frame_is_zero(spark):
    got = P.frames(signal(spark, range(10)), 8).orderBy("frame").collect()
    assert got[1].x == [8.0, 9.0] + [0.0] * 6


def test_blocks_equal_the_whole(spark):
    s = signal(spark, [math.sin(i) for i in range(200)])
    small = P.over_track(s, 5, 3, lambda w: {"y": F.sum("x").over(w.rowsBetween(-5, 3))}, 16).orderBy("i").collect()
    whole = P.over_track(s, 5, 3, lambda w: {"y": F.sum("x").over(w.rowsBetween(-5, 3))}, 1000).orderBy("i").collect()
    assert [round(r.y, 9) for r in small] == [round(r.y, 9) for r in whole] and len(small) == 200


def test_level_index_of_known_ratios(spark):
    cases = {1.0: 4, 1.9: 4, 2.0: 3, 4.0: 2, 16.0: 0, 100.0: 0, 0.5: 5, 0.26: 5, 0.25: 6, 0.1: 7, 0.00001: 15, 0.51: 4, 8.5: 1}
    df = spark.createDataFrame([(k,) for k in cases], "r double").select("r", Q.level_index(F.col("r")).alias("l"))
    assert {r.r: r.l for r in df.collect()} == cases


def test_silence_and_sound(spark):
    got = [r.transient for r in Q.rise_and_fall(signal(spark, [0, 0, 5, 5, 0, 0])).orderBy("i").collect()]
    assert got == [True, False, True, False, True, False]


def test_steady_profile_has_no_curve(spark):
    row = spark.range(1).select(F.array(*[F.lit(1.0)] * 32).alias("p"))
    got = row.select(Q.gain_curve(F.col("p"), F.col("p"), F.col("p"), F.lit(1.0), F.lit(1.0), F.lit(1.5)).alias("c")).first().c
    assert got == []


def test_attack_gets_a_point(spark):
    row = spark.range(1).select(F.array(*[F.lit(0.05)] * 16, *[F.lit(1.0)] * 16).alias("p"))
    got = row.select(Q.gain_curve(F.col("p"), F.col("p"), F.col("p"), F.lit(0.05), F.lit(0.05), F.lit(1.5)).alias("c")).first().c
    assert [(p.level, p.loc) for p in got] == [(8, 16)]


def test_exponential_mean_over_blocks(spark):
    values = [abs(math.sin(i)) for i in range(300)]
    want, level = [], 0.006
    for v in values:
        level = 0.98 * level + 0.02 * v
        want.append(level)
    got = [r.level for r in Q.decayed(signal(spark, values), reach=250, size=100).orderBy("i").collect()]
    assert max(abs(a - b) for a, b in zip(got, want, strict=True)) < 0.98**250


def test_streaming_equals_batch(spark, sf_dir, tmp_path):
    from framewright.plans import signals as S

    S.events(spark, sf_dir).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("track string, ch int, i long, x double").parquet(str(tmp_path / "in"))
    for name, df in (("levels", R.frame_levels(stream)), ("ahead", R.look_ahead(stream))):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    batch = {r.frame: r.energy for r in P.block_step(S.events(spark, sf_dir), 64).groupBy("frame").agg(F.sum(F.col("x") * F.col("x")).alias("energy"), F.count("*").alias("n")).where("n = 64").collect()}
    got = {r.frame: r.energy for r in spark.table("levels").collect()}
    assert got.keys() == batch.keys() and all(abs(got[k] - batch[k]) < 1e-6 for k in got)
    assert spark.table("ahead").count() == len(batch) - 1


def test_streaming_passes_lost_samples():
    """A frame that lacks a sample comes out once later frames have come; the rest stays bounded."""
    import pandas as pd

    numbers = [k for k in range(400) if k not in (17, 18)]
    batch = pd.DataFrame({"i": numbers, "x": [float(k) for k in numbers]})
    rows = R._held(b"", iter([batch.iloc[200:], batch.iloc[:220]]), 0)
    frames, rest = R._frames(rows, 0, 16, 4)
    assert len(frames) == 25 and not len(rest) and frames[1].tolist() == [16.0, 0.0, 0.0, *map(float, range(19, 32))]
    early, rest = R._frames(rows[rows["i"] < 90], 0, 16, 4)
    assert len(early) == 1 and len(rest) == 90 - 16 - 2
    frames, rest = R._frames(R._held(rest.tobytes(), iter([batch.iloc[88:100]]), 16), 1, 16, 4)
    assert [f[-1] for f in frames] == [31.0, 47.0, 63.0, 79.0, 95.0] and len(rest) == 6

"""Sinusoids: search, joint refit, merging of channels, envelopes, synthesis."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators.framing import dense_index, over_track


def _best_fits(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For signals (r, n) and frequencies (r, m): how much of the energy a sinusoid of that frequency takes, and its sine and cosine parts."""
    angle = w[:, :, None] * np.arange(x.shape[1])
    s, c = np.sin(angle), np.cos(angle)
    ss, cc, sc = (np.einsum("rmn,rmn->rm", a, b) for a, b in ((s, s), (c, c), (s, c)))
    xs, xc = np.einsum("rmn,rn->rm", s, x), np.einsum("rmn,rn->rm", c, x)
    det = ss * cc - sc * sc
    alone = det <= 1e-12 * np.maximum(ss, cc) ** 2  # at half the rate the sine vanishes
    det = np.where(alone, 1.0, det)
    a = np.where(alone, np.where(ss > cc, xs / np.maximum(ss, 1e-300), 0.0), (xs * cc - xc * sc) / det)
    b = np.where(alone, np.where(ss > cc, 0.0, xc / np.maximum(cc, 1e-300)), (xc * ss - xs * sc) / det)
    return a * xs + b * xc, a, b


def strongest(x: np.ndarray, steps: int = 8) -> np.ndarray:
    """(angular frequency, phase, magnitude) of the strongest sinusoid sin(w n + p) of each row of ``x``: the Fourier peak, then a search that halves its width.

    Each step fits five frequencies about the best one by least squares.
    """
    n = x.shape[1]
    spectrum = np.abs(np.fft.rfft(x * np.hanning(n), 4 * n))
    spectrum[:, :4] = 0
    w, width, row = math.pi * 2 * spectrum.argmax(1) / (4 * n), math.pi / (2 * n), np.arange(len(x))
    for _ in range(steps):
        tried = w[:, None] + np.array([-1, -0.5, 0, 0.5, 1]) * width
        taken, a, b = _best_fits(x, tried)
        k = taken.argmax(1)
        w, sine, cosine = tried[row, k], a[row, k], b[row, k]
        width /= 2
    phase = np.arctan2(cosine, sine)
    beyond = w > math.pi  # the same sinusoid is one below half the rate
    phase = np.where(beyond, math.pi - phase, phase) % (2 * math.pi)
    return np.stack([np.where(beyond, 2 * math.pi - w, w), phase, np.hypot(sine, cosine)], 1)


def residual(x: np.ndarray, frequencies: list[float]) -> tuple[float, list[tuple[float, float]]]:
    """Squared error of the best fit of sinusoids of given frequencies, and their (phase, magnitude)."""
    t = np.arange(len(x))
    basis = np.concatenate([[np.sin(w * t), np.cos(w * t)] for w in frequencies])
    fit, *_ = np.linalg.lstsq(basis.T, x, rcond=None)
    error = float(((x - fit @ basis) ** 2).sum())
    return error, [(float(np.arctan2(c, s)) % (2 * math.pi), float(np.hypot(s, c))) for s, c in fit.reshape(-1, 2)]


def refit(x: np.ndarray, frequencies: list[float], rounds: int = 4) -> list[tuple[float, float, float]]:
    """Frequencies moved one after the other to where the joint fit is best."""
    ws, width = list(frequencies), math.pi / (4 * len(x))
    for _ in range(rounds):
        for k in range(len(ws)):
            ws[k] = min((ws[k] + d * width for d in (-1, -0.5, 0, 0.5, 1)), key=lambda v, k=k: residual(x, ws[:k] + [v] + ws[k + 1 :])[0])
        width /= 2
    return [(w, *pm) for w, pm in zip(ws, residual(x, ws)[1], strict=True)]


def pursuits(x: np.ndarray, most: int = 48, gate: float = 0.02) -> list[list[tuple[float, float, float]]]:
    """Matching pursuit on each row of ``x``: the strongest sinusoid is fitted and taken away until nothing above ``gate`` of the first is left, or there are ``most``.

    All rows that still have something go through a round together.
    """
    rest, t = np.array(x, float), np.arange(x.shape[1])
    found: list[list[tuple[float, float, float]]] = [[] for _ in range(len(rest))]
    first = np.zeros(len(rest))
    open_ = np.arange(len(rest))
    for k in range(most):
        open_ = open_[rest[open_].any(1)]
        if not len(open_):
            break
        tones = strongest(rest[open_])
        if k == 0:
            first[open_] = tones[:, 2]
        good = np.isfinite(tones[:, 2]) & (tones[:, 2] >= gate * first[open_])
        open_, tones = open_[good], tones[good]
        rest[open_] -= tones[:, 2:] * np.sin(tones[:, :1] * t + tones[:, 1:2])
        for r, tone in zip(open_.tolist(), tones.tolist(), strict=True):
            found[r].append(tuple(tone))
    return found


def pursuit(x: np.ndarray, most: int = 48, gate: float = 0.02) -> list[tuple[float, float, float]]:
    """The tones of one signal."""
    return pursuits(np.asarray(x, float)[None], most, gate)[0]


def generate(amplitude: Column, start: Column, step: Column, n: int) -> Column:
    """n samples of a tone from a table of 2048 steps a turn."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: amplitude * F.sin(2 * math.pi * F.pmod(start + step * i, F.lit(2048)) / 2048))


def synthesise(tones: list[tuple[int, int, int]], n: int = 128, fade_in: bool = False, fade_out: bool = False) -> np.ndarray:
    """Sum of (index, scale index, phase index) tones, with 4-sample fades."""
    t = np.arange(n)
    out = np.zeros(n)
    for index, scale, phase in tones:
        out += 2.0 ** ((scale - 3) / 4) * np.sin(2 * np.pi * ((phase << 6) + index * t % 2048) / 2048)
    ramp = np.ones(n)
    if fade_in:
        ramp[:4] = (np.arange(4) + 0.5) / 4
    if fade_out:
        ramp[-4:] = ramp[-4:] * (np.arange(4)[::-1] + 0.5) / 4
    return out * ramp


def crossfade(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """From the previous frame's tones to this frame's, by a Hann slope."""
    w = 0.5 - 0.5 * np.cos(np.pi * (np.arange(len(after)) + 0.5) / len(after))
    return before * (1 - w) + after * w


def tone_frames(frames: DataFrame, x: str = "x", most: int = 48) -> DataFrame:
    """(track, ch, frame, tone, frequency, phase, magnitude) by matching pursuit on every frame; frames without tones give no rows.

    Frames of equal length are searched side by side, as many as keep the work arrays at some 20 MB.
    """
    import pandas as pd

    def run(batches):
        for pdf in batches:
            for n, same in pdf.groupby(pdf[x].map(len), sort=False):
                size = max(1, (1 << 18) // (5 * max(1, int(n))))
                for at in range(0, len(same) if n else 0, size):
                    part = same.iloc[at : at + size]
                    tones = pursuits(np.stack(part[x].to_numpy()), most)
                    rows = [(t, c, f, k, *tone) for t, c, f, own in zip(part["track"], part["ch"], part["frame"], tones, strict=True) for k, tone in enumerate(own)]
                    yield pd.DataFrame(rows, columns=["track", "ch", "frame", "tone", "frequency", "phase", "magnitude"])

    return frames.select("track", "ch", "frame", x).mapInPandas(run, "track string, ch int, frame long, tone int, frequency double, phase double, magnitude double")


def leader_follower(tones: DataFrame) -> DataFrame:
    """(track, frame, sb, follower) of tones (track, frame, sb, freq_idx, ch): the channel with tones in more bands leads (channel 0 on a tie).

    In a band the follower has none, shares the leader's (if all its tones are among them), or has its own.
    """
    by = ["track", "frame"]
    counts = tones.groupBy(*by).agg(*(F.count_distinct(F.when(F.col("ch") == c, F.col("sb"))).alias(n) for c, n in ((0, "a"), (1, "b"))))
    keyed = tones.join(counts, by).withColumn("leads", F.col("ch") == F.when(F.col("b") > F.col("a"), 1).otherwise(0))
    sides = keyed.groupBy(*by, "sb", "freq_idx").agg(F.bool_or("leads").alias("l"), F.bool_or(~F.col("leads")).alias("f"))
    kind = F.when(~F.bool_or("f"), "none").when(F.bool_and(F.col("l") | ~F.col("f")), "share").otherwise("own")
    return sides.groupBy(*by, "sb").agg(kind.alias("follower"))


def commit_envelopes(parts: DataFrame, length: int) -> DataFrame:
    """(track, ch, frame, sb, start, stop, opened) of tones' envelopes (track, ch, frame, sb, start, stop): their union in steps of 4, and whether the band's last frame with tones ran to its end.

    Frames of a band are numbered without gaps first, so that the last one with tones is
    the one before, and the lag stays within blocks.
    """
    by = ["track", "ch", "sb"]
    whole = parts.groupBy(*by, "frame").agg(F.min("start").alias("a"), F.max("stop").alias("b"))
    numbered = dense_index(whole.withColumn("part", F.struct(*by)), "part", "frame").withColumn("series", F.to_json(F.struct("track", "sb")))
    rows = over_track(numbered.withColumnRenamed("track", "name").withColumnRenamed("series", "track"), 1, 0, lambda w: {"opened": F.coalesce(F.lag(F.col("b") == length).over(w), F.lit(False))})
    return rows.select(F.col("name").alias("track"), "ch", "frame", "sb", F.floor(F.col("a") / 4).cast("int").alias("start"), F.floor((F.col("b") - 1) / 4).cast("int").alias("stop"), "opened")

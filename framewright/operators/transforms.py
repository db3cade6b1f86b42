"""Filters and transforms.

Each transform has a kernel form (numpy matrix products over Arrow batches, no shuffle:
what production uses) and, where it is declarative, a join form over a basis table for
cross-checks on small inputs.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import tables as T
from framewright.operators.framing import with_halo


@lru_cache(16)
def mdct_basis(n: int) -> np.ndarray:
    """(n/2, n) cosines of the modified discrete cosine transform of n samples."""
    k, t = np.arange(n // 2)[:, None], np.arange(n)[None, :]
    return np.cos(2 * np.pi / n * (t + 0.5 + n / 4) * (k + 0.5))


@lru_cache(16)
def dct4_basis(n: int) -> np.ndarray:
    k, t = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi / n * (t + 0.5) * (k + 0.5))


def _on_arrays(make: Callable[[], Callable[[np.ndarray], np.ndarray]], x: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(batch: pd.Series) -> pd.Series:
        if not len(batch):
            return pd.Series([], dtype=object)
        return pd.Series(list(make()(np.stack(batch.to_numpy()).astype(np.float64))))

    return run(x)


def mdct(x: Column, n: int, scale: float = 1.0) -> Column:
    """n samples -> n/2 coefficients. Arrays shorter than n must be padded first."""
    return _on_arrays(lambda: lambda m: m @ mdct_basis(n).T * scale, x)


def imdct(x: Column, n: int, scale: float = 1.0) -> Column:
    """n/2 coefficients -> n samples, to be overlapped and added."""
    return _on_arrays(lambda: lambda m: m @ mdct_basis(n) * scale, x)


def dct4(x: Column, n: int) -> Column:
    """The transform that is its own inverse up to 2/n."""
    return _on_arrays(lambda: lambda m: m @ dct4_basis(n).T, x)


def power_spectrum(x: Column) -> Column:
    """Squared magnitudes of the real Fourier transform."""
    return _on_arrays(lambda: lambda m: np.abs(np.fft.rfft(m, axis=1)) ** 2, x)


def complex_fourier(x: Column) -> Column:
    """The Fourier transform of complex numbers, real and imaginary parts in turn, as such pairs."""

    def run(m: np.ndarray) -> np.ndarray:
        z = np.fft.fft(m[:, ::2] + 1j * m[:, 1::2], axis=1)
        return np.stack([z.real, z.imag], 2).reshape(len(m), -1)

    return _on_arrays(lambda: run, x)


def inverse_real_fourier(x: Column) -> Column:
    """The real samples whose Fourier transform up to half the rate are these pairs of real and imaginary parts: 2 * (pairs - 1) of them."""
    return _on_arrays(lambda: lambda m: np.fft.irfft(m[:, ::2] + 1j * m[:, 1::2], axis=1), x)


def basis_join(frames: DataFrame, keys: list[str], basis: np.ndarray, x: str = "x") -> DataFrame:
    """Declarative form of a linear transform: one row (keys, k, c) for each coefficient."""
    spark: SparkSession = frames.sparkSession
    rows, columns = basis.shape
    flat = F.lit(basis.reshape(-1).tolist())
    table = spark.range(rows * columns).select((F.col("id") % columns).cast("int").alias("t"), F.floor(F.col("id") / columns).cast("int").alias("k"), F.get(flat, F.col("id").cast("int")).alias("w"))
    samples = frames.select(*keys, F.posexplode(x).alias("t", "v"))
    return samples.join(F.broadcast(table), "t").groupBy(*keys, "k").agg(F.sum(F.col("v") * F.col("w")).alias("c"))


def planck_window(n: int, eps: float = 0.15) -> list[float]:
    """Flat in the middle, with tapers of eps * n samples whose derivatives vanish at both ends."""
    edge = int(eps * n)
    out = [1.0] * n
    for i in range(edge):
        z = edge / i - edge / (edge - i) if 0 < i < edge else None
        out[i] = 0.0 if i == 0 else 1 / (1 + math.exp(min(700.0, z)))
        out[n - 1 - i] = out[i]
    return out


def upsample(x: Column, rate: float, low_cut: float, factor: int = 8) -> Column:
    """(signal, ratio): the tapered signal without what is below ``low_cut``, at ``factor`` times the rate, and the share of energy that is left.

    The cut is a raised cosine over three bins.
    """
    @F.pandas_udf("struct<signal:array<double>,ratio:double>")
    def run(batch: pd.Series) -> pd.DataFrame:
        if not len(batch):
            return pd.DataFrame({"signal": [], "ratio": []})
        m = np.stack(batch.to_numpy()).astype(np.float64)
        n = m.shape[1]
        spectrum = np.fft.rfft(m * np.array(planck_window(n)), axis=1)
        cut = low_cut * n / rate
        gain = 0.5 - 0.5 * np.cos(np.pi * np.clip((np.arange(spectrum.shape[1]) - cut + 1.5) / 3, 0, 1))
        gain[0] = 0.0
        kept = spectrum * gain
        wide = np.zeros((len(m), n * factor // 2 + 1), complex)
        wide[:, : kept.shape[1]] = kept
        total = (np.abs(spectrum) ** 2).sum(1)
        ratio = np.divide((np.abs(kept) ** 2).sum(1), total, out=np.zeros(len(m)), where=total > 0)
        return pd.DataFrame({"signal": list(np.fft.irfft(wide, n * factor, axis=1) * factor), "ratio": ratio})

    return run(x)


def _on_blocks(signal: DataFrame, before: int, out: list[str], run: Callable[[np.ndarray], tuple[np.ndarray, ...]], step: int, size: int) -> DataFrame:
    """(track, ch, i, *out) of a signal: ``run`` on the samples of a block after ``before`` earlier ones, giving a value for every ``step``-th sample.

    Blocks are dealt as groups of ``size`` samples with copies of their neighbours' last
    ones, so that a filter is one convolution a block. Samples before the start, missing
    ones and nulls are zero.
    """
    kind = {f.name: f.dataType.simpleString() for f in signal.schema}
    schema = f"track {kind['track']}, ch {kind['ch']}, i long, " + ", ".join(f"{c} double" for c in out)

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        begin, last = int(pdf["block"].iloc[0]) * size, int(pdf["i"].max())
        if last < begin:  # copies only
            return pd.DataFrame({c: [] for c in ("track", "ch", "i", *out)})
        x = np.zeros(before + last + 1 - begin)
        x[pdf["i"].to_numpy() - begin + before] = pdf["x"].fillna(0.0).to_numpy()
        columns = run(x)
        return pd.DataFrame({"track": pdf["track"].iloc[0], "ch": pdf["ch"].iloc[0], "i": begin // step + np.arange(len(columns[0])), **dict(zip(out, columns, strict=True))})

    cut = with_halo(signal.select("track", "ch", F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x")), before, 0, size)
    return cut.groupBy("track", "ch", "block").applyInPandas(block, schema)


def fir(signal: DataFrame, taps: list[float], out: str = "y", size: int = 65536) -> DataFrame:
    """(track, ch, i, y) with y(i) = sum of taps[age] * x(i - age); samples before the start are zero."""
    before = len(taps) - 1
    return _on_blocks(signal, before, [out], lambda x: (np.convolve(x, taps)[before : len(x)],), 1, size)


def qmf_analysis(signal: DataFrame, size: int = 65536) -> DataFrame:
    """(track, ch, i, low, high) at half the rate: even taps make one sum and odd taps another; low is their sum, high their difference.

    The sums belong to the newer sample of each pair; a last sample without its pair gives none.
    """
    taps, even = np.array(T.QMF_TAPS), np.arange(48) % 2 == 0

    def run(x: np.ndarray) -> tuple[np.ndarray, ...]:
        a, b = (np.convolve(x, np.where(some, taps, 0.0))[48 : len(x) : 2] for some in (even, ~even))
        return a + b, a - b

    return _on_blocks(signal, 47, ["low", "high"], run, 2, size)


def qmf_synthesis(halves: DataFrame, size: int = 32768) -> DataFrame:
    """(track, ch, i, x) of halves (track, ch, i, low, high), half as large as ``qmf_analysis`` gives them: the signal 46 samples late."""
    taps = np.array(T.QMF_TAPS)

    def side(value: Column, own: np.ndarray) -> DataFrame:
        return fir(halves.select("track", "ch", "i", value.alias("x")), own[::-1].tolist(), "y", size)

    odd = side(F.col("low") + F.col("high"), taps[0::2]).withColumn("i", 2 * F.col("i") + 1)
    even = side(F.col("low") - F.col("high"), taps[1::2]).withColumn("i", 2 * F.col("i"))
    return even.union(odd).withColumnRenamed("y", "x")


# --- Kernels on whole channels (one array a track and channel, or a piece of it with its history) ---


def qmf_split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low and high band of a signal of even length that starts from silence, half of what the plain sums are, so that merging restores the level."""
    taps, even = np.array(T.QMF_TAPS), np.arange(48) % 2 == 0
    a, b = (np.convolve(x, np.where(some, taps, 0))[1 : len(x) : 2] for some in (even, ~even))
    return (a + b) / 2, (a - b) / 2


def qmf_merge(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The inverse of ``qmf_split``, 46 samples late."""
    merged = np.empty(2 * len(low))
    merged[0::2], merged[1::2] = low + high, low - high
    padded = np.concatenate([np.zeros(46), merged])
    taps = np.array(T.QMF_TAPS)
    s1 = np.convolve(padded[0::2], taps[0::2][::-1], "valid")[: len(low)]
    s2 = np.convolve(padded[1::2], taps[1::2][::-1], "valid")[: len(low)]
    out = np.empty(2 * len(low))
    out[0::2], out[1::2] = s2, s1
    return out


def c1_split(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three bands of codec 1: the high one is delayed by 39 samples to match the other two."""
    rest, high = qmf_split(x)
    low, mid = qmf_split(rest)
    return low, mid, np.concatenate([np.zeros(39), high])[: len(high)]


def c1_merge(low: np.ndarray, mid: np.ndarray, high: np.ndarray, delay: int = 7) -> np.ndarray:
    """The inverse of ``c1_split``, 138 samples late: with the 39 samples there, the high band waits 46 as the others do.

    Decoders that put out a block's overlap first hold the lower bands back by 32 more, and use 39 here.
    """
    rest = qmf_merge(low, mid)
    return qmf_merge(rest, np.concatenate([np.zeros(delay), high])[: len(high)])


def c2_split(x: np.ndarray) -> list[np.ndarray]:
    """Four bands of codec 2, from low to high: the upper half splits mirrored, so its bands change places."""
    rest, upper = qmf_split(x)
    (b0, b1), (b3, b2) = qmf_split(rest), qmf_split(upper)
    return [b0, b1, b2, b3]


def c2_merge(bands: list[np.ndarray]) -> np.ndarray:
    """The inverse of ``c2_split``, 138 samples late."""
    b0, b1, b2, b3 = bands
    return qmf_merge(qmf_merge(b0, b1), qmf_merge(b3, b2))


@lru_cache(2)
def polyphase_prototype(bands: int = 16, taps: int = 384) -> np.ndarray:
    """A low-pass prototype for a cosine-modulated bank, designed here.

    A Kaiser window on a sinc, whose cut-off is searched so that the squared response and its
    mirror image about half a band add up to 1.
    """
    t = np.arange(taps) - (taps - 1) / 2
    w = np.linspace(0, np.pi / bands, 129)
    best = None
    for factor in np.linspace(1.0, 1.4, 401):
        h = np.sinc(t * factor / (2 * bands)) * np.kaiser(taps, 9.0)
        h /= h.sum()
        power = np.abs(np.exp(-1j * np.outer(w, t)) @ h) ** 2
        error = np.abs(power + power[::-1] - 1).max()
        if best is None or error < best[0]:
            best = error, h
    return best[1]


def polyphase_split(x: np.ndarray, prototype: np.ndarray | None = None, bands: int = 16) -> np.ndarray:
    """(bands, len(x) / bands) subband samples of a cosine-modulated filter bank."""
    h = polyphase_prototype(bands) if prototype is None else prototype
    n = len(h)
    k, t = np.arange(bands)[:, None], np.arange(n)[None, :]
    bank = 2 * h * np.cos(np.pi / bands * (k + 0.5) * (t - (n - 1) / 2) + (-1.0) ** k * np.pi / 4)
    padded = np.concatenate([np.zeros(n - bands), x])
    hops = np.lib.stride_tricks.sliding_window_view(padded, n)[::bands][: len(x) // bands]
    return bank @ hops[:, ::-1].T


def polyphase_merge(subbands: np.ndarray, prototype: np.ndarray | None = None) -> np.ndarray:
    """The inverse of ``polyphase_split``, as long as the prototype late (less a hop)."""
    bands, hops = subbands.shape
    h = polyphase_prototype(bands) if prototype is None else prototype
    n = len(h)
    k, t = np.arange(bands)[:, None], np.arange(n)[None, :]
    bank = 2 * h * np.cos(np.pi / bands * (k + 0.5) * (t - (n - 1) / 2) - (-1.0) ** k * np.pi / 4)
    out = np.zeros(hops * bands + n)
    for m, column in enumerate(subbands.T):
        out[m * bands : m * bands + n] += column @ bank
    return out[: hops * bands] * bands


def polyphase_response(spark: SparkSession, count: int = 1024, bands: int = 16, taps: int = 384) -> DataFrame:
    """(k, band, frequency, magnitude, phase): what a unit sine of angular frequency pi * (k + 1/2) / count becomes in each band.

    The answer is a sine of the decimated rate again: of frequency ``frequency`` within
    (0, pi), with its phase at the band's sample 0 where the input's phase is 0 at its own.
    """
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grid = spark.range(count).select(F.col("id").cast("int").alias("k"), numbers(bands).alias("band")).select("k", "band", numbers(taps).alias("t"))
    sign = F.when(F.col("band") % 2 == 0, 1).otherwise(-1)
    f = 2 * F.get(F.lit(polyphase_prototype(bands, taps).tolist()), F.col("t")) * F.cos(math.pi / bands * (F.col("band") + 0.5) * (F.col("t") - (taps - 1) / 2) + sign * (math.pi / 4))
    w = math.pi * (F.col("k") + 0.5) / count
    angle = w * (bands - 1 - F.col("t"))
    sums = grid.groupBy("k", "band").agg(F.sum(f * F.sin(angle)).alias("s"), F.sum(f * F.cos(angle)).alias("c"))
    turn = F.pmod(bands * w, F.lit(2 * math.pi))
    folded = turn > math.pi
    # Beyond half the rate the sine runs backwards: sin(t n + p) is sin((2 pi - t) n + pi - p).
    phase = F.atan2("s", "c")
    return sums.select("k", "band", F.when(folded, 2 * math.pi - turn).otherwise(turn).alias("frequency"), F.hypot("s", "c").alias("magnitude"), F.when(folded, math.pi - phase).otherwise(phase).alias("phase"))

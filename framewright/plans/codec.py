"""The first codec: three bands, long or short blocks, 212 bytes a frame and channel.

Encoding and decoding are kernels on runs of frames. Every filter and transform has a
finite memory, so a track is cut into pieces of ``PIECE`` frames that carry ``HISTORY``
frames before them; pieces are independent tasks. Only the loudness mean has a long
memory: a piece changes it to ``DECAY**updates * mean + gain``. A first pass finds these
two numbers of every piece, and a scan over them the mean that each piece begins with.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions import tables as T
from framewright.operators import coding as C
from framewright.operators import transforms as L

FRAME, PIECE, HISTORY = 512, 256, 8
DECAY, LOUDNESS = 0.98, 0.006
BANDS = (128, 128, 256)
_LONG, _SHORT = np.array(T.C1_STARTS), np.array(T.c1_short_starts())
_WIDTHS = np.array(T.C1_WIDTHS)
_BAND = np.array([0] * 20 + [1] * 16 + [2] * 16)


@lru_cache(1)
def _thresholds() -> np.ndarray:
    return np.array(T.threshold_by_unit(T.C1_WIDTHS))


@lru_cache(1)
def _curve() -> np.ndarray:
    return np.array(T.loudness_curve(FRAME))


def _lapped(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Transform of a block of n samples with 32 samples of the block before, and its inverse, both as matrices of the lapped 2n samples."""
    flat = np.ones(2 * n)
    edge = (n - 32) // 2
    flat[:edge] = flat[2 * n - edge :] = 0.0
    flat[edge : edge + 32] = T.SINE_32
    flat[2 * n - edge - 32 : 2 * n - edge] = T.SINE_32[::-1]
    windowed = L.mdct_basis(2 * n) * flat
    return windowed / n, 2 * windowed.T  # a full-scale sine has lines of up to 1, where the scale ends


@lru_cache(4)
def _matrices(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _lapped(n)


def _band_spectrum(x: np.ndarray, at: int, size: int, short: bool) -> np.ndarray:
    """Lines of the block that begins at sample ``at`` of a band."""
    n = 32 if short else size
    edge = (n - 32) // 2
    forward, _ = _matrices(n)
    blocks = []
    for k in range(size // n):
        first = at + k * n - edge - 32
        piece = x[max(0, first) : first + 2 * n]
        blocks.append(forward @ np.pad(piece, (2 * n - len(piece) if first < 0 else 0, 0 if first < 0 else 2 * n - len(piece))))
    return np.concatenate(blocks)


def short_blocks(band: np.ndarray, at: int, size: int, before: float | None) -> tuple[bool, float]:
    """Whether a band's frame has a transient, by levels of blocks of 16 filtered samples; and the last level."""
    taps = np.array(T.high_pass_taps())
    part = np.concatenate([np.zeros(max(0, 20 - at)), band[max(0, at - 20) : at + size]])
    y = np.convolve(part, taps)[20 : 20 + size]
    with np.errstate(divide="ignore", invalid="ignore"):
        levels = 19 * np.log10(np.sqrt((y.reshape(-1, 16) ** 2).mean(1)))
        steps = np.diff(np.concatenate([[0.0 if before is None else before], levels]))
    return bool(np.any(steps > 16) or np.any(steps < -20)), float(levels[-1])


def pack(spectrum: np.ndarray, short: tuple[bool, bool, bool], loudness: float) -> bytes:
    """A frame of 212 bytes: block modes, unit count, word lengths, scale indices, quantised lines."""
    modes = [2 if short[0] else 0, 2 if short[1] else 0, 3 if short[2] else 0]
    is_short = np.array(short)[_BAND]
    first = np.where(is_short, _SHORT, _LONG)
    values = [spectrum[s : s + w] for s, w in zip(first, _WIDTHS, strict=True)]
    peak = np.array([np.abs(v).max() for v in values])
    sf = np.minimum(np.searchsorted(T.SCALE, peak), 63)
    energy = np.array([(v * v).sum() for v in values])
    fixed = np.where(is_short, T.C1_FIXED_SHORT, T.C1_FIXED_LONG)
    idx = 7
    while True:
        n = T.C1_UNIT_COUNTS[idx]
        band = _BAND[:n]
        tilt = sf[:n][band == 0].mean() - sf[:n][band == 1].mean() if np.any(band == 1) else 0.0
        bias = min(1.5, 0.3 * max(0.0, tilt - 7)) * np.array([0.0, 1.0, 0.5])[band]
        masked = ~is_short[:n] & (energy[:n] < _thresholds()[:n] * loudness)

        def allocation(shift: float, n=n, bias=bias, masked=masked) -> np.ndarray:
            bits = np.trunc(0.4 * sf[:n] / 3.2 + 0.6 * fixed[:n] - shift + bias).astype(int)
            return np.where(masked | (bits < 2), 0, np.minimum(bits, 16))

        room = T.C1_FRAME_BYTES * 8 - 3 - 32 - 2 - 3 - n * 10
        shift, used = C.Budget(room, -3.0, 15.0).run(lambda s, n=n, allocation=allocation: int((allocation(s) * _WIDTHS[:n]).sum()))
        bits = allocation(shift)
        last = int(np.flatnonzero(bits)[-1]) + 1 if bits.any() else 0
        if idx and last <= T.C1_UNIT_COUNTS[idx - 1]:
            idx -= 1
            continue
        break
    boost(bits, room - used)
    out = C.BitWriter()
    for value, size in ((2 - modes[0], 2), (2 - modes[1], 2), (3 - modes[2], 2), (0, 2), (idx, 3), (0, 5)):
        out.put(value, size)
    for b in bits:
        out.put(int(b) - 1 if b else 0, 4)
    for k in range(len(bits)):
        out.put(int(sf[k]), 6)
    for b, v, k in zip(bits, values, sf, strict=False):
        if b:
            for q in np.rint(np.clip(v / T.SCALE[k], -0.99999, 0.99999) * ((1 << int(b) - 1) - 1)).astype(int):
                out.put(int(q), int(b))
    return out.bytes(T.C1_FRAME_BYTES)


def boost(bits: np.ndarray, surplus: int) -> int:
    """Gives left-over bits to the marked units, narrow ones first, round by round; returns what is left."""
    units = sorted((T.C1_WIDTHS[u], u) for u in T.C1_BOOSTED)
    units = [u for w, u in units if w <= surplus]
    while surplus >= 6 and units:
        before = surplus
        for u in units:
            if u >= len(bits):
                break
            more = 1 if bits[u] else 2
            if bits[u] < 16 and T.C1_WIDTHS[u] * more <= surplus:
                bits[u] += more
                surplus -= T.C1_WIDTHS[u] * more
        if surplus == before:
            break
    return surplus


def unpack(data: bytes) -> tuple[np.ndarray, tuple[bool, bool, bool]]:
    """Spectrum and block modes; a malformed frame is silent, with long blocks."""
    spectrum = np.zeros(FRAME)
    try:
        r = C.BitReader(data)
        modes = [2 - r.get(2), 2 - r.get(2), 3 - r.get(2)]
        if min(modes) < 0:
            raise ValueError("no such block mode")
        r.get(2)
        n = T.C1_UNIT_COUNTS[r.get(3)]
        r.get(5)
        words = [r.get(4) for _ in range(n)]
        scales = [r.get(6) for _ in range(n)]
        short = tuple(m > 0 for m in modes)
        for u in range(n):
            if words[u]:
                b = words[u] + 1
                start = (_SHORT if short[_BAND[u]] else _LONG)[u]
                for i in range(_WIDTHS[u]):
                    spectrum[start + i] = T.SCALE[scales[u]] * r.get_signed(b) / ((1 << b - 1) - 1)
    except ValueError:
        return np.zeros(FRAME), (False, False, False)
    return spectrum, short


def _analysed(x: np.ndarray) -> Iterator[tuple[np.ndarray, tuple[bool, bool, bool], float]]:
    """Spectrum, block modes and weighted loudness of each frame of a channel that starts from silence; the loudness is 0 with short blocks."""
    frames = -(-len(x) // FRAME)
    bands = L.c1_split(np.pad(x, (0, frames * FRAME - len(x))))
    before = [None] * 3
    for f in range(frames):
        short = []
        for b, size in enumerate(BANDS):
            flag, before[b] = short_blocks(bands[b], f * size, size, before[b])
            short.append(flag)
        spectrum = np.concatenate([_band_spectrum(bands[b], f * size, size, short[b]) for b, size in enumerate(BANDS)])
        yield spectrum, tuple(short), 0.0 if any(short) else float((spectrum**2 * _curve()).sum())


def encode_samples(x: np.ndarray, loudness: float = LOUDNESS, history: int = 0) -> list[bytes]:
    """Frames of a channel that starts from silence; a short last frame is filled with zeros. Samples lie in [-1, 1].

    The first ``history`` frames only fill the filters; ``loudness`` is the mean after them.
    """
    out = []
    for f, (spectrum, short, weighted) in enumerate(_analysed(x)):
        if f < history:
            continue
        if not any(short):
            loudness = DECAY * loudness + (1 - DECAY) * weighted
        out.append(pack(spectrum, short, loudness / LOUDNESS))  # relative to the usual level
    return out


def decode_samples(frames: list[bytes]) -> np.ndarray:
    """Samples in [-1, 1] of a run of frames that starts from silence."""
    bands = [np.zeros(len(frames) * size + 2 * size) for size in BANDS]
    for f, data in enumerate(frames):
        spectrum, short = unpack(data)
        at = 0
        for b, size in enumerate(BANDS):
            n = 32 if short[b] else size
            edge = (n - 32) // 2
            _, back = _matrices(n)
            for k in range(size // n):
                y = back @ spectrum[at : at + n]
                first = f * size + k * n - edge - 32
                lo = max(0, first)
                bands[b][lo : first + 2 * n] += y[lo - first :]
                at += n
    n = len(frames)
    low, mid, high = (bands[b][: n * size] for b, size in enumerate(BANDS))
    return np.clip(L.c1_merge(low, mid, high), -1, 1)


def _pieces(rows: DataFrame, frame: str, history: int) -> DataFrame:
    """Adds piece; frames that the next piece needs as history appear in both."""
    home = F.floor(F.col(frame) / PIECE)
    return rows.withColumn("piece", F.explode(F.sequence(home, F.floor((F.col(frame) + history) / PIECE))))


def _piece_samples(pdf: pd.DataFrame, stop: int) -> tuple[np.ndarray, int]:
    """Samples of a piece with its history, up to frame ``stop``, and the frames of history."""
    first = max(0, int(pdf["piece"].iloc[0]) * PIECE - HISTORY)
    x = np.zeros((stop - first) * FRAME)
    x[pdf["i"].to_numpy() - first * FRAME] = pdf["x"].fillna(0.0).to_numpy()
    return x, int(pdf["piece"].iloc[0]) * PIECE - first


def _entry_loudness(cut: DataFrame) -> DataFrame:
    """(track, ch, piece, loudness): the loudness mean that a piece begins with, from a row for each piece."""

    def change(pdf: pd.DataFrame) -> pd.DataFrame:
        piece = int(pdf["piece"].iloc[0])
        x, history = _piece_samples(pdf, (piece + 1) * PIECE)
        updates, gain = 0, 0.0
        for f, (_, short, weighted) in enumerate(_analysed(x)):
            if f >= history and not any(short):
                updates, gain = updates + 1, DECAY * gain + (1 - DECAY) * weighted
        return pd.DataFrame({"track": [pdf["track"].iloc[0]], "ch": [int(pdf["ch"].iloc[0])], "piece": [piece], "updates": [updates], "gain": [gain]})

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece")
        mean, after, found = LOUDNESS, 0, []
        for piece, updates, gain in zip(pdf["piece"], pdf["updates"], pdf["gain"], strict=True):
            # Pieces without samples are silent: all frames count, but for the first of a track, which is flagged.
            mean *= DECAY ** ((piece - after) * PIECE - (after == 0 and piece > 0))
            found.append(mean)
            mean, after = DECAY**updates * mean + gain, piece + 1
        return pd.DataFrame({"track": pdf["track"], "ch": pdf["ch"], "piece": pdf["piece"], "loudness": found})

    changes = cut.groupBy("track", "ch", "piece").applyInPandas(change, "track string, ch int, piece long, updates long, gain double")
    return changes.groupBy("track", "ch").applyInPandas(scan, "track string, ch int, piece long, loudness double")


def encode(signal: DataFrame) -> DataFrame:
    """(track, ch, frame, payload) of a signal (track, ch, i, x) with samples in [-1, 1]; missing samples are zero."""
    cut = _pieces(signal.withColumn("frame", F.floor(F.col("i") / FRAME)), "frame", HISTORY)

    def run(pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        piece = int(pdf["piece"].iloc[0])
        last = int(pdf["frame"].max())
        if last < piece * PIECE:
            return pd.DataFrame({"track": [], "ch": [], "frame": [], "payload": []})
        x, history = _piece_samples(pdf, last + 1)
        frames = encode_samples(x, float(entry["loudness"].iloc[0]), history)
        n = len(frames)
        return pd.DataFrame({"track": [pdf["track"].iloc[0]] * n, "ch": [int(pdf["ch"].iloc[0])] * n, "frame": range(piece * PIECE, piece * PIECE + n), "payload": frames})

    keys = ["track", "ch", "piece"]
    return cut.groupBy(*keys).cogroup(_entry_loudness(cut).groupBy(*keys)).applyInPandas(run, "track string, ch int, frame long, payload binary")


def decode(frames: DataFrame) -> DataFrame:
    """(track, ch, i, x) of frames (track, ch, frame, payload); missing frames are silent."""
    cut = _pieces(frames, "frame", HISTORY)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        piece = int(pdf["piece"].iloc[0])
        first = max(0, piece * PIECE - HISTORY)
        last = int(pdf["frame"].max())
        if last < piece * PIECE:
            return pd.DataFrame({"track": [], "ch": [], "i": [], "x": []})
        data = [b""] * (last - first + 1)
        for f, p in zip(pdf["frame"], pdf["payload"], strict=True):
            data[int(f) - first] = p or b""
        x = decode_samples(data)[(piece * PIECE - first) * FRAME :]
        return pd.DataFrame({"track": pdf["track"].iloc[0], "ch": int(pdf["ch"].iloc[0]), "i": np.arange(len(x)) + piece * PIECE * FRAME, "x": x})

    return cut.groupBy("track", "ch", "piece").applyInPandas(run, "track string, ch int, i long, x double")


def snr(original: np.ndarray, decoded: np.ndarray, reach: int = 700) -> tuple[float, int]:
    """Best signal-to-noise ratio in dB over delays up to ``reach``, and that delay."""
    best = (-math.inf, 0)
    for d in range(reach):
        a, b = original[: len(original) - d][FRAME:-FRAME], decoded[d : len(original)][FRAME:-FRAME]
        noise = ((a - b) ** 2).sum()
        best = max(best, (10 * math.log10((a**2).sum() / max(noise, 1e-30)), d))
    return best


"""The second codec: four bands, transforms of 512 samples, sound units under a bit budget.

Encoding is an analysis of pieces of a track (a kernel with finite memory, so that pieces
carry some frames of history), the loudness mean of the track (a block scan over one number
a frame), and the packing of each frame. A sound unit holds the band count, gain points (none
here), tonal components (none here), the unit count, the coding mode, word lengths, scale
indices and quantised lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions import tables as T
from framewright.operators import coding as C
from framewright.operators import sequence as Q
from framewright.operators import transforms as L

FRAME, BAND, PIECE, HISTORY = 1024, 256, 128, 4
LOUDNESS = 0.006
UNIT_ID = 0x28
#: Units from here on are rounded so that their energy stays; units below the other number may get more bits for it.
ENERGY_FROM, BOOST_BELOW = 19, 10
_STARTS, _WIDTHS = np.array(T.C2_STARTS[:32]), np.array(T.C2_WIDTHS)
_DIVISOR = np.array([2.8] * 3 + [2.6] * 7 + [3.3] * 5 + [3.6] * 6 + [4.2] * 8 + [6.0] * 3)
#: Two-bit codes of -2 to 1 in the fixed-length coding of pairs. Fixed values.
_PAIR_CODES = (2, 3, 0, 1)


@lru_cache(1)
def _thresholds() -> np.ndarray:
    return np.array(T.threshold_by_unit(T.C2_WIDTHS))


@lru_cache(1)
def _curve() -> np.ndarray:
    return np.array(T.loudness_curve(FRAME))


@lru_cache(8)
def _codes(selector: int) -> dict[int, tuple[int, int]]:
    return C.canonical_codes(T.C2_CODE_LENGTHS[selector])


@lru_cache(1)
def _matrices() -> tuple[np.ndarray, np.ndarray]:
    """Transform of two halves, and its inverse; a full-scale sine has lines of up to 1."""
    rising, back = np.array(T.ENCODE_WINDOW), np.array(T.DECODE_WINDOW)
    basis = L.mdct_basis(2 * BAND)
    return basis * np.concatenate([rising, rising[::-1]]) / BAND, basis.T * np.concatenate([back, back[::-1]])[:, None]


def quantise(values: np.ndarray, multiple: float, keep_energy: bool) -> tuple[np.ndarray, float]:
    """Nearest integers of ``values`` * ``multiple``, and the ratio of the energies before and after.

    With ``keep_energy``, values near a half may be rounded the other way, nearest first, if
    the energies come closer by it.
    """
    t = values * multiple
    q = np.rint(t)
    before, after = float((values**2).sum()), float((q**2).sum()) / multiple**2
    if keep_energy and before != after:
        distance = np.abs(t - (np.trunc(t) + 0.5))
        larger = after < before
        for k in sorted(np.flatnonzero(distance < 0.25), key=lambda k: distance[k]):
            if larger and not (abs(q[k]) < abs(t[k]) and abs(q[k]) < multiple - 1) or not larger and not abs(q[k]) > abs(t[k]):
                continue
            size = abs(q[k]) + (1 if larger else -1)
            other = after + (size**2 - q[k] ** 2) / multiple**2
            if abs(other - before) < abs(after - before):
                q[k], after = np.copysign(size, t[k]), other
    return q.astype(int), before / after if after else (np.inf if before else 0.0)


def _symbols(q: list[int], selector: int) -> list[int]:
    if selector == 1:
        return [T.C2_PAIR_INDEX[3 * (a + 1) + b + 1] for a, b in zip(q[::2], q[1::2], strict=True)]
    return [2 * v - 1 if v > 0 else -2 * v for v in q]


def _costs(q: np.ndarray, selector: int) -> tuple[int, int]:
    """Bits of the fixed and of the variable coding."""
    symbols = _symbols(q.tolist(), selector)
    return T.C2_CLC_BITS[selector] * len(symbols), sum(T.C2_CODE_LENGTHS[selector][s] for s in symbols)


def sound_unit(spectrum: np.ndarray, loudness: float, size: int, bands: int = 4) -> bytes:
    """A channel's unit of ``size`` bytes. ``loudness`` is relative to the usual level."""
    values = [spectrum[s : s + w] for s, w in zip(_STARTS, _WIDTHS, strict=True)]
    sf = np.minimum(np.searchsorted(T.SCALE, [np.abs(v).max() for v in values]), 63)
    heard = np.array([(v * v).sum() for v in values]) >= _thresholds() * loudness
    scaled = [np.clip(v / T.SCALE[k], -0.99999, 0.99999) for v, k in zip(values, sf, strict=True)]
    spread = min(14.0, float(np.std(sf))) / 14
    made: dict[tuple[int, int], tuple] = {}

    def unit(u: int, bits: int) -> tuple:
        if (u, bits) not in made:
            q, error = quantise(scaled[u], T.C2_MAX_QUANT[bits], u >= ENERGY_FROM)
            made[u, bits] = q, error, *_costs(q, bits)
        return made[u, bits]

    def allocation(shift: float, n: int) -> np.ndarray:
        bits = np.trunc(spread * (sf[:n] / _DIVISOR[:n]) + (1 - spread) * np.array(T.C2_FIXED)[:n] - shift).astype(int)
        bits = np.where(heard[:n], np.clip(np.where(bits == 0, 1, bits), 0, 7), 0)
        while True:
            error = np.array([unit(u, int(b))[1] if b else 0.0 for u, b in enumerate(bits)])
            more = (np.arange(n) < BOOST_BELOW) & (bits < 7) & (((error > 0) & (error < 0.7)) | (error > 1.2))
            if not more.any():
                return bits
            bits = bits + more

    def cost(bits: np.ndarray) -> tuple[int, bool]:
        both = np.array([unit(u, int(b))[2:] for u, b in enumerate(bits) if b]).reshape(-1, 2).sum(0)
        return int(3 * len(bits) + 6 * (bits > 0).sum() + both.min()) + 5, bool(both[0] <= both[1])

    room = size * 8 - 6 - 2 - 3 * bands - 6
    n = max(1, min(32, (room - 5) // 3 if room > 5 else 1) if room < 101 else 32)
    while True:
        shift, _ = C.Budget(room, -8.0, 20.0).run(lambda s, n=n: cost(allocation(s, n))[0])
        bits = allocation(shift, n)
        if n == 1 or bits[-1]:
            break
        n -= 1
    fixed = cost(bits)[1]
    out = C.BitWriter()
    for value, width in ((UNIT_ID, 6), (bands - 1, 2), *[(0, 3)] * bands, (0, 5), (n - 1, 5), (int(fixed), 1)):
        out.put(value, width)
    for b in bits:
        out.put(int(b), 3)
    for k, b in zip(sf, bits, strict=False):
        if b:
            out.put(int(k), 6)
    for u, b in enumerate(bits.tolist()):
        if b:
            _put_lines(out, unit(u, b)[0].tolist(), b, fixed)
    return out.bytes(size)


def _put_lines(out: C.BitWriter, q: list[int], selector: int, fixed: bool) -> None:
    if not fixed:
        for s in _symbols(q, selector):
            out.put(*_codes(selector)[s])
    elif selector == 1:
        for v in q:
            out.put(_PAIR_CODES[v + 2], 2)
    else:
        for v in q:
            out.put(v, T.C2_CLC_BITS[selector])


def parse_unit(data: bytes) -> tuple[np.ndarray, dict]:
    """Spectrum and header fields of a sound unit without gain points and tonal components; anything else is a ValueError."""
    r = C.BitReader(data)
    if r.get(6) != UNIT_ID:
        raise ValueError("no sound unit")
    bands = r.get(2) + 1
    if any([r.get(3) for _ in range(bands)]) or r.get(5):
        raise ValueError("gain points or tonal components")
    n, fixed = r.get(5) + 1, bool(r.get(1))
    bits = [r.get(3) for _ in range(n)]
    sf = [r.get(6) if b else None for b in bits]
    spectrum = np.zeros(FRAME)
    for u, b in enumerate(bits):
        if b:
            q = _get_lines(r, int(_WIDTHS[u]), b, fixed)
            spectrum[_STARTS[u] : _STARTS[u] + _WIDTHS[u]] = np.array(q) / T.C2_MAX_QUANT[b] * T.SCALE[sf[u]]
    return spectrum, {"bands": bands, "units": n, "fixed": fixed, "bits": bits, "scale": sf, "used": r.at}


def _get_lines(r: C.BitReader, width: int, selector: int, fixed: bool) -> list[int]:
    if fixed:
        return [_PAIR_CODES.index(r.get(2)) - 2 for _ in range(width)] if selector == 1 else [r.get_signed(T.C2_CLC_BITS[selector]) for _ in range(width)]
    names = {code: s for s, code in _codes(selector).items()}
    out: list[int] = []
    while len(out) < width:
        code = size = 0
        while (code, size) not in names:
            code, size = code << 1 | r.get(1), size + 1
        s = names[code, size]
        out += divmod(T.C2_PAIR_INDEX.index(s), 3) if selector == 1 else [(s + 1) // 2 if s % 2 else -(s // 2)]
    return [v - 1 for v in out] if selector == 1 else out


def spectra(x: np.ndarray) -> np.ndarray:
    """(frames, 1024) lines of a channel that starts from silence; odd bands are reversed."""
    frames = -(-len(x) // FRAME)
    forward, _ = _matrices()
    out = np.empty((frames, 4, BAND))
    for b, band in enumerate(L.c2_split(np.pad(x, (0, frames * FRAME - len(x))))):
        rows = np.concatenate([np.zeros(BAND), band]).reshape(-1, BAND)
        lines = np.concatenate([rows[:-1], rows[1:]], 1) @ forward.T
        out[:, b] = lines[:, ::-1] if b % 2 else lines
    return out.reshape(frames, FRAME)


def samples(lines: np.ndarray) -> np.ndarray:
    """The samples of (frames, 1024) lines: of the frame before each, and 138 samples late."""
    _, back = _matrices()
    bands = []
    for b in range(4):
        c = lines.reshape(-1, 4, BAND)[:, b]
        halves = (c[:, ::-1] if b % 2 else c) @ back.T
        bands.append((halves[:, :BAND] + np.concatenate([np.zeros((1, BAND)), halves[:-1, BAND:]])).reshape(-1))
    return L.c2_merge(bands)


def analyse(signal: DataFrame) -> DataFrame:
    """(track, ch, frame, lines, weighted) of a signal (track, ch, i, x): the spectrum of each frame and its weighted loudness; missing samples are zero."""
    home = F.floor(F.col("i") / FRAME / PIECE)
    cut = signal.withColumn("piece", F.explode(F.sequence(home, F.floor((F.floor(F.col("i") / FRAME) + HISTORY) / PIECE))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        piece = int(pdf["piece"].iloc[0])
        first, last = max(0, piece * PIECE - HISTORY), int(pdf["i"].max()) // FRAME
        if last < piece * PIECE:
            return pd.DataFrame({c: [] for c in ("track", "ch", "frame", "lines", "weighted")}, dtype=object)
        x = np.zeros((last + 1 - first) * FRAME)
        x[pdf["i"].to_numpy() - first * FRAME] = pdf["x"].fillna(0.0).to_numpy()
        lines = spectra(x)[piece * PIECE - first :]
        return pd.DataFrame({"track": pdf["track"].iloc[0], "ch": int(pdf["ch"].iloc[0]), "frame": np.arange(len(lines)) + piece * PIECE, "lines": list(lines), "weighted": (lines**2) @ _curve()})

    return cut.groupBy("track", "ch", "piece").applyInPandas(run, "track string, ch int, frame long, lines array<double>, weighted double")


def encode(signal: DataFrame, size: int = 192) -> DataFrame:
    """(track, ch, frame, payload) of a signal (track, ch, i, x) with samples in [-1, 1]: a sound unit of ``size`` bytes a frame."""
    frames = analyse(signal)
    loudness = Q.decayed(frames.select("track", "ch", F.col("frame").alias("i"), F.col("weighted").alias("x")))
    rows = frames.drop("weighted").join(loudness.select("track", "ch", F.col("i").alias("frame"), "level"), ["track", "ch", "frame"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            payload = [sound_unit(np.asarray(v), level / LOUDNESS, size) for v, level in zip(pdf["lines"], pdf["level"], strict=True)]
            yield pd.DataFrame({"track": pdf["track"], "ch": pdf["ch"], "frame": pdf["frame"], "payload": payload})

    return rows.select("track", "ch", "frame", "lines", "level").mapInPandas(run, "track string, ch int, frame long, payload binary")

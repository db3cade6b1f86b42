"""Dimension tables of the codecs: layouts, scales, windows, curves.

Whatever has a formula is generated. The rest are fixed values of the public formats.
Tables are Python lists (for literals and kernels) and small DataFrames (for joins); the
latter have at most 2048 rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed values: layout of codec 1 (512 samples a frame, three bands) ---
C1_WIDTHS = [8] * 4 + [4] * 4 + [8] * 4 + [6] * 8 + [6] * 4 + [7] * 4 + [9] * 4 + [10] * 4 + [12] * 8 + [20] * 8
C1_BAND_UNITS = [0, 20, 36, 52]
C1_UNIT_COUNTS = [20, 28, 32, 36, 40, 44, 48, 52]
C1_FRAME_BYTES = 212
# --- Fixed values: word lengths that the first codec's allocation is blended with ---
C1_FIXED_LONG = [7] * 3 + [6] * 19 + [5] * 13 + [4] * 3 + [3] * 6 + [2] + [1] * 4 + [0] * 3
C1_FIXED_SHORT = [6] * 24 + [5] * 12 + [4] * 8 + [0] * 8
C1_BOOSTED = [18, 19, 20, 21, 22, 32, 33, 34, 35, 36, 37, 38]
# --- Fixed values: layout of codec 2 (1024 samples a frame, four bands) ---
C2_WIDTHS = [8] * 8 + [16] * 8 + [32] * 10 + [64] * 4 + [128] * 2
C2_BAND_UNITS = [0, 18, 26, 30, 32]
C2_FIXED = [6] * 2 + [5] + [4] * 3 + [3] * 12 + [2] * 5 + [1] * 6 + [0] * 3
C2_MAX_QUANT = [0.0, 1.5, 2.5, 3.5, 4.5, 7.5, 15.5, 31.5]
C2_CLC_BITS = [0, 4, 3, 3, 4, 4, 5, 6]
C2_PAIR_INDEX = [8, 4, 7, 2, 0, 1, 6, 3, 5]
#: Bits of the variable-length codes of codec 2 by selector and symbol. Fixed values.
C2_CODE_LENGTHS = {
    1: [1] + [3] * 2 + [4] * 2 + [5] * 4,
    2: [1] + [3] * 4,
    3: [1] + [3] * 2 + [4] * 4,
    4: [1] + [3] * 2 + [4] * 2 + [5] * 4,
    5: [2] + [3] * 2 + [4] * 4 + [5] * 2 + [6] * 4 + [4] * 2,
    6: [3] + [4] * 6 + [5] * 6 + [6] * 8 + [7] * 8 + [4] * 2,
    7: [3] + [5] * 10 + [6] * 16 + [7] * 14 + [8] * 20 + [4] * 2,
}
#: Word-length codes of codec 3: codes of 1, 2, 3, ... bits of each table, and their symbols in the order of the codes. Fixed values.
C3_WORD_CODES = [
    ([1, 2], [0, 1, 7]),
    ([1, 0, 4], [0, 1, 2, 6, 7]),
    ([1, 0, 2, 3, 2], [0, 1, 7, 2, 5, 6, 3, 4]),
    ([1, 0, 2, 3, 2], [0, 1, 7, 2, 3, 6, 4, 5]),
]
#: Mantissa steps of codec 3 by word length. Fixed values.
C3_MANTISSA = [0.0, 0.74801636, 0.44882202, 0.32058716, 0.20400238, 0.1496048, 0.07239151, 0.035619736]
# --- Fixed values: (bit/s, frame bytes, joint stereo) ---
C2_CONTAINERS = [
    (66150, 192, True), (93713, 272, True), (104738, 304, False), (132300, 384, False),
    (146081, 424, False), (176400, 512, False), (264600, 768, False), (352800, 1024, False),
]
# --- Fixed values: half of the 48 taps of the two-band quadrature mirror filter ---
QMF_HALF = [
    -0.00001461907, -0.00009205479, -0.000056157569, 0.00030117269, 0.0002422519, -0.00085293897, -0.0005205574, 0.0020340169,
    0.00078333891, -0.0042153862, -0.00075614988, 0.0078402944, -0.000061169922, -0.01344162, 0.0024626821, 0.021736089,
    -0.007801671, -0.034090221, 0.01880949, 0.054326009, -0.043596379, -0.099384367, 0.13207909, 0.46424159,
]
# --- Fixed values: first half of the 21 taps of the transient high-pass filter (the middle tap is 1) ---
HIGH_PASS_HALF = [-8.65163e-18, -0.00851586, -6.74764e-18, 0.0209036, -3.36639e-17, -0.0438162, -1.54175e-17, 0.0931738, -5.52212e-17, -0.313819]
# --- Fixed values: hearing threshold, 1/100 dB, 40 steps a decade from 10 Hz ---
HEARING = [
    9669, 9669, 9626, 9512, 9353, 9113, 8882, 8676, 8469, 8243, 7997, 7748, 7492, 7239, 7000, 6762, 6529, 6302, 6084, 5900,
    5717, 5534, 5351, 5167, 5004, 4812, 4638, 4466, 4310, 4173, 4050, 3922, 3723, 3577, 3451, 3281, 3132, 3036, 2902, 2760,
    2658, 2591, 2441, 2301, 2212, 2125, 2018, 1900, 1770, 1682, 1594, 1512, 1430, 1341, 1260, 1198, 1136, 1057, 998, 943,
    887, 846, 744, 712, 693, 668, 637, 606, 580, 555, 529, 502, 475, 448, 422, 398, 375, 351, 327, 322,
    312, 301, 291, 268, 246, 215, 182, 146, 107, 61, 13, -35, -96, -156, -179, -235, -295, -350, -401, -421,
    -446, -499, -532, -535, -513, -476, -431, -313, -179, 8, 203, 403, 580, 736, 881, 1022, 1154, 1251, 1348, 1421,
    1479, 1399, 1285, 1193, 1287, 1519, 1914, 2369, 3352, 4352, 5352, 6352, 7352, 8352, 9352, 9999, 9999, 9999, 9999, 9999,
]


def starts(widths: list[int]) -> list[int]:
    """First line of each unit."""
    out = [0]
    for w in widths[:-1]:
        out.append(out[-1] + w)
    return out


C1_STARTS = starts(C1_WIDTHS)
C2_STARTS = starts(C2_WIDTHS)


def c1_short_starts() -> list[int]:
    """First lines of the units when a band is coded as blocks of 32 lines: unit k of a group of 4 (or 8) lies in block k."""
    out = []
    for band, blocks in enumerate((4, 4, 8)):
        base, offset = (0, 128, 256)[band], 0
        units = C1_WIDTHS[C1_BAND_UNITS[band] : C1_BAND_UNITS[band + 1]]
        for k in range(0, len(units), blocks):
            out += [base + 32 * b + offset for b in range(blocks)]
            offset += units[k]
    return out


QMF_TAPS = [2 * t for t in QMF_HALF] + [2 * t for t in reversed(QMF_HALF)]


def high_pass_taps() -> list[float]:
    """Weights by age of the sample, from the newest; both halves are symmetric about age 10."""
    half = [2 * c / 2 for c in HIGH_PASS_HALF]
    out = [0.0] * 21
    for j, c in enumerate(half):
        out[20 - j] += c
        out[j - 1 if j else 0] += c if j else 0.0
    out[10] += 0.5
    return out


SCALE = [2.0 ** (i / 3 - 21) for i in range(64)]
SINE_32 = [math.sin((i + 0.5) * math.pi / 64) for i in range(32)]
ENCODE_WINDOW = [math.sin(((i + 0.5) / 256 - 0.5) * math.pi) + 1 for i in range(256)]
DECODE_WINDOW = [2 * a / (a * a + b * b) for a, b in zip(ENCODE_WINDOW, reversed(ENCODE_WINDOW), strict=True)]
#: Bits of the word-length codes by table and symbol; 0 where a table has no code.
C3_WORD_LENGTHS = [[0] * 8 for _ in C3_WORD_CODES]
for _table, (_counts, _symbols) in enumerate(C3_WORD_CODES):
    for _symbol, _length in zip(_symbols, [n + 1 for n, count in enumerate(_counts) for _ in range(count)], strict=True):
        C3_WORD_LENGTHS[_table][_symbol] = _length
#: Factors of the quantiser of codec 3 by word length; 0 has none.
C3_INVERSE_MANTISSA = [1 / m if m else 0.0 for m in C3_MANTISSA]
GAIN_LEVEL = [2.0 ** (4 - i) for i in range(16)]
GAIN_STEP = [2.0 ** (-(i - 15) / 8) for i in range(31)]
TONE_AMPLITUDE = [2.0 ** ((i - 3) / 4) for i in range(64)]


def hearing_threshold(hz: float) -> float:
    """dB relative to full scale, by linear interpolation on the logarithmic grid."""
    hz = min(29853.0, max(10.0, hz))
    at = 40 * math.log10(0.1 * hz)
    k = int(at)
    return 0.01 * (HEARING[k] * (1 + k - at) + HEARING[k + 1] * (at - k)) - 100 - (hz / 1000) ** 2 * 0.015


def threshold_by_line(lines: int, rate: int = 44100) -> list[float]:
    return [hearing_threshold((i + 1) * rate / 2 / lines) for i in range(lines)]


def threshold_by_unit(widths: list[int], rate: int = 44100) -> list[float]:
    """Least threshold of a unit's lines, as energy."""
    line = threshold_by_line(sum(widths), rate)
    return [10 ** (0.1 * min(line[s : s + w])) for s, w in zip(starts(widths), widths, strict=True)]


def loudness_curve(lines: int) -> list[float]:
    out = []
    for i in range(lines):
        f = (i + 3) * 0.5 * 44100 / lines
        t = math.log10(f) - 3.5
        out.append(10 ** (0.1 * (-10 * t * t + 3 - f / 3000)))
    return out


def scale_table(spark: SparkSession) -> DataFrame:
    """(idx, value), ascending: 2^(idx/3 - 21)."""
    return spark.range(64).select(F.col("id").cast("int").alias("idx"), F.pow(F.lit(2.0), F.col("id") / 3 - 21).alias("value"))


def unit_table(spark: SparkSession, widths: list[int], bands: list[int]) -> DataFrame:
    """(line, unit, band): one row a line, so that a range join becomes an equi-join."""
    w, b = F.lit(widths), F.lit([sum(u >= x for x in bands[1:]) for u in range(len(widths))])
    units = spark.range(len(widths)).select(F.col("id").cast("int").alias("unit"), F.get(w, F.col("id").cast("int")).alias("width"), F.get(b, F.col("id").cast("int")).alias("band"), F.get(F.lit(starts(widths)), F.col("id").cast("int")).alias("start"))
    return units.select(F.explode(F.sequence(F.col("start"), F.col("start") + F.col("width") - 1)).alias("line"), "unit", "band", "width")


def gain_tables(spark: SparkSession) -> DataFrame:
    """(idx, level, step): gain levels for idx < 16 and interpolation steps for idx < 31."""
    i = F.col("id")
    return spark.range(31).select(i.cast("int").alias("idx"), F.when(i < 16, F.pow(F.lit(2.0), 4 - i)).alias("level"), F.pow(F.lit(2.0), -(i - 15) / 8).alias("step"))


def windows(spark: SparkSession, n: int = 256) -> DataFrame:
    """(i, encode, decode, sine): the encode and decode windows, and a sine window of the same length."""
    def encode(k):
        return F.sin(((k + 0.5) / n - 0.5) * math.pi) + 1

    i = F.col("id")
    a, b = encode(i), encode(n - 1 - i)
    return spark.range(n).select(i.cast("int").alias("i"), a.alias("encode"), (2 * a / (a * a + b * b)).alias("decode"), F.sin((i + 0.5) * math.pi / (2 * n)).alias("sine"))


def container_table(spark: SparkSession) -> DataFrame:
    """(bitrate, frame_bytes, joint)."""
    rows = F.lit([r[0] for r in C2_CONTAINERS]), F.lit([r[1] for r in C2_CONTAINERS]), F.lit([r[2] for r in C2_CONTAINERS])
    return spark.range(len(C2_CONTAINERS)).select(*(F.get(x, F.col("id").cast("int")).alias(n) for x, n in zip(rows, ("bitrate", "frame_bytes", "joint"), strict=True)))

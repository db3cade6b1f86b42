"""Bits: packing, allocation under a budget, quantisation, entropy coding."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions import tables as T


class BitWriter:
    """Appends numbers, most significant bit first."""

    def __init__(self) -> None:
        self.value, self.length = 0, 0

    def put(self, value: int, bits: int) -> None:
        self.value = self.value << bits | value & (1 << bits) - 1
        self.length += bits

    def bytes(self, size: int | None = None) -> bytes:
        """What was written, filled with zero bits (to ``size`` bytes, beyond which it is cut)."""
        n = -(-self.length // 8)
        data = (self.value << n * 8 - self.length).to_bytes(n, "big")
        return data if size is None else data[:size].ljust(size, b"\0")


class BitReader:
    """Reads numbers, most significant bit first; a read beyond the end is an error."""

    def __init__(self, data: bytes):
        self.data, self.at, self.all = int.from_bytes(data, "big"), 0, len(data) * 8

    def get(self, bits: int) -> int:
        if self.at + bits > self.all:
            raise ValueError("the stream ends early")
        self.at += bits
        return self.data >> self.all - self.at & (1 << bits) - 1

    def get_signed(self, bits: int) -> int:
        v = self.get(bits)
        return v - (1 << bits) if bits and v >> bits - 1 else v


def sign_extended(value: Column, bits: int) -> Column:
    """A two's complement number of ``bits`` bits as an int."""
    return F.shiftright(F.shiftleft(value.cast("int"), 32 - bits), 32 - bits)


def bit_offsets(rows: DataFrame, keys: list[str], order: str, bits: str) -> DataFrame:
    """Adds offset, the bits written before each row of its frame."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(bits).over(w), F.lit(0)))


def scrambled(words: Column, key: int = 0x537F6103) -> Column:
    """32-bit words xor a key; the same again restores them."""
    return words.bitwiseXOR(F.lit(key).cast("long"))


@dataclass
class Budget:
    """Search for a shift whose cost meets a target, by halving an interval.

    A cost below the target moves the upper end below the shift and remembers it, a cost
    above moves the lower end above it; an equal cost ends the search, and so does an empty
    interval, in favour of the last shift that fitted (the upper end if none did).
    """

    target: int
    low: float
    high: float
    step: float = 0.01
    calls: int = 0
    fitted: float = field(init=False)

    def __post_init__(self) -> None:
        self.fitted = self.high

    def run(self, cost: Callable[[float], int]) -> tuple[float, int]:
        """The shift and its cost."""
        while self.high > self.low:
            shift = (self.high + self.low) / 2
            got = cost(shift)
            self.calls += 1
            if got == self.target:
                return shift, got
            if got < self.target:
                self.fitted, self.high = shift, shift - self.step
            else:
                self.low = shift + self.step
        self.calls += 1
        return self.fitted, cost(self.fitted)


def c1_allocation(sf: Column, unit: Column, band: Column, energy: Column, shift: Column, tilt: Column, loudness: Column, spread: float = 0.4) -> Column:
    """Word length of a unit of codec 1 in a long block: 0, or 2 to 16 bits."""
    fixed, threshold = F.get(F.lit([float(v) for v in T.C1_FIXED_LONG]), unit), F.get(F.lit(T.threshold_by_unit(T.C1_WIDTHS)), unit)
    bias = F.least(F.lit(1.5), 0.3 * F.greatest(F.lit(0.0), tilt - 7))
    bias = F.when(band == 0, 0.0).when(band == 1, bias).otherwise(bias / 2)
    bits = (spread * sf / 3.2 + (1 - spread) * fixed - shift + bias).cast("int")
    return F.when((energy < threshold * loudness) | (bits < 2), 0).otherwise(F.least(bits, F.lit(16)))


def c2_allocation(sf: Column, unit: Column, fixed: Column, shift: Column, spread: Column, scale: Column) -> Column:
    """Word length of a unit of codec 2, 1 to 7; the scale index is corrected by a gain's energy ratio."""
    divisor = F.when(unit < 3, 2.8).when(unit < 10, 2.6).when(unit < 15, 3.3).when(unit <= 20, 3.6).when(unit <= 28, 4.2).otherwise(6.0)
    index = F.least(F.greatest(sf + energy_offset(scale), F.lit(0.0)), F.lit(63.0))
    bits = (spread * index / divisor + (1 - spread) * fixed - shift).cast("int")
    return F.when(bits > 7, 7).when(bits < 0, 0).when(bits == 0, 1).otherwise(bits)


def energy_offset(scale: Column) -> Column:
    """Steps of the scale index that an energy ratio amounts to; 0 for a ratio that is no positive number."""
    return F.when(scale > 0, 1.5 * F.log2(scale)).otherwise(0.0)


def quantised(x: Column, multiple: Column) -> Column:
    """Nearest integer, half to even."""
    return F.rint(x * multiple).cast("long")


def energy_aware(x: np.ndarray, multiple: float) -> np.ndarray:
    """Rounding that keeps the energy: positive values near a half may go the other way, nearest first, if the total comes closer."""
    t = x * multiple
    q = np.rint(t)
    half = np.abs(t - (np.trunc(t) + 0.5))
    want, have = float((t * t).sum()), float((q * q).sum())
    for i in sorted(np.flatnonzero(half < 0.25), key=lambda k: half[k]):
        other = np.ceil(t[i]) if q[i] == np.floor(t[i]) else np.floor(t[i])
        after = have - q[i] ** 2 + other**2
        if abs(after - want) < abs(have - want):
            q[i], have = other, after
    return q.astype(np.int64)


def pair_index(a: Column, b: Column) -> Column:
    """Symbol of two quantised values from -1 to 1."""
    return F.get(F.lit(T.C2_PAIR_INDEX), (3 * (a + 1) + (b + 1)).cast("int"))


def zigzag(v: Column) -> Column:
    """0, 1, -1, 2, -2, ... as 0, 1, 2, 3, 4, ..."""
    return F.when(v > 0, 2 * v - 1).otherwise(-2 * v)


def canonical_codes(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of a canonical prefix code; length 0 leaves a symbol out."""
    out, code, before = {}, 0, 0
    for length, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= length - before
        out[symbol], before = (code, length), length
        code += 1
    return out


def units_used(bits: Column, counts: list[int] = T.C1_UNIT_COUNTS) -> Column:
    """Index of the least unit count that covers all units with bits."""
    last = F.array_max(F.transform(bits, lambda b, i: F.when(b > 0, i + 1).otherwise(0)))
    return F.size(F.filter(F.lit(counts[:-1]), lambda c: c < last))


def container_for(bitrate: Column) -> Column:
    """Number of the first container that carries ``bitrate``; 0 asks for 132300; beyond the last one, the last."""
    wanted = F.when(bitrate == 0, 132300).otherwise(bitrate)
    return F.least(F.size(F.filter(F.lit([r[0] for r in T.C2_CONTAINERS]), lambda r: r < wanted)), F.lit(len(T.C2_CONTAINERS) - 1))


def side_bytes(mid: Column, side: Column, frame_bytes: int, most: int) -> Column:
    """Bytes that move from the side to the middle channel by their energies, ``most`` either way."""
    share = F.coalesce(F.try_divide(mid, mid + side), F.lit(0.5))
    return F.greatest(F.least((frame_bytes * (share - 0.5)).cast("int"), F.lit(most)), F.lit(-most))

"""Properties of transforms, gain control, coding, codec and tones."""

import math

import numpy as np
import pytest

from framewright.functions import tables as T
from framewright.operators import coding as C
from framewright.operators import gain as G
from framewright.operators import tones as N
from framewright.operators import transforms as L
from framewright.plans import codec as K
from framewright.plans import kernels

RNG = np.random.default_rng(7)


@pytest.mark.parametrize("n", [32, 64, 128, 256])
def test_mdct_overlap_adds_to_the_signal(n):
    x = RNG.normal(size=4 * n)
    w = np.sin((np.arange(n) + 0.5) * np.pi / n)
    half, y = n // 2, np.zeros(4 * n)
    for k in range(0, 4 * n - half, half):
        block = x[k : k + n] * w if k + n <= 4 * n else None
        if block is None:
            break
        y[k : k + n] += (L.mdct_basis(n) @ block) @ L.mdct_basis(n) * w * 4 / n
    assert np.allclose(y[half:-n], x[half:-n], atol=1e-9)


def test_filter_banks_restore_the_signal():
    x = RNG.normal(size=4096)
    for y, delay, bound in ((L.qmf_merge(*L.qmf_split(x)), 46, 2e-3), (L.c1_merge(*L.c1_split(x)), 138, 4e-3), (L.polyphase_merge(L.polyphase_split(x)), 368, 1e-2)):
        assert np.abs(y[delay + 400 : -400] - x[400 : -400 - delay]).max() < bound


def test_four_bands_are_in_order():
    t = np.arange(8192)
    for band in range(4):
        x = np.sin(np.pi * (band + 0.5) / 4 * t)
        power = [float((b[200:] ** 2).sum()) for b in L.c2_split(x)]
        assert int(np.argmax(power)) == band


@pytest.mark.parametrize(("target", "cost", "calls", "bits"), [(1000, lambda v: int(math.sqrt(-v) * 300), 8, 1000), (1000, lambda v: int(math.sqrt(-v) * 300) // 8 * 8 + 1, 11, 993)])
def test_budget_search(target, cost, calls, bits):
    b = C.Budget(target, -15.0, -1.0)
    found, got = b.run(cost)
    assert got <= target and abs(b.calls - calls) <= 1 and abs(got - bits) <= 8


def test_bits_round_trip():
    w = C.BitWriter()
    for v, n in ((101, 22), (212, 22), (323, 22), (-3, 5), (1, 1)):
        w.put(v, n)
    r = C.BitReader(w.bytes())
    assert [r.get(22) for _ in range(3)] == [101, 212, 323] and r.get_signed(5) == -3 and r.get(1) == 1
    with pytest.raises(ValueError):
        r.get(30)


def test_canonical_codes_are_prefix_free():
    codes = [format(c, f"0{n}b") for c, n in C.canonical_codes([2, 2, 3, 3, 3, 4, 4, 0]).values()]
    assert all(a == b or not b.startswith(a) for a in codes for b in codes)


def test_energy_aware_rounding_is_no_worse():
    x = RNG.uniform(0, 1, 8)
    plain = np.rint(x * 7.5)
    want = ((x * 7.5) ** 2).sum()
    assert abs((C.energy_aware(x, 7.5) ** 2).sum() - want) <= abs((plain**2).sum() - want)


def test_gain_modulation_mirrors():
    a, b = RNG.normal(size=256), RNG.normal(size=256)
    points = [(2, 4), (6, 12)]
    c, d = G.modulate(a, b, points)
    assert np.allclose(c * T.GAIN_LEVEL[2], a) and np.allclose(d * G.divisors(points), b)
    assert np.allclose(G.demodulate(c, np.zeros(256), [], points), a)
    assert G.divisors(points)[200] == 1.0 and G.divisors(points)[0] == T.GAIN_LEVEL[2]


def test_codec_round_trip():
    t = np.arange(512 * 30) / 44100
    x = 0.3 * np.sin(2 * np.pi * 440 * t) + 0.1 * np.sin(2 * np.pi * 3000 * t + 1) + 0.05 * np.sin(2 * np.pi * 9000 * t)
    frames = K.encode_samples(x)
    assert {len(f) for f in frames} == {212}
    assert K.snr(x, K.decode_samples(frames)) > (30, 0)


def test_codec_transients_and_damaged_frames():
    x = np.zeros(512 * 20)
    x[5000:5100] = RNG.normal(size=100) * 0.5
    frames = K.encode_samples(x)
    assert any(any(K.unpack(f)[1]) for f in frames)
    y = K.decode_samples([b"\xff" * 212 if k == 3 else b"" if k == 4 else f for k, f in enumerate(frames)])
    assert np.isfinite(y).all() and len(y) == len(x)


def test_codec_pieces_equal_the_whole(spark):
    rows = [("t", 0, i, 0.4 * math.sin(0.05 * i)) for i in range(512 * 12)]
    df = spark.createDataFrame(rows, "track string, ch int, i long, x double")
    got = [bytes(r.payload) for r in K.encode(df).orderBy("frame").collect()]
    assert got == K.encode_samples(np.array([r[3] for r in rows]))


def test_codec_pieces_carry_the_loudness(spark):
    """Pieces of a loud, then faint signal with a gap of more than one piece: the mean decides which units get bits."""
    n, start, gap = 512 * 530, 512 * 270, 512 * 700
    i = np.arange(n)
    x = np.where(i < 512 * 262, 0.9, 0.02) * np.sin(0.05 * i) + RNG.normal(size=n) * 3e-5
    at = i + np.where(i >= start, gap, 0)
    whole = np.zeros(n + gap)
    whole[at] = x
    want = K.encode_samples(whole)
    df = spark.createDataFrame([("t", 0, int(k), float(v)) for k, v in zip(at, x, strict=True)], "track string, ch int, i long, x double")
    got = {r.frame: bytes(r.payload) for r in K.encode(df).collect()}
    assert set(got) >= set((at // 512).tolist()) and [f for f in sorted(got) if got[f] != want[f]] == []


def test_tone_search():
    t = np.arange(128)
    x = 2.0 * np.sin(0.3 * t + 1.0) + 0.5 * np.sin(1.1 * t + 2.0)
    found = N.pursuit(x, 4)
    assert abs(found[0][0] - 0.3) < 0.01 and abs(found[0][2] - 2.0) < 0.1
    fine = N.refit(x, [f[0] for f in found[:2]])
    assert abs(fine[1][0] - 1.1) < 0.01 and abs(fine[1][2] - 0.5) < 0.05
    assert N.pursuit(np.zeros(128)) == []


def test_tone_synthesis_fades():
    y = N.synthesise([(64, 20, 0)], 128, True, True)
    assert abs(y[0]) <= abs(y[8:40]).max() and np.allclose(N.crossfade(y, y), y)


def test_tone_query_finds_all_tones(spark, tmp_path):
    """A row for every tone that the search finds above its gate, on vectors of five to ten of them."""
    t = np.arange(64)
    x = [sum((0.8**k) * np.sin((0.25 + 0.27 * k) * t + k) for k in range(n)) for n in (5, 7, 10)]
    df = spark.createDataFrame([(k, k, v.tolist()) for k, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.frame, r.tone): r.frequency for r in kernels.QUERIES["tone_pursuit"](spark, str(tmp_path)).collect()}
    assert got == {(f, k): w for f, v in enumerate(x) for k, (w, _, _) in enumerate(N.pursuit(v))}
    assert min(sum(f == g for g, _ in got) for f in range(3)) >= 5


def test_pursuit_of_many_is_the_plain_search():
    """Against one signal at a time with a least-squares solver; tones are compared as samples."""

    def plain(x, most, gate):
        rest, out, n = x.copy(), [], len(x)
        while len(out) < most and rest.any():
            spectrum = np.abs(np.fft.rfft(rest * np.hanning(n), 4 * n))
            spectrum[:4] = 0
            w, width = 2 * np.pi * spectrum.argmax() / (4 * n), np.pi / (2 * n)
            for _ in range(8):
                w = min((w + d * width for d in (-1, -0.5, 0, 0.5, 1)), key=lambda v, r=rest: N.residual(r, [v])[0])
                width /= 2
            phase, size = N.residual(rest, [w])[1][0]
            if out and size < gate * np.abs(out[0][1]):
                break
            wave = size * np.sin(w * np.arange(n) + phase)
            out.append((wave, size))
            rest = rest - wave
        return [o[0] for o in out]

    rng = np.random.default_rng(3)
    x = rng.standard_normal((12, 64))
    x[4] = 0
    x[5] = np.sin(np.pi / 2 * np.arange(64))
    for got, row in zip(N.pursuits(x, 10, 0.2), x, strict=True):
        want = plain(row, 10, 0.2)
        assert len(got) == len(want) and all(0 < w <= np.pi for w, _, _ in got)
        for (w, p, m), wave in zip(got, want, strict=True):
            assert np.allclose(m * np.sin(w * np.arange(64) + p), wave, atol=1e-6)

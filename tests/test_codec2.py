"""The second codec: units that a parser reads back, samples that come back, pieces that join."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import tables as T
from framewright.operators import coding as C
from framewright.plans import catalog, codec, codec2


def music(n, seed=1):
    t = np.arange(n)
    return 0.4 * np.sin(0.05 * t) + 0.2 * np.sin(0.31 * t + 1) + 0.05 * np.sin(1.4 * t) + 1e-3 * np.random.default_rng(seed).normal(size=n)


def test_transform_restores_the_samples():
    x = music(12 * 1024)
    y = codec2.samples(codec2.spectra(x))
    ratio, delay = codec.snr(x, y, 1300)
    assert ratio > 40 and delay == 1024 + 138


@pytest.mark.parametrize("size", [96, 152, 192, 512])
def test_units_fit_and_are_read_back(size):
    x = music(8 * 1024)
    lines = codec2.spectra(x)
    for spectrum in lines:
        data = codec2.sound_unit(spectrum, 1.0, size)
        assert len(data) == size
        back, head = codec2.parse_unit(data)
        assert head["used"] <= size * 8 and head["bands"] == 4 and (head["units"] == 1 or head["bits"][-1])
        for u, b in enumerate(head["bits"]):
            own = slice(T.C2_STARTS[u], T.C2_STARTS[u] + T.C2_WIDTHS[u])
            if b:
                step = T.SCALE[head["scale"][u]] / T.C2_MAX_QUANT[b]
                assert np.abs(back[own] - spectrum[own]).max() <= 0.76 * step + 1e-9
            else:
                assert not back[own].any()


def test_more_bits_are_better():
    x = music(16 * 1024)
    lines = codec2.spectra(x)
    found = [codec.snr(x, codec2.samples(np.array([codec2.parse_unit(codec2.sound_unit(s, 1.0, size))[0] for s in lines])), 1300)[0] for size in (96, 192, 512)]
    assert found == sorted(found) and found[1] > 15 and found[2] > 25


def test_both_codings_are_read_back():
    rng = np.random.default_rng(4)
    for selector in range(1, 8):
        most = int(T.C2_MAX_QUANT[selector])
        q = rng.integers(-most, most + 1, 64).tolist()
        costs = codec2._costs(np.array(q), selector)
        for fixed, cost in zip((True, False), costs, strict=True):
            out = C.BitWriter()
            codec2._put_lines(out, q, selector, fixed)
            assert out.length == cost
            assert codec2._get_lines(C.BitReader(out.bytes()), 64, selector, fixed) == q


def test_quantising_keeps_the_energy():
    rng = np.random.default_rng(5)
    for _ in range(50):
        v = rng.uniform(-0.9, 0.9, 16)
        plain, kept = (codec2.quantise(v, 3.5, k) for k in (False, True))
        assert (plain[0] == np.rint(v * 3.5)).all() and abs(kept[1] - 1) <= abs(plain[1] - 1) + 1e-9 or kept[1] == plain[1]
        assert np.abs(kept[0] - v * 3.5).max() < 0.7501
    assert codec2.quantise(np.zeros(8), 3.5, True)[1] == 0.0


def test_pieces_equal_the_whole(spark, monkeypatch):
    x = music(20 * 1024 + 300)
    signal = spark.createDataFrame([("t", 0, i, float(v)) for i, v in enumerate(x)], "track string, ch int, i long, x double")
    lines = codec2.spectra(x)
    level, want = 0.006, []
    for s in lines:
        level = 0.98 * level + 0.02 * float((s**2) @ codec2._curve())
        want.append(codec2.sound_unit(s, level / 0.006, 192))
    monkeypatch.setattr(codec2, "PIECE", 6)
    got = [bytes(r.payload) for r in codec2.encode(signal).orderBy("frame").collect()]
    assert got == want


def test_query(spark, sf_dir):
    rows = catalog.QUERIES["codec2_encode"](spark, sf_dir).orderBy("frame").collect()
    events = catalog.S.events(spark, sf_dir).select(F.col("x") / 600.0).collect()
    assert [r.frame for r in rows] == list(range(-(-len(events) // 1024)))
    assert all(codec2.parse_unit(bytes(r.payload))[1]["units"] >= 1 for r in rows)

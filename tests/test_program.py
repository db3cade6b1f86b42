"""The program over sound files: encode, decode, containers, refusals."""

import json

import numpy as np
import pytest

from framewright import program
from framewright.plans import codec, codec2
from framewright.sources import containers as B

RNG = np.random.default_rng(5)
T = np.arange(512 * 9)
STEREO = np.stack([0.4 * np.sin(T * 0.07), 0.2 * np.sin(T * 0.31) + 0.01 * RNG.standard_normal(len(T))], 1)


def _wav(path, x):
    path.write_bytes(B.wav_bytes(x))
    return B.parse_samples(path.read_bytes())[1]


def test_first_codec_there_and_back(spark, tmp_path):
    x = _wav(tmp_path / "song.wav", STEREO)
    assert program.main(["-e", "-i", str(tmp_path / "song.wav"), "-o", str(tmp_path / "song.aea")]) == 0
    channels, title, frames = B.parse_aea((tmp_path / "song.aea").read_bytes())
    want = [codec.encode_samples(x[:, c]) for c in range(2)]
    assert (channels, title) == (2, "song") and frames[1:] == [f for pair in zip(*want, strict=True) for f in pair][1:]
    assert program.main(["-d", "-i", str(tmp_path / "song.aea"), "-o", str(tmp_path / "back.wav")]) == 0
    rate, back = B.parse_samples((tmp_path / "back.wav").read_bytes())
    assert rate == 44100 and back.shape == x.shape and codec.snr(x[512:, 1], back[512:, 1])[0] > 15


def test_second_codec_containers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in "ab":
        _wav(tmp_path / "in" / f"{name}.wav", STEREO[:3000] * (1 if name == "a" else 0.5))
    out = tmp_path / "out"
    assert program.main(["--encode", "c2", "-i", str(tmp_path / "in"), "-o", str(out), "--log", str(tmp_path / "log")]) == 0
    assert sorted(p.name for p in out.iterdir()) == ["a.oma", "b.oma"]
    info, frames = B.parse_oma((out / "a.oma").read_bytes())
    x = B.parse_samples((tmp_path / "in" / "a.wav").read_bytes())[1]
    assert info["codec"] == "c2" and info["frame_bytes"] == 384 and len(frames) == 3 and not info["joint"]
    rows = spark.createDataFrame([("a", c, i, float(x[i, c])) for c in range(2) for i in range(len(x))], "track string, ch int, i long, x double")
    units = {(r.frame, r.ch): bytes(r.payload) for r in codec2.encode(rows, 192).collect()}
    assert frames == [units[f, 0] + units[f, 1] for f in range(3)]
    log = [json.loads(line) for p in (tmp_path / "log").glob("*.json") for line in p.read_text().splitlines()]
    assert {r["track"] for r in log} == {"a", "b"} and {"verdict", "start"} <= set(log[0]["first"]) and len(log[0]["level"]) == 32


def test_mono_twice_in_riff(spark, tmp_path):
    _wav(tmp_path / "m.wav", STEREO[:2048, :1])
    assert program.main(["--encode", "c2", "-i", str(tmp_path / "m.wav"), "-o", str(tmp_path / "m.at3"), "--bitrate", "300"]) == 0
    data = (tmp_path / "m.at3").read_bytes()
    body = data[data.index(b"data") + 8 :]
    assert data[:4] == b"RIFF" and len(body) == 2 * 1024 and body[:512] == body[512:1024]


@pytest.mark.parametrize(
    "args",
    [
        ["-e", "c1", "-o", "x.oma", "--container", "oma"], ["-e", "c2", "-o", "x.oma", "--bitrate", "10"], ["-e", "c2", "-o", "x.oma", "--bitrate", "64"], ["-d", "-o", "x.wav"],
        ["-e", "c1", "-o", "x.aea", "--bitrate", "64"], ["-e", "c2", "-o", "x.oma", "--advanced", "a=1"], ["-d", "-o", "x.wav", "--container", "raw"],
    ],
)
def test_refusals(spark, tmp_path, args, capsys):
    _wav(tmp_path / "m.wav", STEREO[:600])
    args[args.index("-o") + 1] = str(tmp_path / args[args.index("-o") + 1])
    assert program.main([*args, "-i", str(tmp_path / "m.wav")]) == 1 and capsys.readouterr().err
    assert sorted(p.name for p in tmp_path.iterdir()) == ["m.wav"]


def test_unreadable_file_is_named(spark, tmp_path, capsys):
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    assert program.main(["-e", "-i", str(tmp_path / "bad.wav"), "-o", str(tmp_path / "o.aea")]) == 1
    assert "bad.wav" in capsys.readouterr().err

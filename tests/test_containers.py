"""Containers, sources, sinks, legality."""

import numpy as np
import pytest

from framewright.sources import containers as B

FRAMES = [bytes([k]) * 212 for k in range(7)]


def test_aea():
    channels, title, frames = B.parse_aea(B.aea_bytes(FRAMES, 1, "a title that is too long"))
    assert (channels, title) == (1, "a title that is") and frames[1:] == FRAMES[1:] and frames[0] == b"\0" * 212
    assert B.aea_length(2048 + 212 * 7, 1) == 1024 and B.aea_length(2048, 2) == 0
    with pytest.raises(B.BadFile):
        B.parse_aea(b"\1" * 3000)


@pytest.mark.parametrize(("codec", "size", "bitrate"), [("c2", 384, 132300), ("c3", 2048, 352800)])
def test_oma(codec, size, bitrate):
    frames = [bytes([k]) * size for k in range(3)]
    info, back = B.parse_oma(B.oma_bytes(frames, codec))
    assert back == frames and info["codec"] == codec and info["bitrate"] == bitrate and info["frame_bytes"] == size
    with pytest.raises(B.BadFile):
        B.parse_oma(b"EA3" + b"\0" * 93)


def test_riff_headers():
    data = B.riff_bytes([b"x" * 384] * 5, 2, True)
    assert data[:4] == b"RIFF" and len(data) == 76 + 5 * 384 and int.from_bytes(data[4:8], "little") == len(data) - 8
    wide = B.riff_extensible_bytes([b"x" * 2048] * 2)
    assert wide[20:22] == b"\xfe\xff" and int.from_bytes(wide[4:8], "little") == len(wide) - 8


def test_real_media():
    frames = [bytes(range(192))] * 4
    data = B.rm_bytes(frames)
    assert data[:4] == b".RMF" and B.scramble(B.scramble(frames[0])) == frames[0]
    packets = B.rm_packets(frames)
    assert len(packets) == 4 * 192 + 2 * 12 and packets[12:204] == B.scramble(frames[0])
    assert B.raw_bytes([b"abc"], 2) == b"ab" and B.raw_bytes([b"abc"], 5) == b"abc\0\0"


def test_legality():
    assert B.container_of("x.AEA", "c1") == "aea" and B.container_of("x.bin", "c2", "rm") == "rm"
    for path, codec in (("x.oma", "c1"), ("x.rm", "c3"), ("x.txt", "c2")):
        with pytest.raises(ValueError):
            B.container_of(path, codec)


def test_sound_files(spark, tmp_path):
    x = np.stack([np.sin(np.arange(1000) / 9), np.cos(np.arange(1000) / 7)], 1) * 0.5
    (tmp_path / "é-入力.wav").write_bytes(B.wav_bytes(x))
    (tmp_path / "b.au").write_bytes(B.au_bytes(x[:100]))
    (tmp_path / "c.wav").write_bytes(B.wav_bytes(x[:10], 48000))
    (tmp_path / "d.wav").write_bytes(b"no sound")
    rows = B.read_samples(spark, str(tmp_path)).collect()
    assert {r.track for r in rows if r.error} == {"c", "d"}
    got = sorted((r.i, r.x) for r in rows if r.track == "é-入力" and r.ch == 1)
    assert len(got) == 1000 and np.allclose([g[1] for g in got], x[:, 1], atol=1 / 32768)


def test_sample_formats():
    x = np.linspace(-1, 1, 60).reshape(-1, 2)
    for data in (B.aiff_bytes(x), B.wav_bytes(x), B.au_bytes(x)):
        rate, back = B.parse_samples(data)
        assert rate == 44100 and np.allclose(back, np.minimum(x, 32767 / 32768), atol=1 / 65536 + 1e-9)
    assert B.raw_pcm_bytes(x) == B.wav_bytes(x)[44:]
    whole = np.array([-8388608, -1, 0, 1, 8388607, 70000])
    for order in ("little", "big"):
        body = b"".join(int(v).to_bytes(3, order, signed=True) for v in whole)
        head = b"RIFF\0\0\0\0WAVEfmt " + (16).to_bytes(4, "little") + b"\1\0\1\0" + (44100).to_bytes(4, "little") + b"\0" * 6 + (24).to_bytes(2, "little") + b"data" + len(body).to_bytes(4, "little")
        au = b".snd" + b"".join(v.to_bytes(4, "big") for v in (24, len(body), 4, 44100, 1))
        assert (B.parse_samples((head if order == "little" else au) + body)[1][:, 0] * 8388608 == whole).all()
    for cut in (b"RIFF", b"RIFF\0\0\0\0WAVE", b".snd\0", b""):
        with pytest.raises(B.BadFile):
            B.parse_samples(cut)


def test_data_source_spans_join(spark, tmp_path):
    spark.dataSource.register(B.SoundFiles)
    x = np.stack([np.arange(500), -np.arange(500)], 1) / 32768
    (tmp_path / "t.aiff").write_bytes(B.aiff_bytes(x))
    rows = spark.read.format("sound").option("span", 70).load(str(tmp_path)).orderBy("ch", "i").collect()
    assert [(r.track, r.ch, r.i, round(r.x * 32768)) for r in rows] == [("t", c, i, i * (1 - 2 * c)) for c in range(2) for i in range(500)]


def test_data_source_reads_and_writes(spark, tmp_path):
    spark.dataSource.register(B.SoundFiles)
    files = spark.createDataFrame([("one", bytearray(B.wav_bytes(np.zeros((50, 1))))), ("two", bytearray(B.wav_bytes(np.ones((30, 1)) * 0.25)))], "track string, content binary")
    files.write.format("sound").mode("append").save(str(tmp_path / "out"))
    back = spark.read.format("sound").option("span", 20).load(str(tmp_path / "out"))
    assert {(r.track, r["count"]) for r in back.groupBy("track").count().collect()} == {("one", 50), ("two", 30)}


def test_frames_from_files(spark, tmp_path):
    (tmp_path / "t.aea").write_bytes(B.aea_bytes(FRAMES, 1, "t"))
    rows = B.read_frames(spark, str(tmp_path), "aea").orderBy("n").collect()
    assert [bytes(r.payload) for r in rows][1:] == FRAMES[1:] and "channels=1" in rows[0].info


def test_samples_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def drain():
        rows = B.stream_samples(spark, str(tmp_path / "in"), files_a_batch=1)
        sink = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        sink.awaitTermination()
        return {(r.track, r.ch, r.i): (r.x, r.error) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    x = np.arange(40).reshape(-1, 2) / 64
    (tmp_path / "in" / "one.au").write_bytes(B.au_bytes(x))
    (tmp_path / "in" / "bad.au").write_bytes(b".snd")
    first = drain()
    assert {k: v[0] for k, v in first.items() if k[0] == "one"} == {("one", c, i): x[i, c] for c in range(2) for i in range(20)}
    assert first["bad", None, None][1]
    (tmp_path / "in" / "two.au").write_bytes(B.au_bytes(x[:3]))
    later = drain()
    assert set(later) - set(first) == {("two", c, i) for c in range(2) for i in range(3)} and len(later) == 47

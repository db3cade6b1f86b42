"""Container formats: WAV, AU and AIFF samples; AEA, OMA, RIFF, RealMedia and raw frames.

Reading goes through Spark's ``binaryFile`` reader, so that any store Spark knows will do;
a kernel parses each file. Writing assembles a file's bytes from the frames of its track,
in order; headers that need counts get them from the frames (there is nothing to patch
afterwards). The ``sound`` data source reads spans of local or shared files and writes one
file a track, under a temporary name that the commit renames.
"""

from __future__ import annotations

import mmap
import os
import struct
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

RATE = 44100
#: Which containers may hold which codec. Fixed values.
LEGAL = {"c1": ("aea", "raw"), "c2": ("oma", "riff", "rm", "raw"), "c3": ("oma", "riff", "raw")}
EXTENSIONS = {"aea": "aea", "oma": "oma", "omg": "oma", "at3": "riff", "wav": "riff", "rm": "rm", "raw": "raw"}
#: Sample rates and codec names of the OMA header. Fixed values.
OMA_RATES = (32000, 44100, 48000, 88200, 96000)
OMA_CODECS = {0: "c2", 1: "c3"}
SCRAMBLE = 0x537F6103


class BadFile(ValueError):
    """A file that its format does not allow."""


# --- Samples ---


class Layout(NamedTuple):
    """Where and how the samples of a file lie: bytes ``start`` to ``stop``, ``bits`` a sample, ``order`` as in struct."""

    rate: int
    channels: int
    bits: int
    order: str
    real: bool
    start: int
    stop: int

    @property
    def width(self) -> int:
        return self.bits // 8 * self.channels

    @property
    def frames(self) -> int:
        return max(0, self.stop - self.start) // self.width

    def read(self, data: bytes | mmap.mmap, first: int, last: int) -> np.ndarray:
        """Samples ``first`` to ``last`` (n, channels) in [-1, 1]; only their bytes are touched."""
        body = data[self.start + first * self.width : self.start + min(last, self.frames) * self.width]
        size = self.bits // 8
        if self.real:
            return np.frombuffer(body, f"{self.order}f{size}").astype(np.float64).reshape(-1, self.channels)
        if self.bits == 8 and self.order == "<":
            x = np.frombuffer(body, np.uint8).astype(np.float64) - 128
        elif self.bits == 24:
            raw = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
            low, mid, high = raw.T if self.order == "<" else raw[:, ::-1].T
            x = ((high << 24 | mid << 16 | low << 8) >> 8).astype(np.float64)
        else:
            x = np.frombuffer(body, f"{self.order}i{size}").astype(np.float64)
        return (x / 2.0 ** (self.bits - 1)).reshape(-1, self.channels)


def _wav(data: bytes | mmap.mmap) -> Layout:
    if data[8:12] != b"WAVE":
        raise BadFile("no WAVE form")
    at, fmt = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", data, at + 8)
        elif name == b"data" and fmt:
            return Layout(fmt[2], fmt[1], fmt[5], "<", fmt[0] == 3, at + 8, min(len(data), at + 8 + size))
        at += 8 + size + size % 2
    raise BadFile("no samples")


def _au(data: bytes | mmap.mmap) -> Layout:
    offset, _, encoding, rate, channels = struct.unpack_from(">5I", data, 4)
    bits = {2: 8, 3: 16, 4: 24, 5: 32, 6: 32}.get(encoding)
    if bits is None:
        raise BadFile(f"encoding {encoding}")
    return Layout(rate, channels, bits, ">", encoding == 6, offset, len(data))


def _aiff(data: bytes | mmap.mmap) -> Layout:
    at, form, rate = 12, None, 0
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from(">I", data, at + 4)[0]
        if name == b"COMM":
            form = struct.unpack_from(">hIh", data, at + 8)
            exponent, mantissa = struct.unpack_from(">HQ", data, at + 16)
            rate = round(mantissa * 2.0 ** (exponent - 16383 - 63))
        elif name == b"SSND" and form:
            return Layout(rate, form[0], form[2], ">", False, at + 16, min(len(data), at + 8 + size))
        at += 8 + size + size % 2
    raise BadFile("no samples")


def layout(data: bytes | mmap.mmap) -> Layout:
    """The layout of a WAV, AU or AIFF file, from its headers alone."""
    try:
        for magic, parse in ((b"RIFF", _wav), (b".snd", _au), (b"FORM", _aiff)):
            if data[:4] == magic:
                found = parse(data)
                if found.channels < 1 or found.bits not in (8, 16, 24, 32) and not (found.real and found.bits == 64):
                    raise BadFile("a sample format that is not known")
                return found
    except struct.error as x:
        raise BadFile("the file is cut off") from x
    raise BadFile("an unknown format")


def parse_samples(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples (n, channels) in [-1, 1] of a WAV, AU or AIFF file."""
    found = layout(data)
    return found.rate, found.read(data, 0, found.frames)


def _whole(x: np.ndarray, order: str) -> bytes:
    return np.clip(np.rint(np.atleast_2d(x) * 32768), -32768, 32767).astype(f"{order}i2").tobytes()


def raw_pcm_bytes(x: np.ndarray) -> bytes:
    """16-bit little-endian samples (n, channels) without a header, limited to [-1, 1]."""
    return _whole(x, "<")


def aiff_bytes(x: np.ndarray, rate: int = RATE) -> bytes:
    """A 16-bit AIFF file of samples (n, channels), limited to [-1, 1]."""
    body = _whole(x, ">")
    exponent = rate.bit_length() - 1
    common = struct.pack(">hIhHQ", x.shape[1], len(x), 16, 16383 + exponent, rate << 63 - exponent)
    chunks = b"COMM" + struct.pack(">I", len(common)) + common + b"SSND" + struct.pack(">III", len(body) + 8, 0, 0) + body
    return b"FORM" + struct.pack(">I", len(chunks) + 4) + b"AIFF" + chunks


def wav_bytes(x: np.ndarray, rate: int = RATE) -> bytes:
    """A 16-bit WAV file of samples (n, channels), limited to [-1, 1]."""
    body = _whole(x, "<")
    channels = np.atleast_2d(x).shape[1]
    fmt = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * 2, channels * 2, 16)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(body)) + body


def au_bytes(x: np.ndarray, rate: int = RATE) -> bytes:
    """A 16-bit AU file."""
    body = _whole(x, ">")
    return b".snd" + struct.pack(">5I", 24, len(body), 3, rate, np.atleast_2d(x).shape[1]) + body


# --- Frames ---


def aea_bytes(frames: list[bytes], channels: int = 1, title: str = "") -> bytes:
    """A 2048-byte header, one silent frame in place of the first one, then the frames of 212 bytes, channels in turn."""
    head = bytearray(2048)
    head[:4] = b"\0\x08\0\0"
    name = title.encode()[:15]
    head[4 : 4 + len(name)] = name
    head[260:264] = struct.pack("<I", len(frames))
    head[264] = channels
    return bytes(head) + b"\0" * 212 * bool(frames) + b"".join(f[:212].ljust(212, b"\0") for f in frames[1:])


def parse_aea(data: bytes) -> tuple[int, str, list[bytes]]:
    """Channels, title and frames."""
    if data[:4] != b"\0\x08\0\0" or len(data) < 2048 or not 0 < data[264] < 3:
        raise BadFile("no AEA header")
    body = data[2048:]
    return data[264], data[4:20].split(b"\0")[0].decode("utf-8", "replace"), [body[k : k + 212] for k in range(0, len(body) - 211, 212)]


def aea_length(size: int, channels: int) -> int:
    """Samples of a channel in a file of ``size`` bytes, never negative."""
    return max(0, 512 * ((size - 2048) // 212 // channels - 5))


def oma_bytes(frames: list[bytes], codec: str, joint: bool = False, channels: int = 2, rate: int = RATE) -> bytes:
    """A 96-byte header with the codec's parameters in 32 bits, then the frames."""
    size = len(frames[0]) if frames else 8
    rate_bits = OMA_RATES.index(rate) << 13
    if codec == "c2":
        params = int(joint) << 17 | rate_bits | size // 8
    else:
        params = 1 << 24 | rate_bits | channels << 10 | (size - 8) // 8
    head = bytearray(96)
    head[:8] = b"EA3\x01\0\x60\xff\xff"
    head[32:36] = struct.pack(">I", params)
    return bytes(head) + b"".join(f[:size].ljust(size, b"\0") for f in frames)


def parse_oma(data: bytes) -> tuple[dict, list[bytes]]:
    """Header fields and frames."""
    if data[:3] != b"EA3" or len(data) < 96:
        raise BadFile("no EA3 header")
    if data[6:8] != b"\xff\xff":
        raise BadFile("an encrypted file")
    params = struct.unpack_from(">I", data, 32)[0]
    codec = OMA_CODECS.get(params >> 24)
    rate_index = params >> 13 & 7
    if codec is None or rate_index >= len(OMA_RATES):
        raise BadFile("an unknown codec or rate")
    size = (params & 0x3FF) * 8 + (8 if codec == "c3" else 0)
    rate = OMA_RATES[rate_index]
    info = {"codec": codec, "rate": rate, "frame_bytes": size, "joint": bool(params >> 17 & 1) if codec == "c2" else False, "bitrate": rate * size * 8 // (1024 if codec == "c2" else 2048)}
    if not size:
        raise BadFile("frames without bytes")
    return info, [data[k : k + size] for k in range(96, len(data) - size + 1, size)]


def riff_bytes(frames: list[bytes], channels: int = 2, joint: bool = False) -> bytes:
    """A RIFF file of the second codec: format 0x270 with its 14 extra bytes, and a fact chunk."""
    size = len(frames[0]) if frames else 0
    fmt = struct.pack("<HHIIHHH", 0x270, channels, RATE, size * RATE // 1024, size, 0, 14) + struct.pack("<HIHHHH", 1, 0x1000, int(joint), int(joint), 1, 0)
    body = b"".join(frames)
    rest = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<III", 8, len(frames) * 1024, 1024) + b"data" + struct.pack("<I", len(body))
    return b"RIFF" + struct.pack("<I", len(rest) + len(body)) + rest + body


def riff_extensible_bytes(frames: list[bytes], channels: int = 2) -> bytes:
    """A RIFF file of the third codec: an extensible format with the channel mask and the codec's identifier."""
    size = len(frames[0]) if frames else 0
    guid = uuid.UUID("e923aabf-cb58-4471-a119-fffa01e4ce62").bytes_le
    fmt = struct.pack("<HHIIHHH", 0xFFFE, channels, RATE, size * RATE // 2048, size, 0, 34) + struct.pack("<HI", 2048, 3 if channels == 2 else 4) + guid + b"\x01\0" + b"\0" * 10
    body = b"".join(frames)
    rest = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<III", 8, len(frames) * 2048, 2048) + b"data" + struct.pack("<I", len(body))
    return b"RIFF" + struct.pack("<I", len(rest) + len(body)) + rest + body


def scramble(data: bytes) -> bytes:
    """32-bit words xor the key of the RealMedia payload; a rest of under 4 bytes stays."""
    n = len(data) // 4 * 4
    return (np.frombuffer(data[:n], ">u4") ^ np.uint32(SCRAMBLE)).astype(">u4").tobytes() + data[n:]


def rm_packets(frames: list[bytes]) -> bytes:
    """The data packets: before every third frame a 12-byte header, whose time stamp is a function of the frame's number."""
    out = []
    for k, frame in enumerate(frames):
        if k % 3 == 0:
            out.append(struct.pack(">HHHIBB", 0, 3 * len(frame) + 12, 0, int(k * 1000 * 1024 / RATE), 0, 2))
        out.append(scramble(frame))
    return b"".join(out)


def rm_bytes(frames: list[bytes], channels: int = 2, joint: bool = False) -> bytes:
    """A RealMedia file: file, properties, stream and data chunks, then the packets."""
    size, n = (len(frames[0]) if frames else 0), len(frames)
    bitrate, duration = int(8 * size * RATE / 1024), int(n * 1000 * 1024 / RATE)
    codec = b".ra\xfd" + struct.pack(">HH", 5, 0) + b".ra5" + struct.pack(">IHIHIIII", 0x01B53530, 5, 0, 2, size * 3, 0x51540, bitrate // 8 * 60, bitrate // 8 * 60)
    codec += struct.pack(">HHHH", 1, size * 3, size, 0) + struct.pack(">HHHHHHH", 0, RATE, 0, RATE, 0, 16, 2) + b"genr" + b"atrc" + b"\x01\x07\0\0" + struct.pack(">IIHHH", 10, 4, 1024 * channels, 0x88E, 0x12 if joint else 2)
    mime, text = b"audio/x-pn-realaudio", b"Audio Stream"
    stream = struct.pack(">HHIIIIIII", 0, 0, bitrate, bitrate, size * 3, size * 3, 0, 0, duration) + bytes([len(text)]) + text + bytes([len(mime)]) + mime + struct.pack(">I", len(codec)) + codec
    stream = b"MDPR" + struct.pack(">I", len(stream) + 8) + stream
    packets = rm_packets(frames)
    prop = struct.pack(">HIIIIIIIIIHH", 0, bitrate, bitrate, size * 3, size * 3, n, duration, 0, 0, 18 + 50 + len(stream), 1, 0)
    prop = b"PROP" + struct.pack(">I", len(prop) + 8) + prop
    return b".RMF" + struct.pack(">IHII", 18, 0, 0, 4) + prop + stream + b"DATA" + struct.pack(">IHII", 18 + len(packets), 0, n, 0) + packets


def raw_bytes(frames: list[bytes], size: int | None = None) -> bytes:
    """Bare frames, each cut or filled to ``size``."""
    return b"".join(f if size is None else f[:size].ljust(size, b"\0") for f in frames)


def container_of(path: str, codec: str, named: str | None = None) -> str:
    """The container by name, else by extension; an error where it cannot hold the codec."""
    kind = named or EXTENSIONS.get(path.rsplit(".", 1)[-1].lower(), "")
    if kind not in LEGAL[codec]:
        raise ValueError(f"{codec} cannot be stored as {kind or path!r}")
    return kind


# --- Spark ---

_READ = "path string, track string, rate int, ch int, i long, x double, error string"


def _parsed(files: DataFrame, rate: int | None) -> DataFrame:
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for where, data in zip(pdf["path"], pdf["content"], strict=True):
                track = os.path.splitext(os.path.basename(where))[0]
                try:
                    found, x = parse_samples(data)
                    if rate and found != rate:
                        raise BadFile(f"sample rate {found}")
                except BadFile as e:
                    yield pd.DataFrame({"path": [where], "track": [track], "rate": [None], "ch": [None], "i": [None], "x": [None], "error": [str(e)]})
                    continue
                for first in range(0, len(x), 65536):
                    part = x[first : first + 65536]
                    for c in range(x.shape[1]):
                        yield pd.DataFrame({"path": where, "track": track, "rate": found, "ch": c, "i": np.arange(first, first + len(part)), "x": part[:, c], "error": None})

    return files.select("path", "content").mapInPandas(parse, _READ)


def read_samples(spark: SparkSession, path: str, rate: int | None = RATE) -> DataFrame:
    """(path, track, rate, ch, i, x, error) of the sound files at ``path``; a file that cannot be read, or has another rate, gives one row with its error."""
    return _parsed(spark.read.format("binaryFile").load(path), rate)


def stream_samples(spark: SparkSession, path: str, rate: int | None = RATE, files_a_batch: int = 64) -> DataFrame:
    """The same as an unbounded stream: files that arrive in the folder ``path`` follow each other.

    A channel that never ends comes as a series of files, each with its own track name; a
    file must appear whole, that is by a rename.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return _parsed(spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_a_batch).load(path), rate)


def read_frames(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(path, track, info, n, payload, error) of AEA or OMA files; n numbers the frames of a file."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for where, data in zip(pdf["path"], pdf["content"], strict=True):
                track = os.path.splitext(os.path.basename(where))[0]
                try:
                    if kind == "aea":
                        channels, title, frames = parse_aea(data)
                        info = f"channels={channels},title={title},samples={aea_length(len(data), channels)}"
                    else:
                        fields, frames = parse_oma(data)
                        info = ",".join(f"{k}={v}" for k, v in fields.items())
                except BadFile as e:
                    yield pd.DataFrame({"path": [where], "track": [track], "info": [None], "n": [None], "payload": [None], "error": [str(e)]})
                    continue
                yield pd.DataFrame({"path": where, "track": track, "info": info, "n": range(len(frames)), "payload": frames, "error": None})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, track string, info string, n long, payload binary, error string")


def assemble(frames: DataFrame, build: Callable[[list[bytes]], bytes]) -> DataFrame:
    """(track, content) of frames (track, ch, frame, payload): channels of a frame follow each other. A file is one value, so a track must fit in a task."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("frame", "ch", "payload"))), lambda s: s["payload"])
    joined = frames.groupBy("track").agg(ordered.alias("frames"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"track": pdf["track"], "content": [build(list(f)) for f in pdf["frames"]]})

    return joined.mapInPandas(run, "track string, content binary")


class _Message(WriterCommitMessage):
    def __init__(self, names: list[tuple[str, str]]):
        self.names = names


class _Writer(DataSourceWriter):
    """Each task writes temporary files; the commit renames them, an abort removes them."""

    def __init__(self, path: str, extension: str):
        self.path, self.extension = path, extension

    def write(self, rows):
        names = []
        os.makedirs(self.path, exist_ok=True)
        for row in rows:
            name = os.path.join(self.path, f"{row.track}.{self.extension}")
            held = os.path.join(self.path, f".{uuid.uuid4().hex}.part")
            with open(held, "wb") as f:
                f.write(row.content)
                f.flush()
                os.fsync(f.fileno())
            names.append((held, name))
        return _Message(names)

    def commit(self, messages):
        for m in messages:
            for held, name in m.names if m else ():
                os.replace(held, name)

    def abort(self, messages):
        for m in messages:
            for held, _ in m.names if m else ():
                if os.path.exists(held):
                    os.remove(held)


class _Span(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class _Reader(DataSourceReader):
    """A partition for each run of samples of a file, so that one long file is read by many tasks."""

    def __init__(self, path: str, span: int):
        self.path, self.span = path, span

    def _files(self) -> list[str]:
        return sorted(os.path.join(self.path, n) for n in os.listdir(self.path) if not n.startswith(".")) if os.path.isdir(self.path) else [self.path]

    def partitions(self):
        out = []
        for name in self._files():
            with _mapped(name) as data:
                n = layout(data).frames
            out += [_Span(name, k, min(n, k + self.span)) for k in range(0, n, self.span)]
        return out

    def read(self, partition):
        """Arrow batches of the span; of the file, its headers and the bytes of the span are touched."""
        track = os.path.splitext(os.path.basename(partition.path))[0]
        with _mapped(partition.path) as data:
            found = layout(data)
            for first in range(partition.first, partition.last, 65536):
                x = found.read(data, first, min(partition.last, first + 65536))
                n = len(x)
                for c in range(found.channels):
                    i = np.arange(first, first + n)
                    yield pa.RecordBatch.from_arrays([pa.array([track] * n, pa.string()), pa.array(np.full(n, c, np.int32)), pa.array(i, pa.int64()), pa.array(np.ascontiguousarray(x[:, c]))], ["track", "ch", "i", "x"])


@contextmanager
def _mapped(name: str) -> Iterator[bytes | mmap.mmap]:
    with open(name, "rb") as f:
        if not os.path.getsize(name):
            yield b""
            return
        with mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            yield data


class SoundFiles(DataSource):
    """``sound``: reads (track, ch, i, x) from a folder of sound files, writes (track, content) rows as files.

    For folders that all workers can open, given by plain or ``file:`` paths. Options: path,
    span (samples a partition), extension (of written files).
    """

    @classmethod
    def name(cls):
        return "sound"

    def schema(self):
        return "track string, ch int, i long, x double"

    def _path(self) -> str:
        where = urlparse(self.options["path"])
        if where.scheme not in ("", "file"):
            raise ValueError("use read_samples for stores that only Spark opens")
        return where.path

    def reader(self, schema):
        return _Reader(self._path(), int(self.options.get("span", 1 << 20)))

    def writer(self, schema, overwrite):
        return _Writer(self._path(), self.options.get("extension", "wav"))

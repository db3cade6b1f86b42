"""Media columns in GIF: LZW code streams, palettes, disposal, transparency, timed frames.

``store`` writes a byte payload losslessly as the colour indices of a GIF (one index a
byte, 64 to a row, a frame for every ``ROWS`` rows). ``frames`` decodes any GIF into a
table of timed frames with colour-histogram columns, and ``digest`` reads a stored
payload back out of the composed frames.

An LZW stream is decoded by segments, from one clear code to the next. Within a segment
the width of every code follows from its number alone, so all codes are cut out at once.
Table entry j is the string of code j with one more symbol, which in the output is the
text that begins where code j begins; so each code is a literal or a copy of earlier
output. Lengths and literals are found by pointer jumping over arrays, not code by code.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WIDTH, ROWS, DELAY = 64, 1024, 10
CLEAR, STOP, FIRST, FULL = 256, 257, 258, 4096
#: The encoder clears its table before it is full, where decoders are known to differ.
LAST = 4094
BINS = 8
SLICE = 128

_GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
#: By number of a code after a clear: how many bits it has, and at which bit it begins (8-bit colours).
_BITS = np.array([9 if i == 0 else min(12, int(FIRST + i - 1).bit_length()) for i in range(FULL + 2)], np.int64)
_AT = np.concatenate([[0], np.cumsum(_BITS)])


class Malformed(ValueError):
    """The bytes are not a GIF that can be read."""


def _codes(data: bytes) -> list[int]:
    out = [CLEAR]
    emit = out.append
    table: dict[int, int] = {}
    known = table.get
    free = FIRST
    it = iter(data)
    w = next(it)
    for b in it:
        key = w << 8 | b
        c = known(key)
        if c is not None:
            w = c
            continue
        emit(w)
        table[key] = free
        free += 1
        w = b
        if free == LAST:
            emit(CLEAR)
            table.clear()
            free = FIRST
    emit(w)
    emit(STOP)
    return out


def compress(data: bytes) -> bytes:
    """The LZW code stream of 8-bit symbols; ``data`` is not empty."""
    codes = np.array(_codes(data), np.int64)
    clear = np.flatnonzero(codes == CLEAR)
    number = np.arange(len(codes)) - np.repeat(clear + 1, np.diff(np.append(clear, len(codes))))
    number[clear[1:]] = np.diff(clear) - 1
    bits = _BITS[np.maximum(number, 0)]
    at = np.cumsum(bits) - bits
    stream = np.zeros(int(at[-1] + bits[-1]) + 12, np.uint8)
    for k in range(12):
        if k < 9:
            stream[at + k] = codes >> k & 1
        else:
            wide = bits > k
            stream[at[wide] + k] = codes[wide] >> k & 1
    return np.packbits(stream[: int(at[-1] + bits[-1])], bitorder="little").tobytes()


def _bits_of(n: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths and first bits of the codes after a clear, for symbols of ``low`` bits."""
    if low == 8 and n <= FULL:
        return _BITS[:n], _AT[:n]
    first = (1 << low) + 2
    filled = np.minimum(first + np.maximum(np.arange(n, dtype=np.int64) - 1, 0), FULL - 1)
    bits = np.maximum(low + 1, np.floor(np.log2(filled)).astype(np.int64) + 1)
    return bits, np.cumsum(bits) - bits


def _segment(codes: np.ndarray, low: int) -> np.ndarray:
    """Symbols of the codes between two clears."""
    m = len(codes)
    entry = codes - ((1 << low) + 2)
    literal = codes < (1 << low)
    if not literal[0] or np.any(entry >= np.arange(m)):
        raise Malformed("a code refers to an entry that isn't there")
    above = np.where(literal, m, entry)
    jump = np.append(above, m)
    length = np.append(np.ones(m, np.int64), 0)
    while np.any(jump != m):
        length = length + length[jump]
        jump = jump[jump]
    length = length[:m]
    begin = np.cumsum(length) - length
    back = np.where(literal, 0, begin - begin[np.where(literal, 0, entry)])
    source = np.arange(int(length.sum())) - np.repeat(back, length)
    while True:
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    symbols = np.zeros(len(source), np.uint8)
    symbols[begin[literal]] = codes[literal]
    return symbols[source]


def decompress(stream: bytes, low: int, count: int) -> np.ndarray:
    """``count`` symbols of an LZW code stream whose symbols have ``low`` bits."""
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.int64)
    limit, bit, done, out = len(stream) * 8, 0, 0, []
    while done < count:
        most = min((limit - bit) // (low + 1), FULL)
        if most <= 0:  # not one whole code is left
            break
        while True:
            width, at = _bits_of(most, low)
            fits = int(np.searchsorted(at + width, limit - bit, "right"))
            at, width = at[:fits] + bit, width[:fits]
            byte = at >> 3
            codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (at & 7) & ((1 << width) - 1)
            ends = np.flatnonzero((codes >> 1) == (1 << low - 1))  # clear or stop
            if len(ends) or fits < most:
                break
            most *= 4  # the table is full and no clear has come: codes go on at 12 bits
        n = int(ends[0]) if len(ends) else len(codes)
        if n:
            out.append(_segment(codes[:n], low))
            done += len(out[-1])
        if not len(ends):
            break
        bit = int(at[n] + width[n])
        if codes[n] == (1 << low) + 1:
            break
    symbols = np.concatenate(out) if out else np.zeros(0, np.uint8)
    if len(symbols) < count:
        raise Malformed("the code stream ends early")
    return symbols[:count]


@dataclass
class Frame:
    """A decoded frame, and the canvas after it was drawn."""

    number: int
    delay_ms: int
    left: int
    top: int
    width: int
    height: int
    disposal: int
    transparent: int | None
    canvas: np.ndarray

    @property
    def pixels(self) -> np.ndarray:
        """RGB of the frame's own rectangle of the canvas."""
        return self.canvas[self.top : self.top + self.height, self.left : self.left + self.width]

    def histogram(self, channel: int) -> np.ndarray:
        return np.bincount(self.pixels[:, :, channel].reshape(-1) >> 5, minlength=BINS)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        n = data[at]
        at += 1
        if not n:
            return b"".join(parts), at
        if at + n > len(data):
            raise Malformed("a block is cut off")
        parts.append(data[at : at + n])
        at += n


def _interlaced(height: int) -> np.ndarray:
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def read(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF in order. Palettes, transparency and disposal are applied."""
    try:
        if data[:6] not in (b"GIF87a", b"GIF89a"):
            raise Malformed("no GIF signature")
        wide, high, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
        at, shared = 13, None
        if flags & 0x80:
            n = 2 << (flags & 7)
            shared = np.frombuffer(data, np.uint8, n * 3, at).reshape(n, 3)
            at += n * 3
        ground = shared[background] if shared is not None and background < len(shared) else np.zeros(3, np.uint8)
        canvas = np.empty((high, wide, 3), np.uint8)
        canvas[:] = ground
        number, delay, disposal, clear = 0, 0, 0, None
        while data[at] != 0x3B:
            if data[at] == 0x21:
                kind = data[at + 1]
                body, at = _blocks(data, at + 2)
                if kind == 0xF9 and len(body) >= 4:
                    bits, ticks, index = struct.unpack_from("<BHB", body)
                    delay, disposal, clear = ticks * 10, bits >> 2 & 7, index if bits & 1 else None
                continue
            if data[at] != 0x2C:
                raise Malformed("an unknown block")
            left, top, width, height, own = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            palette = shared
            if own & 0x80:
                n = 2 << (own & 7)
                palette = np.frombuffer(data, np.uint8, n * 3, at).reshape(n, 3)
                at += n * 3
            if palette is None or left + width > wide or top + height > high:
                raise Malformed("a frame without palette or outside the screen")
            low = data[at]
            if not 2 <= low <= 8:
                raise Malformed("a code size out of range")
            stream, at = _blocks(data, at + 1)
            index = decompress(stream, low, width * height).reshape(height, width)
            if own & 0x40:
                rows = np.empty_like(index)
                rows[_interlaced(height)] = index
                index = rows
            if index.size and index.max() >= len(palette):
                raise Malformed("a colour outside the palette")
            before = canvas.copy() if disposal == 3 else None
            place = canvas[top : top + height, left : left + width]
            if clear is None:
                place[:] = palette[index]
            else:
                drawn = index != clear
                place[drawn] = palette[index[drawn]]
            yield Frame(number, delay, left, top, width, height, disposal, clear, canvas)
            if disposal == 2:
                place[:] = ground
            elif before is not None:
                canvas = before
            number, delay, disposal, clear = number + 1, 0, 0, None
    except (IndexError, struct.error, ValueError) as x:
        raise x if isinstance(x, Malformed) else Malformed(str(x)) from x


def write(payload: bytes) -> bytes:
    """A GIF whose colour indices are ``payload``, a positive multiple of 64 bytes, under a grey palette."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), _GREY]
    for first in range(0, rows, ROWS):
        part = payload[first * WIDTH : (first + ROWS) * WIDTH]
        stream = compress(part)
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, DELAY, 0, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, 0, 0, WIDTH, len(part) // WIDTH, 0, 8))
        out += [bytes([len(stream[k : k + 255])]) + stream[k : k + 255] for k in range(0, len(stream), 255)]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of 64."""
    return data + b"\0" * ((-len(data)) % WIDTH if data else WIDTH)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media: every whole text as a GIF. Null and empty texts store 64 zero bytes.

    Ids pass through as they are, repeated rows stay repeated, an empty table stays
    empty, other columns are ignored. A long text becomes several frames, one text is
    held in memory at a time with its media.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                batch = whole.slice(k, SLICE)
                texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
                media = [write(padded(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


_FRAME = "frame_no int, delay_ms int, left int, top int, width int, height int, disposal int, transparent int, pixels binary, hist_red array<long>, hist_green array<long>, hist_blue array<long>, error string"


def frames(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each frame with its timing, pixels (RGB rows of its rectangle) and ``BINS`` counts a channel.

    Media that cannot be read, null among them, give the frames before the fault and
    then a row that has only id and error. Frames go out one by one, so a long animation
    needs the memory of one.
    """
    kind = media.schema[id_col].dataType.simpleString()

    def rows(key: object, data: bytes | None) -> Iterator[tuple]:
        try:
            for f in read(data or b""):
                yield (key, f.number, f.delay_ms, f.left, f.top, f.width, f.height, f.disposal, f.transparent, f.pixels.tobytes(), *(f.histogram(c).tolist() for c in range(3)), None)
        except Malformed as x:
            yield (key, *[None] * 12, str(x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, data = batch.column(0), batch.column(1)
            out = pa.schema([pa.field("doc_id", key.type), *((n, t) for n, t in _ARROW_FRAME)])
            for i in range(batch.num_rows):
                for row in rows(key[i].as_py(), data[i].as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, out, strict=True)], schema=out)

    return media.select(media[id_col].alias("doc_id"), media[media_col].alias("media")).mapInArrow(run, f"doc_id {kind}, {_FRAME}")


_ARROW_FRAME = [
    *((n, pa.int32()) for n in ("frame_no", "delay_ms", "left", "top", "width", "height", "disposal", "transparent")),
    ("pixels", pa.binary()),
    *((n, pa.list_(pa.int64())) for n in ("hist_red", "hist_green", "hist_blue")),
    ("error", pa.string()),
]


def digest(media: DataFrame) -> DataFrame:
    """Of ``store``'s rows, read back from the media: payload size and hashes, media size and hash, and a feature.

    The feature is the number of frames, then the histogram of grey values over all frames.
    Rows come out as they are, repeated ones too; an empty table gives an empty table;
    media that cannot be read, null among them, are an error, as ``store`` writes none.
    """
    kind = media.schema["doc_id"].dataType.simpleString()

    def one(data: bytes) -> tuple:
        parts, n = [], np.zeros(BINS, np.int64)
        for f in read(data):
            parts.append(f.pixels[:, :, 0].tobytes())
            n += f.histogram(0)
        payload = b"".join(parts)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), f"{len(parts)}:" + ",".join(map(str, n.tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                batch = whole.slice(k, SLICE)
                found = [one(d.as_py()) for d in batch.column(2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, t) for v, t in zip(zip(*found, strict=True), types, strict=True))], names)

    return media.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

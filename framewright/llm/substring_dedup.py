"""Substring dedup by fixed-block anchors.

A word is removed when it lies in a window of ``WINDOW`` words of its document whose
word sequence also starts in a document with a smaller id. Three passes:

1. **Anchors.** Each document is cut into non-overlapping reference blocks of ``BLOCK``
   words, and these blocks are indexed. Every rolling window of ``BLOCK`` words of every
   document probes the index. As ``WINDOW`` = 2 * ``BLOCK`` - 1, every window holds one
   whole block of its own document; if the window stands in another document, too, the
   block is hit by a probe of that one.
2. **Extension.** Around the blocks that were hit, all windows are compared in full, and
   a hit is extended to the whole run of windows that have an earlier copy: the maximal
   exact repeats of the document.
3. **Cut.** The words of these runs are left out of the text.

Hashes travel as sorted, delta-coded arrays by bucket, not as rows, and texts travel
compressed. Before the exchange, each task combines what it has: a probe needs no id and
is sent at most twice, and blocks or windows that several documents of the task share are
flagged there and sent for one of them at most. So a passage that a third of all documents
hold reaches its bucket as two entries per task. A window is identified by 64 bits of one
hash within the bucket that another hash names; the number of buckets grows with
``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm import wordhash as W
from framewright.llm.workspace import Workspace

WINDOW = 13
BLOCK = (WINDOW + 1) // 2
#: Words whose hashes a worker holds before it sends them on.
HELD = 2_000_000
SLICE = 2048
_SENT = "bucket int, index_keys binary, index_docs binary, keys binary, docs binary"
_FLAGS = "shard int, docs binary, keys binary"
_LOWEST = -(1 << 63)


def _packed(x: np.ndarray, ascending: bool = False) -> bytes:
    """The compressed bytes of an array of 64-bit numbers, byte by byte significance; differences of an ascending one."""
    if ascending and len(x):
        x = np.concatenate([x[:1], np.diff(x)])
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), 8).T.tobytes())


def _unpacked(part: bytes, kind: type, ascending: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(part), np.uint8) if part else np.zeros(0, np.uint8)
    x = np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view(kind)
    return np.cumsum(x, dtype=kind) if ascending else x


def _all(parts: list[bytes], kind: type, ascending: bool = False) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(_unpacked(p, kind, ascending) for p in parts)])


def _edges(keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins, in a sorted array."""
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(first)


def _combined(names: np.ndarray, docs: np.ndarray, extra: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Sorted by name: where each run begins, the smallest document of each, whether it has several; and the sorted arrays."""
    order = np.argsort(names)
    names, docs = names[order], docs[order]
    at = _edges(names)
    least = np.minimum.reduceat(docs, at) if len(at) else docs
    several = (np.maximum.reduceat(docs, at) if len(at) else docs) != least
    return at, least, several, names, docs, order if extra is None else extra[order]


def _words(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of a batch of (doc_id, text): row of the first document, bytes, starts, ends and row of each word."""
    buf, offsets = W.text_buffer(batch.column(1))
    for a, b in W.pieces(offsets):
        own = offsets[a : b + 1]
        part = buf[own[0] : own[-1]]
        starts, ends, rows = W.spans(part, own - own[0])
        yield np.arange(a, b), part, starts, ends, rows + a


def _rolling(words: np.ndarray, rows: np.ndarray, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows that lie in one document, and where each starts."""
    h = W.windows(words, size, seed)
    if not len(h):
        return h, np.zeros(0, np.int64)
    at = np.flatnonzero(rows[: len(h)] == rows[size - 1 :])
    return h[at], at


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _send(buckets: np.ndarray, index: tuple | None, keys: np.ndarray, docs: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """A row for each bucket. ``index`` has buckets, keys and documents of blocks; all are sorted by bucket and key."""
    own = index or (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    names = np.unique(np.concatenate([own[0], buckets]))
    cuts = [(np.searchsorted(b, names), np.searchsorted(b, names, "right")) for b in (own[0], buckets)]
    for k in range(0, len(names), 64):
        some = range(k, min(k + 64, len(names)))
        index_part, part = ([slice(lo[i], hi[i]) for i in some] for lo, hi in cuts)
        columns = [
            [_packed(own[1][x], True) for x in index_part], [_packed(own[2][x]) for x in index_part],
            [_packed(keys[x], True) for x in part], [_packed(docs[x]) if docs is not None else b"" for x in part],
        ]
        yield pa.RecordBatch.from_arrays([pa.array(names[k : k + 64].astype(np.int32), pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], ["bucket", "index_keys", "index_docs", "keys", "docs"])


def _send_known(docs: np.ndarray, keys: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """What a task has flagged itself; negative buckets pass it on."""
    for k in range(0, len(docs), 65536):
        part = slice(k, k + 65536)
        row = [pa.array([-1 - int(docs[k]) % buckets], pa.int32()), *[pa.array([b""], pa.binary())] * 2, pa.array([_packed(keys[part])], pa.binary()), pa.array([_packed(docs[part])], pa.binary())]
        yield pa.RecordBatch.from_arrays(row, ["bucket", "index_keys", "index_docs", "keys", "docs"])


def _by_shard(docs: np.ndarray, keys: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    """Flagged (document, key) pairs by shard of the document."""
    shard = docs % shards
    order = np.lexsort((keys, docs, shard))
    shard, docs, keys = shard[order], docs[order], keys[order]
    at = _edges(shard)
    end = np.append(at[1:], len(shard))[: len(at)]
    for i, j in zip(at.tolist(), end.tolist(), strict=True):
        yield pa.RecordBatch.from_arrays([pa.array([shard[i]], pa.int32()), pa.array([_packed(docs[i:j], True)], pa.binary()), pa.array([_packed(keys[i:j])], pa.binary())], ["shard", "docs", "keys"])


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input sorted by shard: one (doc_id, keys) row for each document of a shard."""
    for _, parts in _grouped(batches):
        docs, keys = _all(parts[0], np.int64, True), _all(parts[1], np.uint64)
        order = np.argsort(docs, kind="stable")
        docs, keys = docs[order], keys[order]
        at = _edges(docs)
        end = np.append(at[1:], len(docs))[: len(at)]
        for k in range(0, len(at), 4096):
            part = slice(k, k + 4096)
            blobs = [keys[i:j].tobytes() for i, j in zip(at[part].tolist(), end[part].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(docs[at[part]], pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "keys"])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The columns of each run of rows with one value in the first column."""
    name, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if row[0] != name or not held:
                if held:
                    yield name, held
                name, held = row[0], [[] for _ in row[1:]]
            for k, value in enumerate(row[1:]):
                held[k].append(value)
    if held:
        yield name, held


def _gathered(batches: Iterator[pa.RecordBatch], collect: Callable) -> Iterator[list[np.ndarray]]:
    """Concatenated results of ``collect`` over pieces of the input, ``HELD`` words at a time."""
    held: list[tuple] = []
    words = 0
    for whole in batches:
        for k in range(0, whole.num_rows, SLICE):
            batch = whole.slice(k, SLICE)
            ids = _ids(batch)
            for _, part, starts, ends, rows in _words(batch):
                held.append(collect(part, starts, ends, rows, ids))
                words += len(starts)
                if words >= HELD:
                    yield [np.concatenate(x) for x in zip(*held, strict=True)]
                    held, words = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _anchor_names(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32-bit key of the hashes of blocks, as one number that sorts by bucket first."""
    return (h & np.uint64(0xFFFFFFFF)) % np.uint64(buckets) << np.uint64(32) | h >> np.uint64(32)


def _blocks(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and start of all rolling windows of a block's size, and which of them are reference blocks."""
    h, at = _rolling(words, rows, BLOCK)
    return h, at, (at - np.searchsorted(rows, rows[at])) % BLOCK == 0


def _anchors(buckets: int) -> Callable:
    """Index blocks and probes of a task, by bucket; blocks that several documents of the task have are flagged."""

    def collect(part, starts, ends, rows, ids):
        h, at, block = _blocks(W.hash_words(part, starts, ends), rows)
        return _anchor_names(h, buckets), ids[rows[at]], block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, docs, block in _gathered(batches, collect):
            at, _, several, names, docs, block = _combined(names, docs, block)
            shared = np.repeat(several, np.diff(np.append(at, len(names))))
            yield from _send_known(docs[block & shared], names[block & shared], buckets)
            lone = np.flatnonzero(block & ~shared)
            lone = lone[_edges(names[lone])]
            probes = np.repeat(names[at], 1 + several)
            yield from _send((probes >> np.uint64(32)).astype(np.int64), ((names[lone] >> np.uint64(32)).astype(np.int64), names[lone], docs[lone]), probes, None)

    return run


def _hit_blocks(shards: int) -> Callable:
    """Flags of the blocks that a probe of another document meets. Input sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for bucket, parts in _grouped(batches):
            if bucket < 0:
                docs.append(_all(parts[3], np.int64))
                keys.append(_all(parts[2], np.uint64))
                continue
            index, owners, probes = _all(parts[0], np.uint64, True), _all(parts[1], np.int64), np.sort(_all(parts[2], np.uint64, True))
            # Each document's own probe meets its block once; a second one comes from elsewhere.
            place = np.searchsorted(probes, index)
            hit = np.flatnonzero(np.append(probes, [np.uint64(0)] * 2)[place + 1] == index)
            hit = hit[place[hit] + 1 < len(probes)]
            docs.append(owners[hit])
            keys.append(index[hit])
        yield from _by_shard(np.concatenate(docs), np.concatenate(keys), shards)

    return run


def _windows(buckets: int) -> Callable:
    """Input (doc_id, packed text, keys of hit blocks): the windows around these blocks, by bucket.

    Where several documents of the task have a window, the first stands for it and the others are flagged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, b, docs in _gathered_flagged(batches, buckets):
            order = np.argsort(h)
            order = order[np.argsort(b[order], kind="stable")]
            h, b, docs = h[order], b[order], docs[order]
            at = _edges(h)
            if not len(at):
                continue
            least = np.minimum.reduceat(docs, at)
            yield from _send(b[at], None, h[at], least)
            later = docs != np.repeat(least, np.diff(np.append(at, len(h))))
            yield from _send_known(docs[later], h[later], buckets)

    return run


def _gathered_flagged(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[list[np.ndarray]]:
    held: list[tuple] = []
    words = 0
    for batch, flagged in _opened(batches):
        ids = _ids(batch)
        for _, part, starts, ends, rows in _words(batch):
            plain = W.hash_words(part, starts, ends)
            h, at, block = _blocks(plain, rows)
            names, at = _anchor_names(h[block], buckets), at[block]
            hit = np.zeros(len(starts) + BLOCK, bool)  # by first word of a block
            bounds = np.searchsorted(rows[at], np.arange(len(ids) + 1))
            for i in np.unique(rows[at]).tolist():
                own = slice(bounds[i], bounds[i + 1])
                hit[at[own]] = np.isin(names[own], flagged[i])
            w, at = _rolling(plain, rows, WINDOW)
            g, _ = _rolling(W.hash_words(part, starts, ends, 1), rows, WINDOW, 1)
            first = np.searchsorted(rows, rows[at])
            near = hit[at + (first - at) % BLOCK]  # the one block of its document that lies in the window
            held.append((w[near], (g[near] >> np.uint64(20)).astype(np.int64) % buckets, ids[rows[at[near]]]))
            words += int(near.sum())
            if words >= HELD:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held, words = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _repeats(shards: int) -> Callable:
    """Flags of the windows that a document with a smaller id has, too. Input sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_docs, found_keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for bucket, parts in _grouped(batches):
            keys, docs = _all(parts[2], np.uint64, bucket >= 0), _all(parts[3], np.int64)
            if bucket >= 0:
                at, least, _, keys, docs, _ = _combined(keys, docs)
                later = docs != np.repeat(least, np.diff(np.append(at, len(keys))))
                keys, docs = keys[later], docs[later]
            found_docs.append(docs)
            found_keys.append(keys)
        yield from _by_shard(np.concatenate(found_docs), np.concatenate(found_keys), shards)

    return run


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """(doc_id, packed text, keys) rows as (doc_id, text) batches with the keys of each row."""
    opener = zstandard.ZstdDecompressor()
    for whole in batches:
        for k in range(0, whole.num_rows, SLICE):
            batch = whole.slice(k, SLICE)
            texts = pa.array([opener.decompress(x) for x in batch.column(1).to_pylist()], pa.large_binary()).cast(pa.large_string())
            flagged = [np.frombuffer(x or b"", np.uint64) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"]), flagged


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, packed text)."""
    packer = zstandard.ZstdCompressor(level=1)
    for whole in batches:
        for k in range(0, whole.num_rows, SLICE):
            batch = whole.slice(k, SLICE)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([packer.compress((t or "").encode()) for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "packed"])


def _joined(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, first: int, n: int) -> list[bytes]:
    """Words joined by one space, for each of ``n`` documents from row ``first``."""
    size = ends - starts + 1
    total = int(size.sum())
    out = np.full(total, 0x20, np.uint8)
    at = np.cumsum(size) - size
    if total:
        source = np.arange(total) + np.repeat(starts - at, size)
        inner = np.ones(total, bool)
        inner[at + size - 1] = False
        out[inner] = part[source[inner]]
    bounds = np.append(at, total)[np.searchsorted(rows, np.arange(first, first + n + 1))]
    data = out.tobytes()
    return [data[a : max(a, b - 1)] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


_RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<start:long,stop:long>>, kept string"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _result(ids, n_words, n_removed, spans, kept) -> list[pa.Array]:
    return [pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, _SPANS), pa.array(kept, pa.binary()).cast(pa.string())]


def _cut(batch: pa.RecordBatch, flagged: list[np.ndarray]) -> Iterator[list[pa.Array]]:
    """Results of the documents of a batch; ``flagged`` has the sorted keys of each one's repeated windows."""
    ids = _ids(batch)
    for docs, part, starts, ends, rows in _words(batch):
        n, first = len(docs), int(docs[0])
        n_words = np.bincount(rows - first, minlength=n)
        gone = np.zeros(len(starts), bool)
        if any(len(flagged[i]) for i in docs.tolist()):
            h, at = _rolling(W.hash_words(part, starts, ends), rows, WINDOW)
            bounds = np.searchsorted(rows[at], np.arange(first, first + n + 1))
            change = np.zeros(len(starts) + 1, np.int64)
            for i in range(n):
                lo, hi = bounds[i], bounds[i + 1]
                if len(flagged[first + i]) and hi > lo:
                    begin = at[lo:hi][np.isin(h[lo:hi], flagged[first + i])]
                    change[begin] += 1
                    change[begin + WINDOW] -= 1
            gone = np.cumsum(change)[:-1] > 0
        kept = _joined(part, starts[~gone], ends[~gone], rows[~gone], first, n)
        removed = np.bincount(rows[gone] - first, minlength=n)
        spans: list[list[dict]] = [[] for _ in range(n)]
        if gone.any():
            where = np.flatnonzero(gone)
            head = np.searchsorted(rows, np.arange(first, first + n))
            fresh = np.append(True, (np.diff(where) > 1) | (np.diff(rows[where]) > 0))
            begin, stop = where[fresh], np.append(where[np.flatnonzero(fresh)[1:] - 1], where[-1]) + 1
            for a, b in zip(begin.tolist(), stop.tolist(), strict=True):
                i = int(rows[a]) - first
                spans[i].append({"start": a - int(head[i]), "stop": b - int(head[i])})
        yield _result(ids[docs], n_words, removed, spans, kept)


def _cut_flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input (doc_id, packed text, keys of repeated windows)."""
    for batch, flagged in _opened(batches):
        for columns in _cut(batch, flagged):
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "removed", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, removed (word ranges of the maximal repeats) and kept (text) for every row.

    Words are runs outside ``[\\x20\\x09-\\x0D]``, unchanged; kept words are joined by one
    space. Ids are integers; a null id counts as the smallest and comes out as null. Null
    and empty texts have no words. Rows that repeat an id are one document in the
    comparison (none is earlier than the other) and give a row each. Other columns are
    ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "substring-dedup")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * partitions
    lowest = F.lit(_LOWEST).cast("long")
    base = docs.select(F.coalesce(docs[id_col].cast("long"), lowest).alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))

    def exchanged(df: DataFrame, key: str) -> DataFrame:
        return df.repartition(partitions, key).sortWithinPartitions(key)

    def flags(sent: DataFrame, match: Callable, name: str) -> DataFrame:
        """(doc_id, keys) of what ``match`` finds in the buckets of ``sent``."""
        found = exchanged(exchanged(sent, "bucket").mapInArrow(match(partitions), _FLAGS), "shard")
        found = space.save(found.mapInArrow(_collected, "doc_id long, keys binary"), name)
        space.release()
        return found

    hits = flags(base.mapInArrow(_anchors(buckets), _SENT), _hit_blocks, "hits")
    marked = base.mapInArrow(_squeeze, "doc_id long, packed binary").join(hits, "doc_id", "left")
    texts = space.save(marked.select("doc_id", "packed", "keys"), "texts")
    space.release()
    repeats = flags(texts.where("keys IS NOT NULL").mapInArrow(_windows(buckets), _SENT), _repeats, "repeats")
    own = texts.drop("keys").join(repeats, "doc_id", "left").select("doc_id", "packed", "keys")
    cut = own.mapInArrow(_cut_flagged, _RESULT)
    return cut.withColumn("doc_id", F.when(F.col("doc_id") != lowest, F.col("doc_id")))

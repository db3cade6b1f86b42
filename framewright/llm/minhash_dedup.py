"""Near-duplicate grouping by SuperMinHash, banding, verification and union-find.

A document's set is its distinct shingles of some words (A-Z lower-cased). Two documents
are linked when 100 * intersection >= percent * union of their full sets.

* SuperMinHash: every element deals one random permutation of the places 0..m-1, and
  its value at the j-th dealt place is j plus a random fraction; a place keeps the least
  value. Elements are dealt level by level, and a document stops as soon as no value of
  the coming level could be a least one.
* Equal sets fall together before anything is compared, by a 128-bit key of the set.
* Banding: ``BANDS`` bands of ``ROWS`` places. A linked pair shares no band with a
  probability of at most (1 - 0.85**6)**40 < 1e-8 at 85 percent, (1 - 0.8**6)**40 < 6e-6
  at 80 percent.
* Verification on full sets, in two rounds. First every member of a bucket is compared
  with the bucket's leader, the member whose buckets are largest in all, which is as
  good as the centre of a group of copies. Then, where the members of a leader's buckets
  are not all in one component yet, members of different components are compared with each
  other. They stand there as their differences from the leader, from which every
  intersection follows exactly; only links that join components leave the task. The
  members of a leader's main component need no comparison among themselves, so only the
  others, the probes, are sent to all members. Both are dealt into blocks of bounded bytes
  and rows; where the probes fit one block, every member travels once, however large the
  group is. No pair is capped or sampled away.
* Union-find over the verified links, distributed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm import wordhash as W
from framewright.llm.components import components
from framewright.llm.workspace import Workspace, text_slices, tidied

#: Words of a shingle and least similarity in percent, unless a caller names others.
SHINGLE, PERCENT = 5, 80
BANDS, ROWS = 40, 6
PLACES = BANDS * ROWS
#: Levels whose permutations are traced back; later levels, which only small sets reach, keep them as arrays.
TRACED = 8
#: Elements that are dealt at once; about so many members, and bytes of their differences, make a block.
HELD, BLOCK, BLOCK_BYTES = 300_000, 512, 8 << 20
#: Rows that are cut at once, and about how many bytes of their text.
SLICE, SLICE_BYTES = 1024, 4 << 20
_LOWEST = -(1 << 63)
_STEP, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(batch: pa.RecordBatch, column: int, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of a batch: first row, end row, and the sorted distinct shingle hashes with their rows."""
    buf, offsets = W.text_buffer(batch.column(column))
    for a, b in W.pieces(offsets):
        own = offsets[a : b + 1]
        part = W.lowered(buf[own[0] : own[-1]])
        starts, ends, rows = W.spans(part, own - own[0])
        words = W.hash_words(part, starts, ends)
        count = np.bincount(rows, minlength=b - a)
        first = np.cumsum(count) - count
        found, where = [], []
        for size in range(1, shingle + 1):
            h = W.windows(words, size)
            if size == shingle:
                at = np.flatnonzero(rows[: len(h)] == rows[size - 1 :]) if len(h) else np.zeros(0, np.int64)
            else:  # the whole sequence of a text with fewer words
                at = first[count == size]
            found.append(h[at])
            where.append(rows[at])
        h, rows = np.concatenate(found), np.concatenate(where)
        order = np.lexsort((h, rows))
        h, rows = h[order], rows[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
        yield a, b, h[new], rows[new] + a


def _deal(elements: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each element at level j: the value, and which of the places not dealt yet is dealt."""
    x = W.mix(elements + np.uint64((j + 1) * int(_STEP) & (1 << 64) - 1))
    y = W.mix(x ^ _OTHER) >> np.uint64(32)
    return j + (x >> np.uint64(11)).astype(np.float64) * 2.0**-53, j + (y % np.uint64(PLACES - j)).astype(np.int64)


def super_minhash(elements: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
    """Signatures (n, PLACES) of ``n`` sets; ``elements`` are hashes, ``docs`` the set of each, sorted. An empty set has infinite values."""
    least = np.full(n * PLACES, np.inf)
    dealt: list[np.ndarray] = []
    order = None
    for j in range(PLACES):
        if not len(elements):
            break
        value, k = _deal(elements, j)
        if j < TRACED:
            place = k
            for t in range(j - 1, -1, -1):
                place = np.where(dealt[t] == place, t, place)
            dealt.append(k)
        else:
            if order is None:
                order = np.tile(np.arange(PLACES, dtype=np.uint8), (len(elements), 1))
                row = np.arange(len(elements))
                for t in range(j):
                    order[row, t], order[row, dealt[t]] = order[row, dealt[t]], order[row, t].copy()
            row = np.arange(len(elements))
            place = order[row, k].astype(np.int64)
            order[row, k] = order[row, j]
        np.minimum.at(least, docs * PLACES + place, value)
        if (j + 1) * len(elements) < PLACES * 2:  # no set can be full yet
            continue
        going = np.unique(docs)
        open_sets = np.zeros(n, bool)
        open_sets[going] = least.reshape(n, PLACES)[going].max(1) >= j + 1
        stay = open_sets[docs]
        if not stay.all():
            elements, docs = elements[stay], docs[stay]
            dealt = [d[stay] for d in dealt] if order is None else []
            order = order if order is None else order[stay]
    return least.reshape(n, PLACES)


def set_keys(h: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two order-independent 64-bit sums for each of ``n`` sets."""
    out = []
    for salt in (_STEP, _OTHER):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(W.mix(h ^ salt), dtype=np.uint64)])
        bounds = np.searchsorted(rows, np.arange(n + 1))
        out.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def _mark(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, digest, text) -> doc_id, digest, n_shingles, key1, key2, bands."""
    for whole in batches:
        for batch in text_slices(whole, 2, SLICE_BYTES, SLICE):
            for a, b, h, rows in shingle_sets(batch, 2, shingle):
                n = b - a
                rows = rows - a
                count = np.bincount(rows, minlength=n)
                key1, key2 = set_keys(h, rows, n)
                ends = np.cumsum(count)
                bits = np.zeros((n, PLACES), np.uint64)
                first = 0
                while first < n:
                    base = ends[first - 1] if first else 0
                    last = max(first + 1, int(np.searchsorted(ends, base + HELD, "right")))
                    part = slice(base, ends[last - 1])
                    bits[first:last] = W.mix(super_minhash(h[part], rows[part] - first, last - first).view(np.uint64))
                    first = last
                bands = np.zeros((n, BANDS), np.uint64)
                by = bits.reshape(n, BANDS, ROWS)
                for r in range(ROWS):
                    bands = bands * _STEP + by[:, :, r]
                bands = W.mix(bands + np.arange(BANDS, dtype=np.uint64) * _OTHER).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, n), batch.column(1).slice(a, n), pa.array(count, pa.int64()), pa.array(key1, pa.int64()), pa.array(key2, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(bands.reshape(-1), pa.int64())),
                    ],
                    ["doc_id", "digest", "n_shingles", "key1", "key2", "bands"],
                )


def _full_sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """(sid, text) -> (sid, shingles)."""
    for whole in batches:
        for batch in text_slices(whole, 1, SLICE_BYTES, SLICE):
            for a, b, h, rows in shingle_sets(batch, 1, shingle):
                bounds = np.searchsorted(rows, np.arange(a, b + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([h[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], ["sid", "shingles"])


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of hashes are similar enough."""
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(x) + len(y)
    merged = np.sort(np.concatenate([x, y]), kind="stable")
    common = int((merged[1:] == merged[:-1]).sum())
    return 100 * common >= percent * (both - common)


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, shingles_a, shingles_b) -> the linked (a, b)."""
    for batch in batches:
        left, right = batch.column(2), batch.column(3)
        good = [i for i in range(batch.num_rows) if linked(np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64), percent)]
        rows = pa.array(good, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows)], ["a", "b"])


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lead, sid, shingles of both) -> lead, sid, size of the leader's set, what the member lacks of it, what it has beside it."""
    for batch in batches:
        size, lacks, adds = [], [], []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            size.append(len(x))
            lacks.append(np.setdiff1d(x, y, assume_unique=True).tobytes())
            adds.append(np.setdiff1d(y, x, assume_unique=True).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(lacks, pa.binary()), pa.array(adds, pa.binary())], ["lead", "sid", "size", "lacks", "adds"])


class _Marks:
    """Sets of hashes as numbers, to count the common elements of another set with each of them."""

    def __init__(self, blobs: list[bytes]):
        self.length = np.array([len(b) // 8 for b in blobs], np.int64)
        self.names, self.number = np.unique(np.frombuffer(b"".join(blobs), np.uint64), return_inverse=True)
        self.ends = np.cumsum(self.length)
        self.marked = np.zeros(len(self.names) + 1, bool)

    def common(self, blob: bytes) -> np.ndarray:
        other = np.frombuffer(blob, np.uint64)
        at = np.searchsorted(self.names, other)
        own = at[self.names[np.minimum(at, len(self.names) - 1)] == other] if len(self.names) else at[:0]
        self.marked[own] = True
        sums = np.concatenate([[0], np.cumsum(self.marked[self.number])])
        self.marked[own] = False
        return sums[self.ends] - sums[self.ends - self.length]


def joining_links(lead_size: int, probes: list[tuple], members: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links (sid, sid) of probes with members that join two components, directly or by earlier links.

    Both are (sid, root, lacks, adds): differences from a leader's set of ``lead_size`` elements.
    """
    sid, root = (np.array([m[k] for m in members], np.int64) for k in (0, 1))
    less, more = _Marks([m[2] for m in members]), _Marks([m[3] for m in members])
    n = lead_size - less.length + more.length
    above: dict[int, int] = {}

    def top(r: int) -> int:
        while (up := above.get(r, r)) != r:
            above[r] = r = above.get(up, up)
        return r

    out = []
    for own, own_root, lacks, adds in probes:
        size = lead_size - len(lacks) // 8 + len(adds) // 8
        both = lead_size - len(lacks) // 8 - less.length + less.common(lacks) + more.common(adds)
        for k in np.flatnonzero((100 * both >= percent * (size + n - both)) & (root != own_root)).tolist():
            a, b = top(own_root), top(int(root[k]))
            if a != b:
                above[max(a, b)] = min(a, b)
                out.append((own, int(sid[k])))
    return out


def _cross(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links between different components. Input, sorted by leader and the pair of blocks: lead, i, j, probe, sid, root, size, lacks, adds."""

    def links(key: tuple, probes: list[tuple], members: list[tuple]) -> Iterator[pa.RecordBatch]:
        if probes and members and (found := joining_links(key[3], probes, members, percent)):
            x, y = (np.array(c, np.int64) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    now: tuple | None = None
    held: tuple[list, list] = ([], [])
    for batch in batches:
        small = [batch.column(c).to_pylist() for c in range(7)]
        for k, (lead, i, j, probe, sid, root, size) in enumerate(zip(*small, strict=True)):
            if now != (lead, i, j, size):
                if now:
                    yield from links(now, *held)
                now, held = (lead, i, j, size), ([], [])
            held[0 if probe else 1].append((sid, root, batch.column(7)[k].as_py(), batch.column(8)[k].as_py()))
    if now:
        yield from links(now, *held)


def _blocks(rows: str, size: str) -> Column:
    """Into how many blocks so many rows, with so many bytes of differences, are dealt."""
    return F.greatest(F.lit(1), F.ceil(F.col(rows) / BLOCK), F.ceil(F.col(size) / BLOCK_BYTES)).cast("int")


def _second_round(led: DataFrame, first: DataFrame, with_sets: Callable[[DataFrame], DataFrame], space: Workspace, percent: int) -> DataFrame | None:
    """Links between members (lead, sid) of a leader that are in different components ``first``; None where all are in one."""
    rooted = space.save(led.join(first, led["sid"] == first["node"], "left").select("lead", "sid", F.coalesce("root", "sid").alias("root")), "rooted")
    groups = rooted.groupBy("lead", "root").agg(F.count("*").alias("n")).groupBy("lead").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count("*").alias("roots"))
    groups = space.save(groups.where("roots > 1").select("lead", "main"), "groups")
    if groups.isEmpty():
        return None
    members = space.save(rooted.join(groups, "lead").select("lead", "sid", "root", (F.col("root") != F.col("main")).alias("probe")), "members")
    differences = with_sets(members.select(F.col("lead").alias("a"), F.col("sid").alias("b"))).mapInArrow(_differences, "lead long, sid long, size long, lacks binary, adds binary")
    members = space.save(members.join(differences, ["lead", "sid"]), "differences")
    volume = F.octet_length("lacks") + F.octet_length("adds")
    total = members.groupBy("lead").agg(
        F.count("*").alias("n"), F.sum(volume).alias("bytes"), F.count(F.when(F.col("probe"), 1)).alias("np"), F.sum(F.when(F.col("probe"), volume).otherwise(0)).alias("bytes_p")
    )
    total = space.save(total.select("lead", _blocks("np", "bytes_p").alias("probe_blocks"), _blocks("n", "bytes").alias("blocks")), "blocks")
    # A pair of blocks: probes of block i meet members of block j.
    place = F.xxhash64("sid")
    dealt = members.join(total, "lead").withColumn("i", F.pmod(place, "probe_blocks").cast("int")).withColumn("j", F.pmod(place, "blocks").cast("int"))
    rest = ["sid", "root", "size", "lacks", "adds"]
    probes = dealt.where("probe").select("lead", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(True).alias("probe"), *rest)
    met = dealt.select("lead", F.explode(F.sequence(F.lit(0), F.col("probe_blocks") - 1)).alias("i"), "j", F.lit(False).alias("probe"), *rest)
    pairs = probes.unionByName(met).repartition("lead", "i", "j").sortWithinPartitions("lead", "i", "j")
    return space.save(pairs.mapInArrow(lambda batches: tidied(_cross(batches, percent)), "a long, b long"), "links-2")


def _judged(docs: DataFrame, space: Workspace, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """doc_id (null as the least number), digest of the text, n_shingles, component_id for every row."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    base = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(_LOWEST).cast("long")).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    marked = base.mapInArrow(lambda batches: tidied(_mark(batches, shingle)), "doc_id long, digest binary, n_shingles long, key1 long, key2 long, bands array<long>")
    marks = space.save(marked, "marks")
    sets = marks.where("n_shingles > 0").groupBy("key1", "key2", "n_shingles").agg(F.min(F.struct("doc_id", "digest")).alias("rep"), F.first("bands").alias("bands"))
    sets = space.save(sets.withColumn("sid", F.monotonically_increasing_id()), "sets")
    space.release()

    # Buckets of two and more, and the leader of each.
    each = sets.select("sid", F.explode("bands").alias("bucket"))
    sizes = space.save(each.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    shared = space.save(each.join(sizes, "bucket"), "shared")
    central = space.save(shared.groupBy("sid").agg(F.sum("size").alias("weight")), "central")
    ranked = shared.join(central, "sid").groupBy("bucket").agg(F.min(F.struct(-F.col("weight"), "sid"))["sid"].alias("lead"))
    leads = space.save(ranked, "leads")
    stars = shared.join(leads, "bucket").where("sid <> lead").select(F.col("lead").alias("a"), F.col("sid").alias("b")).distinct()
    stars = space.save(stars, "stars")
    space.release()

    # The texts of the sets. Rows that repeat an id and a text combine in their tasks before they travel.
    wanted = central.join(sets.select("sid", "rep.doc_id", "rep.digest"), "sid").select("sid", "doc_id", "digest")
    texts = base.groupBy("doc_id", "digest").agg(F.max("text").alias("text"))
    full = texts.join(wanted, ["doc_id", "digest"]).select("sid", "text").mapInArrow(lambda batches: tidied(_full_sets(batches, shingle)), "sid long, shingles binary")
    full = space.save(full, "full")
    space.release()

    def with_sets(pairs: DataFrame) -> DataFrame:
        a, b = (full.select(F.col("sid").alias(k), F.col("shingles").alias(f"shingles_{k}")) for k in "ab")
        return pairs.join(b, "b").join(a, "a").select("a", "b", "shingles_a", "shingles_b")

    links = space.save(with_sets(stars).mapInArrow(lambda batches: tidied(_verify(batches, percent)), "a long, b long"), "links-1")
    space.release()
    roots = components(links, space, "components-1")

    # Leaders whose buckets hold several components still.
    led = stars.select(F.col("a").alias("lead"), F.col("b").alias("sid")).union(leads.select("lead", F.col("lead").alias("sid")).distinct())
    more = _second_round(led, roots, with_sets, space, percent)
    space.release()
    if more is not None:
        roots = components(links.union(more), space, "components-2")

    joined = sets.join(roots, sets["sid"] == roots["node"], "left").select("key1", "key2", "n_shingles", "rep.doc_id", F.coalesce("root", "sid").alias("root"))
    joined = space.save(joined, "joined")
    ids = space.save(joined.groupBy("root").agg(F.min("doc_id").alias("component_id")), "ids")
    classes = space.save(joined.join(ids, "root").select("key1", "key2", "n_shingles", "component_id"), "classes")
    for name in ("sets", "sizes", "shared", "central", "leads", "stars", "full", "links-1", "rooted", "groups", "members", "differences", "blocks", "links-2", "joined", "ids"):
        space.drop(name)
    space.release()
    out = marks.select("doc_id", "digest", "n_shingles", "key1", "key2").join(classes, ["key1", "key2", "n_shingles"], "left")
    return out.select("doc_id", "digest", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Ids are integers; a null id counts as the smallest and comes out as null. A text
    without words, null among them, has an empty set and is linked with nothing. A text
    of fewer words than a shingle has one shingle, all its words. Rows that repeat an id
    are judged by their own texts. A text of any length counts whole. Other columns are
    ignored; an empty table gives an empty table.
    """
    out = _judged(docs, Workspace(docs.sparkSession, "minhash-dedup"), id_col, text_col, shingle, percent)
    real = lambda c: F.when(F.col(c) != _LOWEST, F.col(c))
    return out.select(real("doc_id").alias("doc_id"), "n_shingles", real("component_id").alias("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns; edge cases as there.

    Losers are joined by id and digest of the text: rows with both equal have one verdict.
    Their number grows with the table, so both sides are shuffled, at every size.
    """
    space = Workspace(docs.sparkSession, "minhash-dedup")
    judged = _judged(docs, space, id_col, text_col, shingle, percent)
    losers = space.save(judged.where("doc_id <> component_id").select(F.col("doc_id").alias("__fw_loser"), F.col("digest").alias("__fw_digest")).distinct(), "losers")
    space.release()
    same = (docs[id_col].cast("long") == losers["__fw_loser"]) & (F.unhex(F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")), 256)) == losers["__fw_digest"])
    return docs.join(losers.hint("merge"), same, "left_anti")

"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token starts as its UTF-8 bytes in a doubly linked list; a heap holds the rank
and place of every adjacent pair that has a merge. The lowest rank (then the leftmost
place) is popped again and again and merged in place. The count of tokens is the number
of initial symbols minus the number of merges; no identifiers are emitted.

Pre-tokens repeat, so each worker keeps a bounded cache of counts by the text between
two spaces. Splitting at single spaces is exact for the byte-level pattern: a space
before a non-space belongs to the pre-token that follows. Texts with other runs of white
space are split by the full pattern.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from framewright.llm.workspace import tidied

#: The byte-level pre-tokenisation pattern of the public vocabulary. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED, CACHED_CHARS = 300_000, 48
SLICE = 512


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte value."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PairRanks:
    """Merge table of a byte-level vocabulary: (left << 17 | right) -> (rank << 20 | merged symbol)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        number = {s: i for i, s in enumerate(dict.fromkeys([*byte_symbols(), *(a + b for a, b in spec["model"]["merges"])]))}
        if len(number) >= 1 << 17:
            raise ValueError("over 131,071 symbols")
        self.pairs = {number[a] << 17 | number[b]: k << 20 | number[a + b] for k, (a, b) in reversed(list(enumerate(spec["model"]["merges"])))}
        self.special = [t["content"] for t in spec["added_tokens"]]

    def merges(self, data: bytes) -> int:
        """How many merges ``data`` takes."""
        n = len(data)
        if n < 2:
            return 0
        known = self.pairs.get
        symbol = [*data, -1]  # no pair has the symbol -1
        # A heap entry is rank << 32 | place, so that the lowest rank comes first, then the leftmost place.
        heap = [found >> 20 << 32 | i for i in range(n - 1) if (found := known(symbol[i] << 17 | symbol[i + 1])) is not None]
        if not heap:
            return 0
        heapify(heap)
        after = list(range(1, n + 2))
        before = list(range(-1, n))
        done = 0
        while heap:
            entry = heappop(heap)
            i = entry & 0xFFFFFFFF
            j = after[i]
            left = symbol[i]
            if left < 0 or j >= n:
                continue
            found = known(left << 17 | symbol[j])
            if found is None or found >> 20 != entry >> 32:
                continue  # one of the two has merged since
            done += 1
            symbol[i] = merged = found & 0xFFFFF
            symbol[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (found := known(merged << 17 | symbol[k])) is not None:
                    heappush(heap, found >> 20 << 32 | i)
            h = before[i]
            if h >= 0 and (found := known(symbol[h] << 17 | merged)) is not None:
                heappush(heap, found >> 20 << 32 | h)
        return done


class _Counts(dict):
    """Bounded cache: text after the one space (or at a start) -> number of tokens."""

    def __init__(self, counter: Counter, lead: str):
        self.counter, self.lead = counter, lead

    def __missing__(self, part: str) -> int:
        n = self.counter.by_pattern(self.lead + part)
        if len(part) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[part] = n
        return n


class Counter:
    """Counts the tokens of texts."""

    def __init__(self, path: str):
        self.ranks = PairRanks(path)
        self.split = regex.compile(PATTERN).findall
        self.odd = re.compile(r" \s|\s ").search
        self.special = re.compile("|".join(map(re.escape, self.ranks.special))) if self.ranks.special else None
        self.bare, self.spaced = _Counts(self, ""), _Counts(self, " ")

    def by_pattern(self, text: str) -> int:
        if text.lstrip(" ").isalpha() and not text.startswith("  "):  # one match of the pattern: letters after one space at most
            data = text.encode()
            return len(data) - self.ranks.merges(data)
        total = 0
        for piece in self.split(text):
            data = piece.encode()
            total += len(data) - self.ranks.merges(data)
        return total

    def _plain(self, text: str) -> int:
        if self.odd(text):
            return self.by_pattern(text)
        first, *parts = text.split(" ")
        return self.bare[first] + sum(map(self.spaced.__getitem__, parts))

    def release(self) -> None:
        """Empties the caches."""
        self.bare.clear()
        self.spaced.clear()

    def count(self, text: str) -> int:
        """Tokens of ``text``; each special string in it counts as one."""
        if self.special and "<|" in text:
            pieces = self.special.split(text)
            return len(pieces) - 1 + sum(map(self._plain, pieces))
        return self._plain(text)


@lru_cache(2)
def counter(path: str) -> Counter:
    """One per worker."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    A null or empty text has 0 bytes and 0 tokens. Null and repeated ids pass through;
    an empty table gives an empty table; other columns are ignored. A text of any length
    is counted whole; a word without spaces takes n log n steps.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tidied(counted(batches), counter(path).release)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                n = [count(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")

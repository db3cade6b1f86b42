"""BPE encoding and decoding by a tokenisation automaton.

The automaton reads a pre-split word and emits tokens. It has one state per token (the
state after that token was read) and an arc labelled with a token from one state to
another wherever the two tokens may stand side by side in a BPE result. It begins as the
universal automaton of single symbols: every symbol may follow every symbol. Then each
merge (u, v), in order, is composed as a gadget:

* wherever u was followed by v, an arc uv now leads around both, to a state that
  continues as the state of v does,
* the arc v is cut from the state of u.

The state of uv shares the arcs of the state of v as of that moment, and an arc uv is
there wherever an arc u is; so a gadget stores only its cut, with its time, and the two
links. An arc (q, s) exists if none of the cuts between a right part of q and a left part
of s fell into the time when both stood there; resolved arcs are kept in a transition
table of fixed size. Every prefix of a word has exactly one path, so reading is
deterministic: for each reached place, follow the trie of labels and take the arcs that
exist. Distinct words are read side by side, place by place, with one table access for
all words; trie, cuts and transitions are arrays.

Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.token_counts import byte_symbols
from framewright.llm.workspace import text_slices, tidied

#: The pre-tokenisation pattern of the public word vocabulary. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
#: Slots of the transition table; bytes of text that are encoded together.
TABLE, SLICE = 1 << 19, 2 << 20
#: Rows that are decoded at once.
ROWS = 256
#: Words of up to so many symbols run through the automaton together; so many symbols at once.
WORD, PART = 64, 1 << 17
_NEVER = 1 << 40


class MergeAutomaton:
    """The automaton of a vocabulary and its merges, over symbols that are strings."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        size = max(vocab.values()) + 1
        self.names = [""] * size
        for s, i in vocab.items():
            self.names[i] = s
        none = array("i", [-1])
        self.left, self.right = none * size, none * size
        self.made = none * size  # time of the gadget that made the token
        self.cuts: dict[int, int] = {}
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        composed = {m for _, _, m in pairs}
        labels = [token for token in vocab.values() if token not in composed]
        for time, (u, v, merged) in enumerate(pairs):
            if self._gadget(time, u, v, merged):
                labels.append(merged)
        self._left, self._right, self._made = (np.frombuffer(x, np.int32) for x in (self.left, self.right, self.made))
        self._cut_keys, self._cut_times = _sorted_table(self.cuts)
        self._build_trie(labels)
        # The transition table: an arc (q << 20 | s) at the place of its hash, and whether it exists.
        self.arcs, self.exists = np.full(TABLE, -1, np.int64), np.zeros(TABLE, bool)

    def _build_trie(self, labels: list[int]) -> None:
        """The trie of labels as sorted keys (node << 9 | symbol) with nodes; ``ends`` has the token of a node."""
        texts = [self.names[t].replace(WORD_END, "\0") for t in labels]
        self.alphabet = {c: k for k, c in enumerate(sorted(set("".join(texts)) | {"\0"}))}
        if len(self.alphabet) >= 1 << 9:
            raise ValueError("over 511 symbols")
        flat = np.array([self.alphabet[c] for c in "".join(texts)], np.int64)
        length = np.array([len(t) for t in texts], np.int64)
        first = np.cumsum(length) - length
        node, keys, count = np.zeros(len(texts), np.int64), [], 1
        for depth in range(int(length.max())):
            going = np.flatnonzero(length > depth)
            level, place = np.unique(node[going] << 9 | flat[first[going] + depth], return_inverse=True)
            node[going] = count + place
            keys.append(level)
            count += len(level)
        self.keys = np.concatenate(keys)  # nodes are numbered in this order
        self.below = np.arange(1, count, dtype=np.int32)
        order = np.argsort(self.keys)
        self.keys, self.below = self.keys[order], self.below[order]
        self.ends = np.full(count, -1, np.int32)
        self.ends[node] = labels

    def _gadget(self, time: int, u: int, v: int, merged: int) -> bool:
        """Composes a merge; False if v never follows u at this time, so that there is nothing to compose."""
        if self.made[merged] >= 0:
            raise ValueError("two merges make one token")
        if not self._joined(u, v, time):
            return False
        self.left[merged], self.right[merged], self.made[merged] = u, v, time
        self.cuts[u << 20 | v] = time
        return True

    def _joined(self, q: int, s: int, limit: int = _NEVER) -> bool:
        """Whether the state of ``q`` has an arc ``s`` after the gadgets before ``limit``."""
        cuts, left, right, made = self.cuts, self.left, self.right, self.made
        gone_s = limit
        while s >= 0:
            x, gone_q = q, limit
            while x >= 0:
                cut = cuts.get(x << 20 | s)
                # Of a run of equal tokens the left two merge first, so a cut at the time when s itself went counts.
                if cut is not None and cut < gone_q and cut <= gone_s and cut < limit:
                    return False
                gone_q = made[x]
                x = right[x]
            gone_s = made[s]
            s = left[s]
        return True

    def _resolve(self, arcs: np.ndarray) -> np.ndarray:
        """``_joined`` for arcs (q << 20 | s), all gadgets composed."""
        there = np.ones(len(arcs), bool)
        at = np.arange(len(arcs))
        s, gone_s = arcs & (1 << 20) - 1, np.full(len(arcs), _NEVER)
        q0 = arcs >> 20
        while len(at):
            x, gone_q, inner = q0[at], np.full(len(at), _NEVER), np.arange(len(at))
            bad = np.zeros(len(at), bool)
            while len(inner):
                key = x << 20 | s[inner]
                k = np.minimum(np.searchsorted(self._cut_keys, key), len(self._cut_keys) - 1)
                time = self._cut_times[k]
                bad[inner] |= (self._cut_keys[k] == key) & (time < gone_q) & (time <= gone_s[inner])
                gone_q, x = self._made[x].astype(np.int64), self._right[x].astype(np.int64)
                stay = (x >= 0) & ~bad[inner]
                inner, x, gone_q = inner[stay], x[stay], gone_q[stay]
            there[at[bad]] = False
            gone_s, s = self._made[s].astype(np.int64), self._left[s].astype(np.int64)
            stay = (s >= 0) & ~bad
            at, s, gone_s = at[stay], s[stay], gone_s[stay]
        return there

    def transitions(self, arcs: np.ndarray) -> np.ndarray:
        """Which arcs exist: read from the table, and written there when they are taken first."""
        slot = (arcs * 0x9E3779B1 >> 12) % TABLE
        new = np.flatnonzero(self.arcs[slot] != arcs)
        there = self.exists[slot]
        if len(new):
            names, place = np.unique(arcs[new], return_inverse=True)
            found = self._resolve(names)
            there[new] = found[place]
            slot = (names * 0x9E3779B1 >> 12) % TABLE
            _, last = np.unique(slot[::-1], return_index=True)
            keep = len(names) - 1 - last  # one arc a slot
            self.arcs[slot[keep]], self.exists[slot[keep]] = names[keep], found[keep]
        return there

    def _edges(self, codes: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All labels that stand in ``codes`` from a position of ``begin``, up to its ``stop``: position, end, token."""
        at, node, depth = begin, np.zeros(len(begin), np.int64), 0
        out: list[tuple] = []
        while len(at):
            key = node << 9 | codes[at + depth]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[k] == key
            at, stop, node = at[hit], stop[hit], self.below[k[hit]].astype(np.int64)
            depth += 1
            token = self.ends[node]
            good = token >= 0
            out.append((at[good], at[good] + depth, token[good].astype(np.int64)))
            going = at + depth < stop
            at, stop, node = at[going], stop[going], node[going]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def encode_codes(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words, one after the other, and where each word's tokens end. ``ends`` are the words' ends in ``codes``."""
        n = len(ends)
        starts = np.concatenate([[0], ends[:-1]])
        word = np.repeat(np.arange(n), ends - starts)
        position = np.arange(len(codes))
        begin, end, token = self._edges(codes, position, ends[word])
        word = word[begin]
        step = begin - starts[word]
        order = np.argsort(step, kind="stable")
        begin, end, token, step = begin[order] + word[order], end[order] + word[order], token[order], step[order]
        bounds = np.searchsorted(step, np.arange(int(step[-1]) + 2)) if len(step) else np.zeros(1, np.int64)
        # A word has a place before each symbol and one at its end.
        first = starts + np.arange(n)
        came, last = np.full(len(codes) + n, -1), np.full(len(codes) + n, -1)
        came[first] = first
        for k in range(len(bounds) - 1):
            some = slice(bounds[k], bounds[k + 1])
            f, t, s = begin[some], end[some], token[some]
            good = (came[f] >= 0) & (came[t] < 0)
            f, t, s = f[good], t[good], s[good]
            if k:
                good = self.transitions(last[f] << 20 | s)
                f, t, s = f[good], t[good], s[good]
            came[t], last[t] = f, s
        at = ends + np.arange(n)
        if (came[at] < 0).any():
            raise ValueError("a word has a symbol that the vocabulary lacks")
        words, tokens = [], []
        going = np.flatnonzero(at != first)
        while len(going):
            words.append(going)
            tokens.append(last[at[going]])
            at[going] = came[at[going]]
            going = going[at[going] != first[going]]
        count = np.zeros(n, np.int64)
        for w in words:
            count[w] += 1
        out, place = np.empty(int(count.sum()), np.uint32), np.cumsum(count)
        for k, w in enumerate(words):
            out[place[w] - 1 - k] = tokens[k]
        return out, place

    def encode_long(self, codes: np.ndarray) -> np.ndarray:
        """Tokens of one long word, place by place; memory beside the word's places is bounded."""
        n = len(codes)
        last, came = array("i", [-1]) * (n + 1), array("q", [-1]) * (n + 1)
        came[0] = 0
        arcs: dict[int, bool] = {}
        for a in range(0, n, PART):
            position = np.arange(a, min(n, a + PART))
            begin, end, token = self._edges(codes, position, np.full(len(position), n))
            order = np.argsort(begin, kind="stable")
            for i, j, s in zip(begin[order].tolist(), end[order].tolist(), token[order].tolist(), strict=True):
                if came[i] < 0 or came[j] >= 0:
                    continue
                q = last[i]
                if q >= 0:
                    arc = q << 20 | s
                    there = arcs.get(arc)
                    if there is None:
                        if len(arcs) >= PART:
                            arcs.clear()
                        there = arcs[arc] = self._joined(q, s)
                    if not there:
                        continue
                last[j], came[j] = s, i
        if came[n] < 0:
            raise ValueError("a word has a symbol that the vocabulary lacks")
        out = array("I")
        while n > 0:
            out.append(last[n])
            n = came[n]
        return np.frombuffer(out, np.uint32)[::-1]

    def encode(self, word: str) -> list[int]:
        """Tokens of a word of symbols; the word end is added here."""
        try:
            codes = np.array([self.alphabet[c] for c in word + "\0"], np.int64)
        except KeyError as x:
            raise ValueError("a word has a symbol that the vocabulary lacks") from x
        return (self.encode_codes(codes, np.array([len(codes)]))[0] if len(codes) <= WORD else self.encode_long(codes)).tolist()


def _sorted_table(table: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.array([*table, -1], np.int64)
    order = np.argsort(keys)
    return keys[order], np.array([*table.values(), 0], np.int64)[order]


class Tokenizer:
    """Normalisation, pre-splitting and the automaton of a word vocabulary file.

    Texts are encoded together: every distinct word of them runs through the automaton
    once, all words at the same time. Nothing is kept from one call to the next but the
    transition table, whose size is fixed.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.automaton = MergeAutomaton(spec["model"]["vocab"], [tuple(m) for m in spec["model"]["merges"]])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = self.automaton.names
        self.names += [""] * (max([*self.special.values(), 0]) + 1 - len(self.names))
        for s, i in self.special.items():
            self.names[i] = s
        self.code = np.array([self.automaton.alphabet.get(c, (1 << 9) - 1) for c in byte_symbols()], np.int64)
        self.finish = self.automaton.alphabet["\0"]
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        self.words_of = regex.compile(PATTERN).findall
        self.odd = re.compile("[\x1c-\x1f]").search
        self.odd_split = re.compile("[^\\S\x1c-\x1f]+").split

    def _plain(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return [text] if text.isalpha() else self.words_of(text)

    def _pieces(self, chunk: str) -> list[str | int]:
        """Words and special tokens of a text without white space."""
        if "<|" not in chunk:
            return self._plain(chunk)
        special = self.special
        return [w for p in self.cut(chunk) for w in ([special[p]] if p in special else self._plain(p))]

    def _encode_words(self, words: list[str]) -> dict[str, bytes]:
        raw = [w.encode() for w in words]
        order = sorted(range(len(words)), key=lambda k: len(raw[k]))
        short = sum(len(x) < WORD for x in raw)
        out, a = {}, 0
        while a < len(order):
            size = len(raw[order[a]]) + 1
            if size > WORD:
                codes = np.append(self.code[np.frombuffer(raw[order[a]], np.uint8)], self.finish)
                out[words[order[a]]] = self.automaton.encode_long(codes).astype("<u4").tobytes()
                a += 1
                continue
            ends = np.cumsum([len(raw[k]) + 1 for k in order[a : a + PART // size + 1]])
            fit = max(1, min(int(np.searchsorted(ends, PART, "right")), short - a))
            own, ends = order[a : a + fit], ends[:fit]
            codes = np.full(int(ends[-1]), self.finish, np.int64)
            inside = np.ones(len(codes), bool)
            inside[ends - 1] = False
            codes[inside] = self.code[np.frombuffer(b"".join([raw[k] for k in own]), np.uint8)]
            tokens, place = self.automaton.encode_codes(codes, ends)
            data, b = tokens.astype("<u4").tobytes(), 0
            for k, e in zip(own, (place * 4).tolist(), strict=True):
                out[words[k]] = data[b:e]
                b = e
            a += len(own)
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Tokens of each text as little-endian unsigned 32-bit integers."""
        parts = [list(filter(None, self.odd_split(t))) if self.odd(t) else t.split() for t in texts]
        known: dict = {}
        for part in parts:
            known.update(dict.fromkeys(part))
        for chunk in known:
            pieces = self._pieces(chunk)
            known[chunk] = pieces[0] if len(pieces) == 1 else pieces
        words = {p for p in known.values() if isinstance(p, str)}
        words.update(w for p in known.values() if isinstance(p, list) for w in p if isinstance(w, str))
        coded: dict = self._encode_words(list(words))
        special = {i: i.to_bytes(4, "little") for i in self.special.values()}
        coded |= special
        for chunk, p in known.items():
            known[chunk] = b"".join([coded[w] for w in p]) if isinstance(p, list) else coded[p]
        return [b"".join(map(known.__getitem__, part)) for part in parts]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs, one space between two, as the vocabulary file names no decoder."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    """One per worker; compiling takes about a second."""
    return Tokenizer(path)


def _per_slice(docs: DataFrame, at: int, run: Callable, schema) -> DataFrame:
    """``run`` on slices of bounded text (column ``at``); at the end of a task its memory goes back."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return tidied(run(part) for whole in batches for part in text_slices(whole, at, SLICE))

    return docs.mapInArrow(task, schema)


def _ids(coded: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in coded)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<i4")))


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with ``ids_col``, the tokens of ``text_col`` as array<int>, after all its columns.

    With ``decoded_col``, the text decoded from the tokens follows, in the same pass.
    Null and empty texts give an empty array. Columns that have one of the new names are
    replaced; repeated rows stay repeated; an empty table gives an empty table. A text of
    any length is encoded whole, and needs memory in proportion to it.
    """
    new = [ids_col, *([decoded_col] if decoded_col else [])]
    kept = [c for c in docs.columns if c not in new]
    types = [F.array().cast("array<int>").alias(ids_col), *([F.lit("").alias(decoded_col)] if decoded_col else [])]
    source = docs.select(docs[text_col].cast("string").alias("__fw_text"), *kept)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = tokenizer(path)
        coded = t.encode_all([x or "" for x in batch.column(0).to_pylist()])
        more = [pa.array([t.decode(x) for x in coded], pa.string())] if decoded_col else []
        return pa.RecordBatch.from_arrays([*batch.columns[1:], _ids(coded), *more], [*kept, *new])

    return _per_slice(source, 0, run, docs.select(*kept, *types).schema)


def decode(docs: DataFrame, path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with ``out_col``, the decoded text of ``ids_col``; null and empty arrays give an empty text.

    A column named ``out_col`` is replaced; repeated rows stay repeated; an empty table
    gives an empty table.
    """
    kept = [c for c in docs.columns if c != out_col]
    schema = docs.select(*kept, F.lit("").alias(out_col)).schema
    at = kept.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = tokenizer(path).decode
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                texts = [back(np.array(x or [], "<u4").tobytes()) for x in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, out_col])

    return docs.select(*kept).mapInArrow(lambda batches: tidied(run(batches)), schema)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and hashes of the tokens and of the text decoded from them, for every row.

    Null and empty texts have no tokens and decode to the empty text. Null and repeated
    ids pass through, repeated rows stay repeated, other columns are ignored, an empty
    table gives an empty table. A text of any length is read whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = tokenizer(path)
        ids = t.encode_all([x or "" for x in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(t.decode(x).encode()).hexdigest() for x in ids], pa.string()),
            ],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return _per_slice(source, 1, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Tokenisers against their library, on fixtures with every edge."""

import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from framewright.llm import bpe_automaton, token_counts
from framewright.llm.queries import QUERIES, tokenizer_path

tokenizers = pytest.importorskip("tokenizers")

ALPHABET = list("abcdefgh  \n\t'stlmdver<|endoftext|>ÀéßΣσİıſ①½ⅷ٣あ한́ \u0085\u001c​🙂\u200d﻿ ǅﬁ\u0000𝔘")
EDGES = ["", " ", "  ", "a", "<|endoftext|>", "x<|startoftext|> <|endoftext|>", "aaaa" * 300, "  x  ", "x ", "it's I'LL  we've\n\n  ok", "\n \n", "\u00a0a\u00a0b"]


def texts():
    rng = random.Random(5)
    return EDGES + ["".join(rng.choices(ALPHABET, k=rng.randint(0, 50))) for _ in range(1500)] + ["".join(rng.choices("aothein", k=rng.randint(1, 40))) for _ in range(500)]


def test_automaton_equals_the_library():
    path = tokenizer_path("word_bpe_49k.json")
    want, mine = tokenizers.Tokenizer.from_file(path), bpe_automaton.tokenizer(path)
    for t in texts():
        ids = want.encode(t, add_special_tokens=False).ids
        got = mine.encode(t)
        assert got == struct.pack(f"<{len(ids)}I", *ids)
        assert mine.decode(got) == want.decode(ids, skip_special_tokens=False)


def test_counts_equal_the_library():
    path = tokenizer_path("byte_bpe_50k.json")
    want, mine = tokenizers.Tokenizer.from_file(path), token_counts.Counter(path)
    for t in texts():
        assert mine.count(t) == len(want.encode(t, add_special_tokens=False).ids)


def test_small_automaton():
    a = bpe_automaton.MergeAutomaton({"a": 0, "b": 1, "a</w>": 2, "b</w>": 3, "aa": 4, "ab</w>": 5, "aaab</w>": 6}, [("a", "a"), ("a", "b</w>"), ("aa", "ab</w>")])
    for word, ids in {"a": [2], "aaa": [4, 2], "aab": [4, 3], "aaab": [6], "aaaab": [4, 4, 3], "ba": [1, 2]}.items():
        assert a.encode(word) == ids
    with pytest.raises(ValueError):
        a.encode("c")


def fixture(spark):
    rows = [(1, None, "x", "y"), (2, "", "x", None), (3, "a b c", None, "y"), (3, "a b c", None, "y"), (None, "word " * 3000, "x", "y"), (5, "q" * 100_000, "x", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, token_ids string, n_tokens string")


def test_spark_operators(spark):
    path = tokenizer_path("word_bpe_49k.json")
    docs = fixture(spark)
    coded = bpe_automaton.decode(bpe_automaton.encode(docs, path), path)
    assert coded.columns == ["doc_id", "text", "n_tokens", "token_ids", "decoded"]
    got = {(r.doc_id, len(r.token_ids)): r.decoded for r in coded.collect()}
    assert got[1, 0] == "" and got[2, 0] == "" and got[3, 3] == "a</w> b</w> c</w>" and (None, 3000) in got
    trip = bpe_automaton.round_trip(docs, path).collect()
    assert len(trip) == 6 and {r.ids_sha256 for r in trip if r.doc_id == 1} == {hashlib.sha256(b"").hexdigest()}
    counts = {r.doc_id: r for r in token_counts.count_tokens(docs, tokenizer_path("byte_bpe_50k.json")).collect()}
    assert (counts[1].n_tokens, counts[2].n_bytes, counts[3].n_tokens) == (0, 0, 3) and counts[5].over_limit and counts[None].n_tokens == 3001
    empty = docs.where("doc_id = 77")
    assert bpe_automaton.encode(empty, path).count() == token_counts.count_tokens(empty, tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_queries(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit(""))).collect()
    want = tokenizers.Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = {d: e.ids for (d, _), e in zip(docs, want.encode_batch([t for _, t in docs], add_special_tokens=False), strict=True)}
    got = {r.doc_id: r for r in QUERIES["op2_bpe_automaton"](spark, sf_dir).collect()}
    assert got.keys() == ids.keys()
    for d, x in ids.items():
        assert got[d].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(x)}I", *x)).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(want.decode(x, skip_special_tokens=False).encode()).hexdigest()
    bytes_ = tokenizers.Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    n = {d: len(e.ids) for (d, _), e in zip(docs, bytes_.encode_batch([t for _, t in docs], add_special_tokens=False), strict=True)}
    assert {r.doc_id: r.n_tokens for r in QUERIES["op8_token_counts"](spark, sf_dir).collect()} == n

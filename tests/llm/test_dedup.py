"""Dedup operators against brute force."""

import collections
import random
import re
import string

import pytest

from framewright.llm import exact_dedup, minhash_dedup, substring_dedup
from framewright.llm.components import components
from framewright.llm.queries import ORACLE_SQL, QUERIES
from framewright.llm.workspace import Workspace
from tests.oracle import compare

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b") for r in rows], "doc_id long, text string, kept string, keep_id string").repartition(3)


EDGES = [(100, None), (101, ""), (102, "x" * 1_000_000), (103, " ".join(["z"] * 3000)), (104, " ".join(["z"] * 14)), (105, "a b"), (106, "A  B"), (107, "c"), (107, "c"), (None, "null id"), (None, None)]


def near_copies(seed=3):
    rng = random.Random(seed)
    base = [[f"{rng.random():.3f}" for _ in range(n)] for n in (10, 40, 60, 200)]
    rows = []
    for i in range(200):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            t[rng.randrange(len(t))] = rng.choice("abCd")
        rows.append((i, rng.choice([" ", "\n", "  "]).join(t)))
    return rows


def test_exact(spark):
    rows = EDGES + [(200 + k, "Hot TEXT") for k in range(300)] + [(900, "hot text"), (901, "hot text É"), (902, "hot text é")]
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(LOWER)].append(d)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(d, keep, len(ids), d == keep) for d in ids]
    key = lambda r: repr(r)
    got = exact_dedup.classify(table(spark, rows)).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got], key=key) == sorted(want, key=key)
    kept = exact_dedup.dedup(table(spark, rows))
    assert kept.columns == ["doc_id", "text", "kept", "keep_id"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((w[0] for w in want if w[3]), key=str)


def test_dedup_agrees_with_classify_on_null_and_reused_ids(spark):
    rows = [(5, "a"), (6, "A"), (5, "only once"), (None, "a"), (None, "a"), (None, "null only"), (None, "NULL only")]
    kept = sorted(((r.doc_id, r.text) for r in exact_dedup.dedup(table(spark, rows)).collect()), key=repr)
    assert kept == sorted([(6, "A"), (5, "only once"), (None, "null only"), (None, "NULL only")], key=repr)


def test_exact_dedup_judges_a_reused_id_by_its_text(spark):
    rows = [(1, "twice"), (2, "TWICE"), (1, "once")]
    assert sorted((r.doc_id, r.text) for r in exact_dedup.dedup(table(spark, rows)).collect()) == [(1, "once"), (2, "TWICE")]


def brute_repeats(rows):
    low = -(1 << 63)
    words = [(low if d is None else d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(d, first.get(k, d))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone[i : i + 13] = [True] * 13
        out.append((None if d == low else d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def passages():
    rng = random.Random(4)
    base = [" ".join(rng.choices(["a", "b", "c", "dé", "e"], k=40)) for _ in range(4)]
    rows = list(EDGES)
    for i in range(60):
        t = rng.choice(base).split()
        a = rng.randint(0, 20)
        own = [str(rng.random()) for _ in range(rng.randint(0, 9))]
        rows.append((rng.randint(0, 50), rng.choice([" ", "\n", "  "]).join(own + t[a : a + rng.randint(5, 25)] + own[:3] + rng.choice(base).split()[:14])))
    return rows


def test_substring(spark):
    rows = passages()
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(table(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(brute_repeats(rows), key=repr)


def test_substring_spans_cover_what_is_removed(spark):
    for r in substring_dedup.remove_repeats(table(spark, passages())).collect():
        assert sum(s.stop - s.start for s in r.removed) == r.n_removed
        assert all(s.stop - s.start >= substring_dedup.WINDOW for s in r.removed)


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_components(rows, shingle=3, percent=85):
    low = -(1 << 63)
    sets = [(low if d is None else d, shingles(t, shingle)) for d, t in rows]
    ids = collections.defaultdict(list)
    for d, s in sets:
        ids[s].append(d)
    unique = [s for s in ids if s]
    above = list(range(len(unique)))

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for i, s in enumerate(unique):
        for j in range(i):
            both = len(s & unique[j])
            if 100 * both >= percent * (len(s) + len(unique[j]) - both):
                a, b = top(i), top(j)
                above[max(a, b)] = min(a, b)
    least = collections.defaultdict(lambda: 1 << 63)
    for i, s in enumerate(unique):
        least[top(i)] = min(least[top(i)], *ids[s], least[top(i)])
    place = {s: least[top(i)] for i, s in enumerate(unique)}
    real = lambda x: None if x == low else x
    return [(real(d), len(s), real(place.get(s, d)), d == place.get(s, d)) for d, s in sets]


def test_minhash(spark):
    rows = near_copies() + [(d if d is None else d + 1000, t) for d, t in EDGES]
    for shingle, percent in ((3, 85), (5, 80)):
        got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.classify(table(spark, rows), shingle=shingle, percent=percent).collect()]
        assert sorted(got, key=repr) == sorted(brute_components(rows, shingle, percent), key=repr)


def test_dedup_keeps_one_of_each_group(spark):
    rows = near_copies()
    kept = minhash_dedup.dedup(table(spark, rows))
    assert kept.columns == ["doc_id", "text", "kept", "keep_id"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, _, k in brute_components(rows, 5, 80) if k)


def test_minhash_dedup_agrees_with_classify_on_null_and_reused_ids(spark):
    long = "one two three four five six seven eight"
    rows = [(5, long), (6, long.upper()), (6, "only once"), (None, "x y z"), (None, "x y z"), (None, "another"), (7, "x y z"), (7, "X y z")]
    kept = sorted(((r.doc_id, r.text) for r in minhash_dedup.dedup(table(spark, rows)).collect()), key=repr)
    assert kept == sorted([(5, long), (6, "only once"), (None, "x y z"), (None, "x y z"), (None, "another")], key=repr)


def test_large_group_in_small_blocks(spark, monkeypatch):
    """Probes and members in many blocks find the same components."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 3)
    rows = near_copies(9)
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.classify(table(spark, rows)).collect()]
    assert sorted(got) == sorted(brute_components(rows, 5, 80))


@pytest.mark.parametrize("run", [exact_dedup.classify, exact_dedup.dedup, substring_dedup.remove_repeats, minhash_dedup.classify, minhash_dedup.dedup])
def test_empty(spark, run):
    assert run(table(spark, [(1, "x")]).where("doc_id = 2")).count() == 0


def test_joining_links():
    """Members as differences from their leader; only joins of components come out."""
    import numpy as np

    base = np.arange(100, dtype=np.uint64)
    sets = [np.delete(base, range(k, k + w)) for k, w in ((0, 0), (0, 4), (0, 30), (1, 30), (60, 30))]
    rows = [(k, root, np.setdiff1d(base, x).tobytes(), b"") for k, (root, x) in enumerate(zip((0, 0, 2, 3, 4), sets, strict=True))]
    found = minhash_dedup.joining_links(100, rows[2:], rows, 85)
    assert [tuple(sorted(f)) for f in found] == [(2, 3)]
    assert minhash_dedup.joining_links(100, rows[:2], rows[:2], 85) == minhash_dedup.joining_links(100, [], rows, 85) == []


def test_components_of_a_chain(spark):
    space = Workspace(spark, "test")
    links = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long").repartition(4), space, "c").collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 101: 100}


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op5_substring_dedup", "op10_minhash_dedup"])
def test_oracle(spark, sf_dir, name):
    compare(QUERIES[name](spark, sf_dir), ORACLE_SQL[name], sf_dir)


def test_minhash_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in QUERIES["op10_minhash_dedup"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(brute_components(rows))

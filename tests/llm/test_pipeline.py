"""The pipeline against its stages by brute force, on a small fixture."""

import collections
import hashlib
import math

from pyspark.sql import functions as F

import corpus_pipeline
from framewright.llm import mixing, toxicity
from framewright.llm.queries import QUERIES, tokenizer_path
from tests.llm.test_dedup import LOWER, brute_components


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
    empty = docs.where("doc_id < 0")
    assert all(stage(spark, empty, sf_dir).count() == 0 for _, stage in corpus_pipeline.STAGES)


def poisson_copies(rows):
    """Copies by id, of (id, text, source), with plain Python: rates, inversion, hash."""
    chars = collections.Counter()
    for _, t, s in rows:
        chars[s] += len(t or "")
    total, out = sum(chars.values()), []
    for d, _, s in rows:
        rate = total / len(chars) / chars[s] if chars[s] else 1.0
        draws = max(1, math.ceil(rate / mixing.UNIT_RATE))
        for j in range(1, draws + 1):
            u = int(hashlib.md5(f"{mixing.SEED}|{'' if d is None else d}|{j}".encode()).hexdigest()[:13], 16) / (1 << 52)
            p = c = math.exp(-rate / draws)
            for k in range(1, 65):
                out += [d] * (c <= u)
                p *= rate / draws / k
                c += p
            out += [d] * (c <= u)
    return collections.Counter(out)


def brute_run(rows, score):
    """Ids of the run's rows, of (id, text, source): each stage by plain Python."""
    rows = [r for r in rows if score(r[1]) < toxicity.THRESHOLD]
    groups = collections.defaultdict(list)
    for d, t, _ in rows:
        groups[(t or "").translate(LOWER)].append(d)
    best = {t: max((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    rows = [r for r in rows if best[(r[1] or "").translate(LOWER)] == r[0]]
    judged = brute_components([r[:2] for r in rows], 5, 80)
    return poisson_copies([r for r, (*_, k) in zip(rows, judged, strict=True) if k])


def test_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert collections.Counter(r.doc_id for r in got) == brute_run([(r.doc_id, r.text, r.source) for r in docs.collect()], model.score)
    import tokenizers

    library = tokenizers.Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_with_nulls_repeats_and_clashing_columns(spark, sf_dir, tmp_path):
    long = " ".join(f"w{k}" for k in range(400))
    rows = [
        (1, None, "a"), (2, "", None), (3, "A quiet day", "a"), (4, "a QUIET day", "a"), (None, "a quiet day", "b"), (None, "no id", None), (5, long, "a"), (6, long + " more", "b"),
        (6, "another text under a used id", "b"), (7, "same row", None), (7, "same row", None), (8, "x" * 200_000, "a"), (9, "You are a worthless idiot. I will kill you!", "a"),
    ]
    names = ["decoded", "token_ids", "n_tokens", "decoded_sha256", "mix_key", "mix_copy", "score", "kept", "digest"]
    docs = spark.createDataFrame([(*r, *(f"{c} {k}" for c in names)) for k, r in enumerate(rows)], "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(got[0]) == 3 + len(names) and got[0].mix_key.startswith("mix_key ") and got[0].decoded.startswith("decoded ")
    assert isinstance(got[0].n_tokens, int)
    assert collections.Counter(r.doc_id for r in got) == brute_run(rows, toxicity.Model().score)


def test_other_queries_do_without_it():
    assert "pipeline" not in QUERIES

"""A training-data pipeline over ``documents``: five stages, each an operator of framewright.llm.

Every stage reads all that the stage before it kept, and all but the last return the
columns of ``documents``. Between stages the rows are a Parquet table in the shared
folder, so that a lost executor costs the work of one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import bpe_automaton, exact_dedup, minhash_dedup, mixing, toxicity
from framewright.llm.queries import table, tokenizer_path
from framewright.llm.workspace import Workspace


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the model learns from the labelled rows among them.

    Null and empty texts stay. Rows with equal texts have equal scores. Further columns pass through.
    """
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays, with all its columns.

    Null texts count as empty. A null id loses against any other; where all ids of a
    group are null, and where rows repeat the largest id with the same text, all these stay.
    """
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 similarity on shingles of five words, the row with the smallest id stays, with all its columns.

    Texts without words are linked with nothing. A null id counts as the smallest; rows
    that repeat the smallest id of their group stay.
    """
    return minhash_dedup.dedup(docs, shingle=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Equal shares of characters for all sources, by Poisson replication, in global random order.

    Null sources are one source, null texts have no characters; repeated ids get equal
    numbers of copies. All columns of ``docs`` come out as they were.
    """
    return mixing.mix(docs, copy_col="__fw_mix_copy", key_col="__fw_mix_key").select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with token_ids, n_tokens, and the hash of the text decoded from them.

    Null and empty texts have no tokens. Columns of ``docs`` that have one of the three
    names are replaced; all others, and repeated rows, pass through.
    """
    coded = bpe_automaton.encode(docs, tokenizer_path("word_bpe_49k.json"), decoded_col="__fw_decoded")
    kept = [c for c in docs.columns if c not in ("token_ids", "n_tokens", "decoded_sha256")]
    return coded.select(*kept, "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2("__fw_decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]

#: SQL can express neither the classifier nor the tokenizer; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = space.save(docs, name)
            space.release()
    return docs

"""Exact dedup by skew-safe combining.

Texts are equal when they are identical after lower-casing A-Z. Equal texts meet in
three stages, and each compares the full normalised text beside its digest:

1. every task combines the rows it has read (partial aggregation),
2. the task winners of one (digest, salt) combine,
3. the at most ``salts`` winners of a digest combine into the global winner.

A text that a third of all rows share therefore reaches a task as a few rows per
upstream task, never as all its rows. The result goes back to the documents by
(digest, salt, two more content hashes), so that a hot text is dealt over ``salts``
keys; skewed ones among them are split by AQE, as both sides are plain shuffles. This
lookup alone compares no texts: a false match would need equal SHA-256, a second 64-bit
hash and equal length.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.workspace import Workspace

#: Salts of a digest; at most 64, as the salts that were met are the bits of a long.
SALTS = 64


def normalised(text: Column) -> Column:
    """``text`` with A-Z lower-cased; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _keyed(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    text = normalised(docs[text_col])
    return docs.select(
        docs[id_col].alias("doc_id"),
        text.alias("norm"),
        F.sha2(text, 256).alias("digest"),
        F.pmod(F.xxhash64(docs[id_col]), F.lit(salts)).cast("int").alias("salt"),
        F.xxhash64(text).alias("check"),
        F.octet_length(text).alias("bytes"),
    )


def _classes(keyed: DataFrame) -> DataFrame:
    """A row for each (digest, salt) with the winner and the size of its whole group."""
    content = ["digest", "check", "bytes", "norm"]
    salted = keyed.groupBy("salt", *content).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    whole = salted.groupBy(*content).agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), "salt")).alias("met"))
    met = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.call_function("getbit", F.col("met"), k) == 1)
    return whole.select("digest", "check", "bytes", F.explode(met).alias("salt"), "keep_id", "group_size")


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    The largest id of a group stays. Null and empty texts are one group. A null id
    loses against any other; a group of null ids only has keep_id null, and its rows
    stay. Rows that repeat the id of the winner stay too. A text of any length is compared
    whole. An empty table gives an empty table; other columns are ignored. ``salts`` is 64
    at most.
    """
    space = Workspace(docs.sparkSession, "exact-dedup")
    keyed = _keyed(docs, id_col, text_col, salts)
    classes = space.save(_classes(keyed), "classes")
    space.release()
    by = ["digest", "check", "bytes", "salt"]
    return keyed.drop("norm").join(classes, by).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns; edge cases as there.

    Losers are joined by id and digest, null-safely: rows with both equal have one
    verdict, and a row that has the id of a loser, but another text, is not touched. The
    number of losers grows with the table, so both sides are shuffled, at every size.
    """
    space = Workspace(docs.sparkSession, "exact-dedup")
    losers = classify(docs, id_col, text_col, salts).where("NOT kept").select(F.col("doc_id").alias("__fw_loser"), F.col("text_sha256").alias("__fw_digest"))
    losers = space.save(losers.distinct(), "losers")
    space.release()
    same = docs[id_col].eqNullSafe(losers["__fw_loser"]) & (F.sha2(normalised(docs[text_col]), 256) == losers["__fw_digest"])
    return docs.join(losers.hint("merge"), same, "left_anti")

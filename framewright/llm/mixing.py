"""Mixing sources to target weights by Poisson replication.

Every document of a source gets a number of copies from a Poisson distribution whose
mean is the source's target repetition rate. The draw is the inversion of the
distribution at a uniform number taken from a hash of seed and id, so that a rerun, a
retried task or another partitioning gives the same copies. The copies are put in a
global random order by a hash of seed, id and copy number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.workspace import Workspace

SEED = "mix-1"
#: Up to so many sources, the table of rates is broadcast (a row is under 2 KB); beyond, it is joined by shuffle.
BROADCAST_SOURCES = 10_000
#: A rate above this is drawn as the sum of several Poisson numbers of equal rates below it.
UNIT_RATE = 16.0


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a hash of ``parts``."""
    digest = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def cumulative(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson number of ``rate`` up to ``UNIT_RATE``, until the rest is below 1e-15."""
    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.get(acc["c"], F.size(acc["c"]) - 1) + p)).alias("c"))

    first = F.exp(-rate)
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(first.alias("p"), F.array(first).alias("c")), step, lambda acc: acc["c"])


def rates(docs: DataFrame, space: Workspace, weights: dict[str, float] | None = None, source_col: str = "source", text_col: str = "text", budget: float = 1.0) -> DataFrame:
    """A row for each source: source, chars, rate, draws, and the cumulative distribution of a draw.

    ``weights`` are the sources' target shares of all characters (default: equal
    shares); a source that is not named gets none. The mixture aims at ``budget``
    times the characters of ``docs``. A source without characters gets rate 1.
    """
    sums = docs.groupBy(docs[source_col].alias("source")).agg(F.sum(F.length(F.coalesce(docs[text_col], F.lit(""))).cast("long")).alias("chars"))
    if weights is None:
        share = F.lit(1.0)
    else:
        share = F.coalesce(F.try_element_at(F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v))))), F.col("source")), F.lit(0.0))
    sums = space.save(sums.withColumn("share", share), "sums")
    chars, shares = sums.agg(F.sum("chars"), F.sum("share")).first()  # two numbers
    rate = F.when(F.col("chars") > 0, F.col("share") / F.lit(shares or 1.0) * F.lit(float(chars or 0)) * F.lit(float(budget)) / F.col("chars")).otherwise(1.0)
    out = sums.select("source", "chars", rate.alias("rate"))
    out = out.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / UNIT_RATE)).cast("int"))
    return out.withColumn("cdf", cumulative(F.col("rate") / F.col("draws")))


def _partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", budget: float = 1.0, seed: str = SEED,
    copy_col: str = "mix_copy", key_col: str = "mix_key",
) -> DataFrame:
    """All columns of ``docs`` with ``mix_copy`` (from 1) and ``mix_key``, in global order of the key.

    Null sources are a source of their own; null texts count no characters but are
    drawn like any other, and long texts as often as short ones. Rows that repeat an id
    get the same number of copies. An empty table gives an empty table. Columns named
    like the two new ones (``copy_col``, ``key_col``) are replaced.

    The keys are uniform, so partition k of n takes those whose first 32 bits fall into
    the k-th of n equal ranges: the rows are dealt in one pass, without a sample of them.
    """
    space = Workspace(docs.sparkSession, "mixing")
    table = space.save(rates(docs, space, weights, source_col, text_col, budget).select(F.col("source").alias("__fw_source"), F.col("draws").alias("__fw_draws"), F.col("cdf").alias("__fw_cdf")), "rates")
    few = table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    joined = docs.join(F.broadcast(table) if few else table, docs[source_col].eqNullSafe(table["__fw_source"]))

    def one(j: Column) -> Column:
        below = lambda u: F.size(F.filter(F.col("__fw_cdf"), lambda c: c <= u))
        return F.get(F.transform(F.array(uniform(F.lit(seed), docs[id_col], j)), below), 0)  # binds the number, else it is hashed again for every c

    drawn = F.aggregate(F.sequence(F.lit(1), F.col("__fw_draws")), F.lit(0), lambda n, j: n + one(j))
    copies = joined.withColumn("__fw_n", drawn).where("__fw_n > 0").withColumn("__fw_copy", F.explode(F.sequence(F.lit(1), F.col("__fw_n"))))
    key = F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("__fw_copy").cast("string")).cast("binary")), 1, 16)
    copies = copies.withColumn("__fw_key", key).drop("__fw_source", "__fw_draws", "__fw_cdf", "__fw_n")
    n = _partitions(docs.sparkSession)
    place = F.shiftright(F.conv(F.substring("__fw_key", 1, 8), 16, 10).cast("long") * n, 32).cast("int")
    dealt = copies.repartitionById(n, place).sortWithinPartitions("__fw_key", id_col, "__fw_copy")
    kept = [c for c in docs.columns if c not in (copy_col, key_col)]
    return dealt.select(*kept, F.col("__fw_copy").alias(copy_col), F.col("__fw_key").alias(key_col))

"""Connected components of a link table by distributed union-find.

Each task first joins its links in a local union-find and sends on a forest only. Then
large-star and small-star steps alternate until nothing changes: every node learns its
smallest neighbour, and neighbours are re-linked to it. Nothing is collected; the joins
are between plain tables, so that AQE can split the star of a hot root.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.workspace import Workspace


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) with v the smallest node of u's tree, for the links (a, b) of a task."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := above.get(top, top)) != top:
            top = up
        while above.get(x, x) != top:
            above[x], x = top, above.get(x, x)
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                above[max(a, b)] = min(a, b)
                above.setdefault(min(a, b), min(a, b))
    nodes = [x for x in above if root(x) != x]
    for k in range(0, len(nodes), 65536):
        part = nodes[k : k + 65536]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["u", "v"])


def components(links: DataFrame, space: Workspace, name: str) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) that is not the smallest of its component."""
    now = space.save(links.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_forest, "u long, v long").distinct(), f"{name}-0")
    k = 0
    while not _stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = space.save(large, f"{name}-{k}-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        now = space.save(small, f"{name}-{k + 1}")
        space.drop(f"{name}-{k}-large")
        space.drop(f"{name}-{k}")
        k += 1
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _stars(now: DataFrame) -> bool:
    """Whether every node has one neighbour, which has none above it: then each star is a component."""
    per = now.groupBy("u").agg(F.count("*").alias("n"))
    return per.where("n > 1").isEmpty() and now.join(per.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()

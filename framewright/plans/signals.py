"""The driver's tables as signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators.framing import dense_index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, ch, i, x): values in the order of event_id, which is dense."""
    return table(spark, sf_dir, "events").select(F.lit("events").alias("track"), F.lit(0).alias("ch"), F.col("event_id").alias("i"), F.col("value").alias("x"))


def channel(spark: SparkSession, sf_dir: str, event_type: str) -> DataFrame:
    """(track, i, x): the values of one event type, numbered from 0."""
    rows = table(spark, sf_dir, "events").where(F.col("event_type") == event_type).select("event_type", "event_id", F.col("value").alias("x"))
    return dense_index(rows, "event_type", "event_id").select(F.lit("events").alias("track"), "i", "x")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, x): one frame of 64 samples a row."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


#: The same signals in DuckDB SQL; of the last, one row a line of a vector.
EVENTS_SQL = "SELECT event_id AS i, value AS x FROM events"
VECTORS_SQL = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings"
LINES_SQL = f"SELECT vec_id, label, unnest(x) AS c, generate_subscripts(x, 1) - 1 AS line FROM ({VECTORS_SQL})"

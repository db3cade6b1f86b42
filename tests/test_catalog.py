"""Every signal query against its DuckDB SQL, and rows of those without."""

import pytest

from framewright.plans import catalog
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, sf_dir, name):
    compare(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_payload_of_texts(spark, sf_dir):
    import hashlib

    want = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = catalog.QUERIES["payload_text_double_and_reverse"](spark, sf_dir).collect()
    assert {r.doc_id: (r.doubled, bytes(r.reversed)) for r in got} == {d: (hashlib.md5(t + t).hexdigest(), t[::-1]) for d, t in want.items()}


def test_boundary_score_rounds_as_sql(spark, tmp_path):
    """Scores that end in a half at the ninth place, of 1e9 and more after silence, and beyond doubles; all digits count."""
    import duckdb

    steps = [(b + 5 * b * b, b) for b in (k / 10 for k in range(1, 121))] + [(0.0, k / 100) for k in range(2489, 6255, 37)] + [(0.0, 1e296), (0.0, 1e304), (1.0, None), (1.0, float("nan"))]
    signal = [v for a, b in steps for v in [a] * 16 + [b] * 16]
    spark.createDataFrame(list(enumerate(signal)), "event_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(catalog.ORACLE_SQL["boundary_score"]).fetchall()
    got = catalog.QUERIES["boundary_score"](spark, str(tmp_path)).collect()
    assert len(want) == len(steps)
    assert sorted((r.frame, repr(r.score)) for r in got) == sorted((f, repr(list(s))) for f, s in want)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["frame", "sub", "rms", "peak", "energy"] and df.count() == 125
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

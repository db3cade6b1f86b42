"""Compares a Spark query with its DuckDB SQL, rows in any order."""

import glob
import os

import duckdb


def _plain(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else float(f"{v:.9g}")
    if hasattr(v, "tolist"):
        v = v.tolist()
    return [_plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def compare(df, sql, sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    names = sorted(c[0] for c in found.description)
    want = [dict(zip([c[0] for c in found.description], row, strict=True)) for row in found.fetchall()]
    assert sorted(df.columns) == names
    rows = [sorted(repr([_plain(r[n]) for n in names]) for r in side) for side in ((r.asDict() for r in df.collect()), want)]
    assert rows[0] == rows[1]

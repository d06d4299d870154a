"""Compare a Spark result with the same query in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        if isinstance(v, float) and math.isnan(v):
            return "nan"
        return repr(float(v) + 0.0)
    return str(v)


def _rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in records)


def differences(df, con, sql: str, limit: int = 5) -> list[str]:
    """Human-readable differences; empty when the results are equal."""
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = _rows(names, cur.fetchall())
    out = []
    if sorted(df.columns) != sorted(names):
        out.append(f"columns {sorted(df.columns)} != {sorted(names)}")
    if len(got) != len(want):
        out.append(f"{len(got)} rows != {len(want)}")
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    out += [f"{g} != {w}" for g, w in bad[:limit]]
    if len(bad) > limit:
        out.append(f"... {len(bad)} rows differ")
    if not got:
        out.append("no rows")
    return out

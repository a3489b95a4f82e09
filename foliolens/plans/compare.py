"""Compare registered queries with their SQL in DuckDB (used by tests)."""

from __future__ import annotations

import math
import os
import pathlib

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
EXACT = bool(os.environ.get("COMPARE_EXACT"))  # compare doubles to the last bit


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for name in TABLES:
        path = pathlib.Path(sf_dir) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0 if EXACT else float(f"{value:.9g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_norm(v) for v in value)
    if isinstance(value, (str, int)):
        return value
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> tuple[bool, str]:
    """Equal as multisets of rows with columns sorted by name?"""
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = _rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if got == want:
        return True, f"{len(got)} rows"
    got_set, want_set = set(got), set(want)
    extra = [r for r in got if r not in want_set][:3]
    missing = [r for r in want if r not in got_set][:3]
    return False, f"rows {len(got)} vs {len(want)}; only spark {extra}; only sql {missing}"

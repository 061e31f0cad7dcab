"""Run registered queries and their SQL side by side."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def _plain(x):
    if isinstance(x, float):
        return "nan" if x != x else f"{x:.6g}" if abs(x) > 1e-9 else "0"
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
        return tuple(_plain(y) for y in x)
    if isinstance(x, dict):
        return tuple((k, _plain(v)) for k, v in sorted(x.items()))
    if type(x).__name__ == "Decimal":
        return _plain(float(x)) if x != int(x) else int(x)
    return x


def differences(df, con, sql: str) -> str:
    """Empty if both give the same columns and the same rows in any order."""
    cols = sorted(df.columns)
    got = Counter(tuple(_plain(v.asDict(True) if hasattr(v, "asDict") else v) for v in r) for r in df.select(*cols).collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = Counter(tuple(_plain(r[k]) for k in at) for r in cur.fetchall())
    if got == want:
        return ""
    return f"{sum(got.values())} rows against {sum(want.values())}; only here {list((got - want).items())[:2]}; only there {list((want - got).items())[:2]}"

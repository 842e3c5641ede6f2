"""Compares a query with its SQL in another engine: row count, column names, and values without regard to order."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings statements word_statements activations zero_shot_scores trial_log sample_targets split_plan source_weights reading_anchors".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain_value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (list, tuple)):
        return tuple(plain_value(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain_value(x)) for k, x in v.items()))
    return v


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """An empty string if df and the SQL's result agree; else what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    cols = sorted(df.columns)
    if cols != sorted(names):
        return f"columns {cols} against {sorted(names)}"
    mine = Counter(tuple(plain_value(r[c]) for c in cols) for r in (x.asDict(True) for x in df.collect()))
    order = [names.index(c) for c in cols]
    other = Counter(tuple(plain_value(r[i]) for i in order) for r in theirs)
    if mine == other:
        return ""
    return f"{sum(mine.values())} rows against {sum(other.values())}; only here {list((mine - other).items())[:4]}; only there {list((other - mine).items())[:4]}"

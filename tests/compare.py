"""Row-by-row comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, Decimal):
        raise TypeError("decimal in a result")
    return v


def difference(df, con, sql: str) -> str | None:
    """None when both results hold the same columns, types and rows; otherwise what differs."""
    names = sorted(df.columns)
    rows = [tuple(_cell(r[n]) for n in names) for r in df.collect()]
    cur = con.execute(sql)
    their = [c[0] for c in cur.description]
    if sorted(their) != names:
        return f"columns {names} vs {sorted(their)}"
    order = [their.index(n) for n in names]
    other = [tuple(_cell(r[i]) for i in order) for r in cur.fetchall()]
    if len(rows) != len(other):
        return f"{len(rows)} rows vs {len(other)}"
    if not rows:
        return "no rows"
    def kinds(rs):
        return [{type(r[i]) for r in rs} - {type(None)} for i in range(len(names))]
    if kinds(rows) != kinds(other):
        return f"types {list(zip(names, kinds(rows), kinds(other)))}"
    a, b = Counter(rows), Counter(other)
    if a != b:
        return f"only in spark {list((a - b))[:3]} only in duckdb {list((b - a))[:3]} of {names}"
    return None

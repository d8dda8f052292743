"""Compare a registered query with its SQL twin in DuckDB."""

from __future__ import annotations

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*' if os.path.isdir(p) else p}')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 5)
    return v if isinstance(v, str) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i].lower())
    return sorted(columns[i].lower() for i in order), sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


def difference(spark_df, con, sql: str) -> str:
    """Empty if both give the same rows."""
    c1, r1 = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    c2, r2 = rows([d[0] for d in cur.description], cur.fetchall())
    if c1 != c2:
        return f"columns {c1} and {c2}"
    if len(r1) != len(r2):
        return f"{len(r1)} and {len(r2)} rows; only in one: {[x for x in r1 if x not in set(r2)][:2]!r:.400} / {[x for x in r2 if x not in set(r1)][:2]!r:.400}"
    for a, b in zip(r1, r2, strict=True):
        if a != b and not all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 * max(1, abs(x))) for x, y in zip(a, b, strict=True)):
            return f"{a!r:.300}\n  and {b!r:.300}"
    return ""

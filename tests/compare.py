"""Runs queries beside their SQL: python tests/compare.py FOLDER [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).iterdir()):
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(names: list[str], found) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def differ(spark, con, folder: str, name: str, query, sql: str) -> str:
    """Empty, or what is different."""
    df = query(spark, folder)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = rows(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    kinds = {d[0]: str(d[1]).split("(")[0] for d in cursor.description}
    expected = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = {c: (t, kinds[c]) for c, t in df.dtypes if t in expected and kinds[c] != expected[t]}
    if odd:
        return f"types {odd}"
    if ours != theirs:
        only = [r for r in ours if r not in theirs][:3] if len(ours) < 5000 else [a for a, b in zip(ours, theirs) if a != b][:3]
        back = [r for r in theirs if r not in ours][:3] if len(ours) < 5000 else [b for a, b in zip(ours, theirs) if a != b][:3]
        return f"{len(ours)} and {len(theirs)} rows; only ours {only}; only theirs {back}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as e
    from sonoplan.session import build_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark, con, sql = build_session(), connect(folder), e.oracle_sql()
    for name, query in e.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        began = time.time()
        try:
            if name in sql:
                said = differ(spark, con, folder, name, query, sql[name]) or "same"
            else:
                df = query(spark, folder)
                found = df.collect()
                said = f"{len(found)} rows, no SQL: {df.dtypes} {[str(r)[:200] for r in found[:2]]}"
        except Exception as x:  # noqa: BLE001
            said = f"ERROR {str(x)[:700]}"
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)

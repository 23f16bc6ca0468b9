"""Compare a registered query with its SQL on the same parquet tables."""
from __future__ import annotations

import glob
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _family(kind: str) -> str:
    kind = kind.lower()
    for name, family in (("decimal", "decimal"), ("hugeint", "hugeint"), ("bigint", "long"), ("int", "int"),
                         ("double", "double"), ("float", "float"), ("string", "text"), ("varchar", "text"),
                         ("bool", "bool")):
        if kind.startswith(name):
            return family
    return {"integer": "int", "long": "long"}.get(kind, kind)


def _rows(rows):
    return sorted(tuple("<null>" if v is None else repr(v) for v in r) for r in rows)


def compare(spark, name: str, folder: str, queries, oracle, con=None) -> list[str]:
    """Differences in columns, types, row count or values; empty when equal."""
    con = con or connect(folder)
    df = queries[name](spark, folder)
    columns = sorted(df.columns)
    found = [tuple(r) for r in df.select(*columns).collect()]
    rel = con.sql(oracle[name])
    problems = []
    if sorted(rel.columns) != columns:
        return [f"columns {columns} != {sorted(rel.columns)}"]
    types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for field in df.schema:
        ours, theirs = _family(field.dataType.typeName()), _family(types[field.name])
        if ours != theirs:
            problems.append(f"type of {field.name}: {ours} != {theirs}")
    wanted = con.sql(f"SELECT {', '.join(columns)} FROM ({oracle[name]})").fetchall()
    if len(found) != len(wanted):
        problems.append(f"rows {len(found)} != {len(wanted)}")
    a, b = _rows(found), _rows(wanted)
    if a != b:
        extra, missing = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
        problems.append(f"values differ: only ours {str(extra)[:700]} only sql {str(missing)[:700]}")
    return problems

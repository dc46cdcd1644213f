"""Run registered queries next to their SQL: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and not hasattr(v, "dtype"):
            return tuple(cell(x) for x in v)
        if hasattr(v, "shape") and getattr(v, "shape", ()) != ():
            return tuple(cell(x) for x in v.tolist())
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return None
        if isinstance(v, float):
            return v + 0.0
        if hasattr(v, "item"):
            return v.item()
        return v

    cols = sorted(df.columns)
    return sorted((tuple(cell(v) for v in row) for row in df[cols].itertuples(index=False)), key=repr)


SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN",
        "float": "FLOAT", "timestamp_ntz": "TIMESTAMP", "array<string>": "VARCHAR[]", "array<double>": "DOUBLE[]"}


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> str:
    start = time.time()
    df = fn(spark, sf_dir)
    types = dict(df.dtypes)
    rows = [r.asDict() for r in df.collect()]
    took = time.time() - start
    got = normal(pd.DataFrame(rows, columns=df.columns, dtype=object))
    if sql is None:
        return f"rows   {name} {len(rows)} rows {took:.1f}s"
    rel = con.execute(sql)
    want_types = {d[0]: str(d[1]) for d in rel.description}
    want = normal(pd.DataFrame(rel.fetchall(), columns=list(want_types), dtype=object))
    if sorted(types) != sorted(want_types):
        return f"COLUMN {name} {sorted(types)} != {sorted(want_types)}"
    off = {c: (types[c], want_types[c]) for c in types if SAME.get(types[c], types[c]) != want_types[c]}
    if off:
        return f"TYPE   {name} {off}"
    if len(got) != len(want):
        return f"COUNT  {name} {len(got)} != {len(want)}"
    diff = [(g, w) for g, w in zip(got, want) if g != w]
    if diff:
        return f"VALUE  {name} {len(diff)} of {len(got)} rows, first {diff[0]}"
    return f"ok     {name} {len(rows)} rows {took:.1f}s"


def main() -> None:
    import __spark_entry__ as entry
    from riskframe.session import local_session
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("sf") else "sf0.01"
    names = [a for a in args if not a.startswith("sf")]
    sf_dir = f"/root/testdata/{sf}"
    spark, con = local_session(), connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        try:
            print(compare(spark, con, name, queries[name], sql.get(name), sf_dir), flush=True)
        except Exception as error:
            print(f"ERROR  {name} {type(error).__name__}: {str(error)[:1500]}", flush=True)


if __name__ == "__main__":
    main()

"""Runs registered queries next to their SQL and compares the rows.

    python tools/compare.py [sf] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from jobsieve.session import session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _kind(dtype: str) -> str:
    d = dtype.lower()
    if d in ("bigint", "long", "int64"):
        return "bigint"
    if d in ("int", "integer"):
        return "int"
    if d in ("string", "varchar"):
        return "string"
    return {"timestamp_ntz": "timestamp"}.get(d, d)


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None):
    start = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(([_plain(r[c]) for c in cols] for r in df.collect()), key=repr)
    took = time.time() - start
    if sql is None:
        return "rows-only", len(got), took, ""
    rel = con.sql(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return "COLUMNS", len(got), took, f"{cols} vs {sorted(names)}"
    types = {n: _kind(str(t)) for n, t in zip(names, rel.types)}
    mine = {f.name: _kind(f.dataType.simpleString()) for f in df.schema}
    odd = {c: (mine[c], types[c]) for c in cols if mine[c] != types[c]}
    at = [names.index(c) for c in cols]
    want = sorted(([_plain(r[i]) for i in at] for r in rel.fetchall()), key=repr)
    if got != want:
        gs, ws = {repr(x) for x in got}, {repr(x) for x in want}
        note = f"{len(got)} vs {len(want)}\n   spark only: {sorted(gs - ws)[:2]}\n   sql only:   {sorted(ws - gs)[:2]}"
        return "DIFFERENT", len(got), took, note
    return ("types" if odd else "ok"), len(got), took, str(odd or "")


def main(argv) -> int:
    from jobsieve.registry import load

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    queries, oracles = load()
    wanted = argv[1:] or list(queries)
    spark = session("compare", "local[8]", {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in wanted:
        try:
            status, rows, took, note = compare(spark, con, sf_dir, name, queries[name], oracles.get(name))
        except Exception as error:  # noqa: BLE001
            status, rows, took, note = "ERROR", 0, 0.0, str(error)[:1500]
        bad += status in ("ERROR", "DIFFERENT", "COLUMNS")
        print(f"{status:10} {name:28} rows={rows:<7} {took:6.2f}s {note}", flush=True)
    print("bad:", bad, "of", len(wanted))
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1:]), 100))

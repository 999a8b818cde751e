"""Run registered queries and their SQL side by side: python tools/check_oracles.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from panelweave.catalog import ORACLES, QUERIES
from panelweave.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(columns, rows):
    """Rows as sorted tuples of text, columns in name order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple("NULL" if r[i] is None else repr(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> str:
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        return f"rows only: {len(got)}"
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"COLUMNS differ: only ours {sorted(set(df.columns) - set(cols))}, only SQL {sorted(set(cols) - set(df.columns))}"
    kinds = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "DATE": "date", "BOOLEAN": "boolean"}
    ours = dict(df.dtypes)
    odd = [(d[0], str(d[1]), ours[d[0]]) for d in cur.description if kinds.get(str(d[1])) != ours[d[0]]]
    if odd:
        return f"TYPES differ: {odd}"
    a, b = canonical(df.columns, got), canonical(cols, want)
    if a == b:
        return f"ok {len(a)}"
    sa, sb = set(a), set(b)
    extra, missing = sorted(sa - sb)[:3], sorted(sb - sa)[:3]
    return f"DIFFERS: {len(a)} rows against {len(b)}, {sorted(cols)}\n   ours {extra}\n   sql  {missing}"


def main() -> int:
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = local_session("oracles"), connect(sf_dir)
    bad = 0
    for name in args or QUERIES:
        start = time.time()
        try:
            out = compare(spark, con, name, sf_dir)
        except Exception as e:  # report and go on to the next query
            out = f"FAILED {type(e).__name__}: {str(e)[:600]}"
        bad += not out.startswith(("ok", "rows only"))
        print(f"{name:28s} {time.time() - start:6.1f}s  {out}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())

"""Run registered queries and their SQL side by side: python -m tests.check SF_DIR [names ...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def compare(spark, sf_dir: str, query, sql: str) -> str:
    """Empty when both sides agree in names, rows and values."""
    df = query(spark, sf_dir)
    got_names, got = _sorted(df.columns, [tuple(r) for r in df.collect()])
    con = connect(sf_dir)
    rel = con.sql(sql)
    names, rows = _sorted(rel.columns, rel.fetchall())
    if got_names != names:
        return f"columns {got_names} != {names}"
    if len(got) != len(rows):
        return f"rows {len(got)} != {len(rows)}"
    for a, b in zip(got, rows):
        if a != b:
            return f"\n  spark  {a}\n  oracle {b}"
    return "" if got else "no rows"


def main(argv: list[str]) -> int:
    from lotweave.registry import ORACLES, QUERIES
    from lotweave.session import local_session

    spark = local_session()
    bad = 0
    for name in argv[1:] or QUERIES:
        t = time.time()
        try:
            if name in ORACLES:
                said = compare(spark, argv[0], QUERIES[name], ORACLES[name])
            else:
                said = "" if QUERIES[name](spark, argv[0]).count() else "no rows"
        except Exception as e:  # report and go on
            said = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(said)
        mark = "FAIL" if said else ("ok" if name in ORACLES else "rows")
        print(f"CHECK {mark:5} {name} {time.time() - t:.1f}s {said[:1500]}", flush=True)
    print(f"CHECK total bad {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

"""Compare registered queries with their SQL oracle in DuckDB.

    python -m tests.oracle [--sf DIR] [name-part ...]
"""

from __future__ import annotations

import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def _canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    out.sort(key=repr)
    return [columns[i] for i in order], out


def compare(df, con, text: str) -> list[str]:
    """Differences between a Spark result and an oracle query; empty = match."""
    got_cols, got = _canonical(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(text)
    names = [d[0] for d in res.description]
    want_cols, want = _canonical(names, res.fetchall())
    if got_cols != want_cols:
        return [f"columns {got_cols} vs {want_cols}"]
    bad = []
    if len(got) != len(want):
        bad.append(f"rows {len(got)} vs {len(want)}")
    diff = [(a, b) for a, b in zip(got, want) if repr(a) != repr(b)]
    if diff:
        bad.append(f"{len(diff)} rows differ, first {diff[0]}")
    return bad


def main(argv: list[str]) -> int:
    import os
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from rasterloom.session import get_session
    sf = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        del argv[i:i + 2]
    spark = get_session(master="local[8]", shuffle_partitions=8,
                        **{"spark.ui.enabled": "false", "spark.driver.memory": "8g",
                           "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracles = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if argv and not any(a in name for a in argv):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            if name in oracles:
                bad = compare(df, con, oracles[name])
            else:
                n = len(df.collect())
                bad = []
                name += f" (no oracle, {n} rows)"
        except Exception as exc:  # report and go on
            bad = [f"{type(exc).__name__}: {str(exc)[:700]}"]
        failed += bool(bad)
        print(f"{'FAIL' if bad else 'ok  '} {time.time() - start:6.2f}s {name} {'; '.join(bad)}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))

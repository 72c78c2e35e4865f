"""Runs registered queries next to their SQL and compares the whole results."""

from __future__ import annotations

import sys
import time
from decimal import Decimal
from pathlib import Path

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connection(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, Decimal):
        return v.normalize()
    return v


def normal(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def kinds(types: list[str]) -> list[str]:
    names = {"LONG": "BIGINT", "INT": "INTEGER", "STRING": "VARCHAR", "TIMESTAMP_NTZ": "TIMESTAMP"}
    return [names.get(t.upper(), t.upper()) for t in types]


def compare(df, con, sql: str) -> str:
    """'' when equal, else what differs."""
    types = dict(df.dtypes)
    got_cols, got = normal(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    sql_types = {d[0]: str(d[1]) for d in res.description}
    want_cols, want = normal(cols, res.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} / {want_cols}"
    a, b = kinds([types[c] for c in got_cols]), kinds([sql_types[c] for c in want_cols])
    if a != b:
        return f"types {list(zip(got_cols, a, b))}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, first: {bad[0]}" if bad else ""


def main(argv: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from __spark_entry__ import oracle_sql, queries
    from pairwright.session import build_session

    sf = argv[0]
    wanted = argv[1:]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(sf)
    sqls, failed = oracle_sql(), 0
    for name, fn in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.monotonic()
        try:
            df = fn(spark, sf)
            if name in sqls:
                said = compare(df, con, sqls[name])
            else:
                said = f"({df.count()} rows, no SQL)"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += bool(said) and not said.startswith("(")
        print(f"{name:34s} {time.monotonic() - start:6.2f}s  {said or 'equal'}", flush=True)
    print("failed:", failed)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

"""Rows of a query and of its SQL twin, ready to be compared."""

from __future__ import annotations

from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(folder: str = DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(rows) -> list[tuple]:
    digits = lambda x: float(f"{x:.9g}") if isinstance(x, float) else x
    return sorted((tuple(digits(x) for x in r) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


def of_spark(df) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    return columns, plain(tuple(r) for r in df.select(*columns).collect())


def of_duckdb(con, sql: str) -> tuple[list[str], list[tuple]]:
    found = con.sql(sql)
    columns = sorted(found.columns)
    return columns, plain(found.select(", ".join(f'"{c}"' for c in columns)).fetchall())

"""Runs a query and its SQL on the same tables and compares the rows, whatever their order."""

import math
from pathlib import Path

import duckdb


def rows(df) -> list:
    names = sorted(df.columns)
    return sorted([[_plain(r[n]) for n in names] for r in df.collect()], key=repr)


def sql_rows(sql: str, sf_dir: str) -> list:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([[_plain(r[i]) for i in order] for r in got.fetchall()], key=repr)


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    return x

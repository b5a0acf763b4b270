"""Spark rows against DuckDB rows: same names, same values, order aside."""

from __future__ import annotations

import math
import os

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([_plain(x) for x in v])
    return "\0" if v is None else str(v)


def rows_of(names, rows, wanted):
    at = [names.index(c) for c in wanted]
    return sorted(tuple(_plain(r[i]) for i in at) for r in rows)


def connection():
    import duckdb

    con = duckdb.connect()
    for name in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def compare(spark, con, query, sql):
    found = query(spark, SF)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(found.columns) == sorted(names)
    wanted = sorted(names)
    assert rows_of(found.columns, found.collect(), wanted) == rows_of(names, cur.fetchall(), wanted)

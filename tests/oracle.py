"""Runs a registered query and its SQL twin and compares them."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(table, names):
    def plain(v):
        if isinstance(v, float):
            return round(v, 6)
        if isinstance(v, (list, tuple)):
            return tuple(map(plain, v))
        return v

    return sorted((tuple(plain(r[n]) for n in names) for r in table), key=repr)


def compare(spark, query, sql: str, sf: str) -> tuple[int, str]:
    """(rows, what differs or '')."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = query(spark, sf)
    names = sorted(df.columns)
    want = con.execute(sql).to_arrow_table()
    if sorted(want.column_names) != names:
        return 0, f"columns {names} and {sorted(want.column_names)}"
    got = _rows((r.asDict() for r in df.collect()), names)
    want = _rows(want.to_pylist(), names)
    if got == want:
        return len(got), ""
    odd = [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3]
    return len(got), f"{len(got)} rows and {len(want)}; only one has: {odd}"

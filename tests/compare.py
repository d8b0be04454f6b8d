"""Whether a query's rows are those that its SQL gives in DuckDB."""

from __future__ import annotations

from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb


def plain(value):
    """A value in a form that both engines' results share."""
    if isinstance(value, (float, Decimal)):
        return round(float(value), 4)
    if hasattr(value, "isoformat"):
        return value.isoformat().removesuffix("T00:00:00")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def counted(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, sql: str, sf_dir: str) -> list:
    """Nothing if they agree; else the columns, or some rows of one side alone."""
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    if sorted(columns) != sorted(df.columns):
        return [sorted(columns), sorted(df.columns)]
    theirs, ours = counted(columns, found.fetchall()), counted(df.columns, df.collect())
    return [("sql", *list((theirs - ours).items())[:3]), ("spark", *list((ours - theirs).items())[:3])] if theirs != ours else []

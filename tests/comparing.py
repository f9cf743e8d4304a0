"""Rows of a Spark query beside those of its SQL."""

from __future__ import annotations


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, bytearray):
        return bytes(value)
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


def rows_of(df) -> list[tuple]:
    names = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


def rows_of_sql(duck, sql: str) -> tuple[list[str], list[tuple]]:
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)

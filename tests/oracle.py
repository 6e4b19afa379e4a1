"""Comparing a query's rows with its SQL twin's, whatever their order."""

from __future__ import annotations

import decimal


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else v + 0.0
    if isinstance(v, dict):
        return tuple(sorted((plain(a), plain(b)) for a, b in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, bytearray):
        return bytes(v)
    if isinstance(v, decimal.Decimal):
        return str(v.normalize())
    return v


def same(df, cursor) -> None:
    columns = sorted(df.columns)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    want = sorted(repr([plain(r[i]) for i in place]) for r in cursor.fetchall())
    assert len(got) == len(want)
    assert got == want

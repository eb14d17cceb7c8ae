"""Rows of two engines, brought to one form."""

import math


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str), sorted(columns)


def assert_same(df, duck, sql):
    found = table([tuple(r) for r in df.collect()], df.columns)
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    expected = table(result.fetchall(), names)
    assert found[1] == expected[1]
    assert [tuple(map(str, r)) for r in found[0]] == [tuple(map(str, r)) for r in expected[0]]

"""Compares results without regard to row order and numeric type."""


def plain(v):
    if v is None or str(v) in ("nan", "NaT", "<NA>"):
        return "null"
    if type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    try:
        f = float(v)
    except (TypeError, ValueError):
        return str(v)
    return str(int(f)) if f.is_integer() and abs(f) < 2**53 else f"{f:.9g}"


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    x = sorted(tuple(map(plain, r)) for r in a[cols].itertuples(index=False))
    y = sorted(tuple(map(plain, r)) for r in b[cols].itertuples(index=False))
    assert x == y

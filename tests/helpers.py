"""Helpers of the tests."""


def values(df, *columns):
    return sorted(tuple(r[c] for c in (columns or df.columns)) for r in df.collect())

"""Rows of a frame in a fixed order, for comparisons in tests."""


def rows(df, *order):
    """Rows as plain tuples, sorted."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(str(v) for v in r))

"""Comparison of results as unordered rows."""

from __future__ import annotations

import math


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null" if value is None else "nan"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return repr(round(float(value), 9) + 0.0)
    return str(value)


def rows(names, tuples):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(t[i]) for i in order) for t in tuples)


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def column(df, name, key=None):
    """Values of a column, in the order of ``key``."""
    ordered = df.orderBy(key) if key else df
    return [r[name] for r in ordered.collect()]

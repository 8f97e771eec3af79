"""First / last row per key without packing rows into a struct.

One ``min_by`` / ``max_by`` per carried column instead of one over
``struct(*)``: Catalyst then drops the aggregates nobody reads (a count-only
query ships no text through the exchange), and key-only reductions stay in
hash aggregation. The order key must be unique within a key so every column
comes from the same row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _order(order):
    return F.col(order) if isinstance(order, str) else order


def first_by(df: DataFrame, keys, order, cols=None) -> DataFrame:
    """Row with the smallest ``order`` per ``keys`` (columns ``cols``, default all)."""
    keys = list(keys)
    o = _order(order)
    cols = [c for c in (cols if cols is not None else df.columns) if c not in keys]
    return df.groupBy(*keys).agg(*[F.min_by(F.col(c), o).alias(c) for c in cols]) \
             .select(*keys, *cols) if cols else df.select(*keys).distinct()


def last_by(df: DataFrame, keys, order, cols=None) -> DataFrame:
    """Row with the largest ``order`` per ``keys``."""
    keys = list(keys)
    o = _order(order)
    cols = [c for c in (cols if cols is not None else df.columns) if c not in keys]
    return df.groupBy(*keys).agg(*[F.max_by(F.col(c), o).alias(c) for c in cols]) \
             .select(*keys, *cols) if cols else df.select(*keys).distinct()

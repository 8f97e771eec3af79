"""Label expressions: lenient cast (P2), class collapse (P3), inversion (P4),
label canonicalisation (P6), class-id mapping (M2) and arg-max (O8)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import schemas as S
from .text import trim_js

# A decimal number the way pandas' numeric parser accepts it (no Java-style
# 'd'/'f' suffixes, no hex); surrounding blanks allowed.
_NUMERIC = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def lenient_label(col) -> Column:
    """``to_numeric(errors='coerce').fillna(0).astype(int)``.

    Unparseable or missing → 0 (which means *abusive*); fractions truncate
    toward zero; values that do not fit an int → 0. ANSI mode is on, so only
    ``try_cast`` is used.
    """
    s = F.trim(_c(col).cast("string"))
    as_double = F.when(s.rlike(_NUMERIC), s.try_cast("double"))
    truncated = F.when(~F.isnan(as_double), as_double).try_cast("int")
    return F.coalesce(truncated, F.lit(0))


def collapse_classes(col) -> Column:
    """Three-class label: classes 0 and 1 → 0 (abusive), anything else → 1."""
    return F.when(_c(col).isin(0, 1), F.lit(0)).otherwise(F.lit(1))


def invert_label(col) -> Column:
    """0 → 1, everything else (including null) → 0."""
    return F.when(_c(col) == 0, F.lit(1)).otherwise(F.lit(0))


def canonical_label(col) -> Column:
    """``label.toLowerCase().trim()``."""
    return trim_js(F.lower(_c(col)))


def is_abusive_label(col, abusive=S.ABUSIVE_LABELS, safe=S.SAFE_LABELS) -> Column:
    """Exact set membership after canonicalisation, never substring match."""
    c = canonical_label(col)
    return F.coalesce(c.isin(*abusive) & ~c.isin(*safe), F.lit(False))


def id2label(col, mapping=None) -> Column:
    m = mapping or S.ID2LABEL
    return F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), _c(col))


def label2id(col, mapping=None) -> Column:
    m = mapping or S.LABEL2ID
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), _c(col))


def argmax(col) -> Column:
    """Index of the largest logit; ties → lowest index; NaN counts as largest."""
    a = _c(col)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")

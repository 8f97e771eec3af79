"""Column expressions over message text (P5, P10, P13 percent, P16).

All JVM-side built-ins: they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import schemas as S


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def trim_js(col) -> Column:
    """JavaScript ``String.prototype.trim``: strip the JS whitespace set at both ends.

    Spark's ``trim`` removes only U+0020; ``btrim`` with a character set is a
    linear scan from each end, no regex.
    """
    return F.btrim(_c(col), F.lit(S.JS_WHITESPACE))


def utf16_len(col) -> Column:
    """Length in UTF-16 code units (what JS ``.length`` reports).

    ``length`` counts code points; a supplementary-plane character is two
    units. For filters prefer :func:`utf16_at_least`, which skips the encode
    for long strings.
    """
    c = _c(col)
    return F.shiftright(F.octet_length(F.encode(c, "UTF-16BE")), 1).cast("long")


def utf16_at_least(col, n: int) -> Column:
    """``utf16_len(col) >= n`` without encoding long strings.

    UTF-16 length >= code-point length, so ``length >= n`` already decides for
    every string of n or more code points.
    """
    c = _c(col)
    return (F.char_length(c) >= n) | (
        (F.char_length(c) * 2 >= n) & (F.octet_length(F.encode(c, "UTF-16BE")) >= 2 * n))


def evidence_id(col) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 text (the evidence record id)."""
    return F.sha2(_c(col), 256)


def percent1(col) -> Column:
    """score x 100 rounded half-up to one decimal, as a number."""
    return F.floor(_c(col) * F.lit(1000.0) + F.lit(0.5)) / F.lit(10.0)


def percent0(col) -> Column:
    """score x 100 rounded half-up to an integer."""
    return F.floor(_c(col) * F.lit(100.0) + F.lit(0.5)).cast("long")


def fix_length(tokens, n: int = S.TOKEN_LENGTH, pad: str = S.PAD_TOKEN):
    """Truncate / pad a token array to exactly ``n`` and build the attention mask.

    Returns ``(tokens_n, mask_n)`` column expressions: the first ``n`` tokens,
    right-padded with ``pad``; mask 1 for real tokens, 0 for padding. No
    lambda refers back to the input, so the token array is evaluated once per
    row (pass a column, not a tokenising expression, to share it).
    """
    t = _c(tokens)
    head = F.slice(t, 1, n)
    n_real = F.least(F.size(t), F.lit(n))
    n_pad = F.lit(n) - n_real
    padded = F.concat(head, F.array_repeat(F.lit(pad), n_pad))
    mask = F.concat(F.array_repeat(F.lit(1), n_real), F.array_repeat(F.lit(0), n_pad))
    return padded, mask


def with_fixed_tokens(df, text: str = "text", n: int = S.TOKEN_LENGTH, pad: str = S.PAD_TOKEN,
                      tokens: str = "tokens", mask: str = "attention_mask"):
    """Tokenise once into a column, then truncate / pad it (P16 on a frame)."""
    df = df.withColumn("_all_tokens", whitespace_tokens(text))
    padded, m = fix_length("_all_tokens", n, pad)
    return df.withColumns({tokens: padded, mask: m}).drop("_all_tokens")


def whitespace_tokens(col) -> Column:
    """Lower-case whitespace tokenisation of JS-trimmed text (empty text → [])."""
    t = F.lower(trim_js(col))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[ \t\n\r]+"))

"""Attachment data-URL decode (P14), column encryption (P15) and report id (K4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .timeutil import to_millis


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def decode_attachment(col) -> Column:
    """``data:<mime>;base64,<payload>`` → struct(mime, bytes, n_bytes)."""
    c = _c(col)
    payload = F.unbase64(F.substring_index(c, ",", -1))
    return F.struct(F.regexp_extract(c, r"^data:(.*?);", 1).alias("mime"),
                    payload.alias("bytes"), F.octet_length(payload).alias("n_bytes"))


def aes_key(spark, key: str | bytes | None = None, conf: str = "msgshield.evidence.key"):
    """Resolve the column-encryption key: argument, else the session conf.

    No default key exists; without one this raises. The key must be 16, 24
    or 32 bytes. It enters plans as data (see :func:`encrypt_columns`), never
    as a literal.
    """
    k = key if key is not None else spark.conf.get(conf, None)
    if k is None:
        raise ValueError(f"no encryption key: pass one or set {conf}")
    kb = k.encode("utf-8") if isinstance(k, str) else k
    if len(kb) not in (16, 24, 32):
        raise ValueError("AES key must be 16, 24 or 32 bytes")
    return kb


def _key_column(spark, key: bytes) -> Column:
    """The key as a scalar subquery over a one-row table: it is evaluated once
    and shipped with the tasks, while ``explain`` and the query log show only
    ``Subquery`` (a literal would print the key bytes). No join is added."""
    return spark.createDataFrame([(bytearray(key),)], "_key binary").select("_key").scalar()


def encrypt_columns(df: DataFrame, cols, key: bytes, enabled: bool = True) -> DataFrame:
    """AES-GCM encrypt string columns to base64 text (P15). Disabled → unchanged."""
    if not enabled:
        return df
    k = _key_column(df.sparkSession, key)
    return df.withColumns({c: F.base64(F.aes_encrypt(F.encode(F.col(c), "UTF-8"), k, F.lit("GCM")))
                           for c in cols})


def decrypt_columns(df: DataFrame, cols, key: bytes, enabled: bool = True) -> DataFrame:
    """Inverse of :func:`encrypt_columns`; exact round trip."""
    if not enabled:
        return df
    k = _key_column(df.sparkSession, key)
    return df.withColumns({c: F.decode(F.aes_decrypt(F.unbase64(F.col(c)), k, F.lit("GCM")), "UTF-8")
                           for c in cols})


def report_id(now, salt_col) -> Column:
    """``SR-<base36 millis>-<5 base-36 digits>`` upper-cased; the tail comes from the
    crc32 of ``salt_col`` so a report id repeats for the same inputs."""
    ms = to_millis(now)
    tail = F.conv(F.crc32(_c(salt_col).cast("string").cast("binary")).cast("string"), 10, 36)
    return F.upper(F.concat(F.lit("SR-"), F.conv(F.lit(str(ms)), 10, 36), F.lit("-"),
                            F.lpad(F.right(tail, F.lit(5)), 5, "0")))

"""Severity counts (A1), store statistics (A2) and the quota check (A3).

All single-pass global aggregates: each task pre-aggregates its partition, one
row per task crosses the exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas as S
from ..functions.text import utf16_len
from .evidence import store_order


def normalized_severity(col="severity") -> Column:
    """null, '' and anything outside the known levels count as UNKNOWN."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isin(*S.SEVERITIES), c).otherwise(F.lit("UNKNOWN"))


def _severity_aggs(col="severity"):
    sev = normalized_severity(col)
    return [F.count_if(sev == F.lit(s)).alias(s.lower()) for s in S.SEVERITIES]


def severity_counts(df: DataFrame, col: str = "severity") -> DataFrame:
    """One row: ``high, medium, low, unknown, total``, zero-filled."""
    return df.agg(*_severity_aggs(col), F.count(F.lit(1)).alias("total"))


def severity_counts_long(df: DataFrame, col: str = "severity") -> DataFrame:
    """Long form ``(severity, n)`` with all four levels present.

    The four-level dimension is a fixed four-row table, so broadcasting it is
    bounded; counting happens before the join.
    """
    spark = df.sparkSession
    dim = spark.createDataFrame([(s, i) for i, s in enumerate(S.SEVERITIES)],
                                "severity string, level int")
    counts = df.groupBy(normalized_severity(col).alias("severity")).agg(
        F.count(F.lit(1)).alias("n"))
    return (F.broadcast(dim).join(counts, "severity", "left")
            .select("severity", "level", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def record_json(df: DataFrame, fields=None) -> Column:
    """JSON text of each record with the reference's field names and nulls kept.

    ``fields``: list of (column, json_name); default all evidence fields present.
    """
    fields = fields or [(c, j) for c, j in S.EVIDENCE_JSON_FIELDS if c in df.columns]
    return F.to_json(F.struct(*[F.col(c).alias(j) for c, j in fields]),
                     {"ignoreNullFields": "false",
                      "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"})


def store_stats(df: DataFrame, fields=None, max_bytes: int = S.MAX_STORE_BYTES) -> DataFrame:
    """One row of store statistics.

    ``size`` is the length in UTF-16 units of the JSON array of all records
    (``[`` + records joined by ``,`` + ``]``; ``[]`` = 2 when empty);
    ``size_mb`` (2 dp), ``max_mb``, ``usage_pct`` (1 dp) rounded half-up;
    severity counts; ``oldest`` / ``newest`` are the timestamps of the first
    and last record *in insertion order*, not min / max.
    """
    order = store_order(df)
    agg = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(utf16_len(record_json(df, fields))).alias("_chars"),
        *_severity_aggs("severity"),
        F.min_by("timestamp", order).alias("oldest"),
        F.max_by("timestamp", order).alias("newest"),
    )
    size = F.when(F.col("total") == 0, F.lit(2)).otherwise(
        F.col("_chars") + F.col("total") + F.lit(1)).cast("long")
    mb = F.lit(1024.0 * 1024.0)
    return agg.select(
        "total",
        size.alias("size"),
        (F.floor(size / mb * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)).alias("size_mb"),
        F.lit(int(round(max_bytes / (1024 * 1024)))).cast("long").alias("max_mb"),
        (F.floor(size / F.lit(float(max_bytes)) * F.lit(1000.0) + F.lit(0.5)) / F.lit(10.0))
        .alias("usage_pct"),
        *[s.lower() for s in S.SEVERITIES],
        "oldest", "newest",
    )


def quota_check(df: DataFrame, fields=None, max_bytes: int = S.MAX_STORE_BYTES) -> DataFrame:
    """``size`` against the limit; over the limit is a warning, writes go on."""
    st = store_stats(df, fields, max_bytes)
    return st.select("total", "size", F.lit(max_bytes).cast("long").alias("max_bytes"),
                     (F.col("size") > F.lit(max_bytes)).alias("over_quota"))


def observe_quota(df: DataFrame, name: str | None = None, fields=None):
    """Attach the size metric to a write: ``(observed_df, observation)``.

    The size is collected as the write runs (no second pass); read
    ``observation.get`` after the action.
    """
    from pyspark.sql import Observation

    obs = Observation(name) if name else Observation()
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"),
                          F.sum(utf16_len(record_json(df, fields))).alias("chars"))
    return observed, obs

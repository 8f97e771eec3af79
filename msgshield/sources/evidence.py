"""Evidence scan (S8): a missing store reads as empty, any other error is raised.

Deletes lie beside the store as tombstones, ``(id, deleted_at)``, until they are folded into it
(``sinks.upkeep``); a reader leaves out the records of an id that were saved up to its deletion.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from .. import schemas as S

STORED = T.StructType(S.EVIDENCE.fields + [T.StructField("saved_date", T.DateType()),
                                           T.StructField("batch_id", T.LongType())])


def read_or_empty(spark: SparkSession, schema: T.StructType, *paths: str, **options) -> DataFrame:
    """Parquet under ``paths``; no such path → empty. A layout, permission or
    schema error is an error: it must not look like an empty table."""
    try:
        return spark.read.schema(schema).options(**options).parquet(*paths)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


GONE = T.StructType([T.StructField("id", T.StringType()), T.StructField("deleted_at", T.TimestampType())])


def gone_path(path: str) -> str:
    return f"{path.rstrip('/')}__gone"


def tombstones(spark: SparkSession, path: str) -> DataFrame:
    """``(id, deleted_at)``: the last deletion of every id not yet folded."""
    gone = read_or_empty(spark, GONE, gone_path(path))
    return gone.groupBy(F.col("id").alias("_gone")).agg(F.max("deleted_at").alias("_deleted_at"))


def is_gone(records: DataFrame, gone: DataFrame):
    """Join condition of a record and the tombstone that covers it."""
    at = records["saved_at"]
    return (records["id"] == gone["_gone"]) & (at.isNull() | (at <= gone["_deleted_at"]))


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Read the store, written by batch appends and by the live job alike, with its
    fixed schema and without deleted records; an absent store is empty."""
    stored = read_or_empty(spark, STORED, path)
    gone = tombstones(spark, path)
    return stored.join(gone, is_gone(stored, gone), "left_anti")

"""Insertion sequence across batches (P11, O2): every record of a store gets a number of its own.

A batch takes as many numbers as it has records, from where the last writer of the store stopped:
one small file (the head) holds the next free number, one small file per batch what the batch took.
Batches of the live job and of appends share both, so nothing is listed and nothing is summed up
again. Inside a batch the positions come from ``index.positions``, which sorts keys only.

A replayed batch finds its own entry and repeats its numbers. The head moves before the entry is
written: a crash between them leaves a gap, never a number used twice. A head lost in the
middle of its own replacement is found again from the entries. A store has one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..sources.evidence import read_or_empty
from .index import attach, positions

LEDGER = T.StructType([T.StructField("first", T.LongType()), T.StructField("next", T.LongType())])


def _entry(ledger: str, batch_id: int) -> str:
    return f"{ledger.rstrip('/')}/taken/batch_id={int(batch_id)}"


def _note(spark: SparkSession, path: str, first: int, after: int) -> None:
    spark.createDataFrame([(first, after)], LEDGER).coalesce(1).write.mode("overwrite").parquet(path)


def allocate(spark: SparkSession, ledger: str, batch_id: int, n: int) -> int:
    """The first of ``n`` numbers for ``batch_id``."""
    own = read_or_empty(spark, LEDGER, _entry(ledger, batch_id)).first()
    if own is not None and own["first"] + n <= own["next"]:
        return own["first"]
    head = f"{ledger.rstrip('/')}/head"
    last = read_or_empty(spark, LEDGER, head).first()
    free = last["next"] if last is not None else (
        read_or_empty(spark, LEDGER, f"{ledger.rstrip('/')}/taken").agg(F.max("next")).first()[0] or 0)
    _note(spark, head, free, free + n)
    _note(spark, _entry(ledger, batch_id), free, free + n)
    return free


def numbered(df: DataFrame, order, keys, first: int = 0, seq: str = "seq") -> DataFrame:
    """``df`` with ``seq`` from ``first`` on, in ``order`` and then by ``keys``; ``keys`` name a record.
    Records that share all keys still get a number each."""
    keys = list(keys)
    at = positions(df, [*order, *[F.col(k) for k in keys]], keep=keys, index_col=seq)
    rest = df.drop(seq) if seq in df.columns and seq not in keys else df
    return attach(rest, at, keys, [seq]).withColumn(seq, F.col(seq) + F.lit(int(first)))

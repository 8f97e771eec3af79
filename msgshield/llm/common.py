"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir, scratch_path

# A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; also sets what every operator relies on."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder, and Arrow batches bounded in rows and bytes: texts differ a
    thousandfold in length, so a row count alone does not bound a batch."""
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 * 1024 * 1024))


# Shuffle files go when the query that made them ends, not when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaning_up(spark: SparkSession):
    """For queries whose plans nothing runs again."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared checkpoint folder and read back."""
    return written_in_turn([df], name)


def written_in_turn(parts: list[DataFrame], name: str) -> DataFrame:
    """Tables of one schema, written one after the other and read back as one: what one shuffles is gone before
    the next begins."""
    spark, paths = parts[0].sparkSession, []
    for df in parts:
        paths.append(scratch_path(spark, name))
        with cleaning_up(spark):
            df.write.parquet(paths[-1])
    return spark.read.schema(parts[0].schema).parquet(*paths)


def words_of(text: Column) -> Column:
    """Words of a text in order, as an array (null: empty)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != F.lit(""))

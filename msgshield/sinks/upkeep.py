"""Deletes and lookups on the evidence store itself.

A delete writes a tombstone per id, in a folder of its own request, and reads nothing: readers leave out what
it covers (``sources.evidence.read_evidence``). A replayed request replaces its own folder. Records saved after
the deletion stay.

``fold_deletes`` later rewrites only the batch folders that hold deleted records: what they keep is staged beside
the store, a list of the folders is written last, then the folders are replaced and the tombstones dropped. A fold
cut short after its list is finished by the next one, from the staged rows; one cut short before has changed
nothing. A store has one writer at a time, which finishes a fold before it goes on writing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from ..functions.text import utf16_len
from ..functions.timeutil import ts_lit
from ..operators.evidence import store_order
from ..operators.firsts import first_by
from ..operators.stats import record_json
from ..sources.evidence import GONE, STORED, gone_path, is_gone, read_evidence, read_or_empty, tombstones
from .export import SIZES, _size_path, store_writer

MAX_POINT_IDS = 10     # the most values of a list that reach Parquet's Bloom filters one by one
FOLDERS = T.StructType([T.StructField("saved_date", T.DateType()), T.StructField("batch_id", T.LongType()),
                        T.StructField("left", T.BooleanType())])
_NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def _fold_path(path: str, what: str) -> str:
    return f"{path.rstrip('/')}__fold/{what}"


def _replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def delete_stored(spark: SparkSession, path: str, ids: DataFrame, now, request: str, id_col: str = "id") -> None:
    """Delete all records of the listed ids saved up to ``now`` (J5). Absent ids and null ids are no error;
    ``request`` names the deletion, so that repeating it changes nothing."""
    if not request or "/" in request:
        raise ValueError("request must be a plain name")
    rows = ids.select(F.col(id_col).cast("string").alias("id")).where("id is not null").distinct()
    _replace(rows.withColumn("deleted_at", ts_lit(now)), f"{gone_path(path)}/request={request}")


def _remove_folder(spark: SparkSession, folder: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _finish(spark: SparkSession, path: str) -> None:
    """Put staged folders in place, if a list of them lies there."""
    folders = read_or_empty(spark, FOLDERS, _fold_path(path, "folders"))
    if folders.isEmpty():
        return
    staged = read_or_empty(spark, STORED, _fold_path(path, "rows"))
    store_writer(staged).mode("overwrite").parquet(path)
    for r in folders.where(~F.col("left")).toLocalIterator():     # names of folders only
        batch = _NULL_FOLDER if r["batch_id"] is None else r["batch_id"]
        _remove_folder(spark, f"{path.rstrip('/')}/saved_date={r['saved_date'] or _NULL_FOLDER}/batch_id={batch}")
    sizes = read_or_empty(spark, SIZES, _fold_path(path, "size")).first()
    if sizes is not None:
        _replace(spark.createDataFrame([tuple(sizes)], SIZES).coalesce(1), _size_path(path))
    _replace(spark.createDataFrame([], GONE), gone_path(path))
    _replace(spark.createDataFrame([], FOLDERS), _fold_path(path, "folders"))


def _folder_key(df: DataFrame):
    return [F.coalesce(F.datediff("saved_date", F.lit("1970-01-01").cast("date")), F.lit(-(1 << 30))).alias("_d"),
            F.coalesce(df["batch_id"], F.lit(-(1 << 63) + 1)).alias("_b")]


def fold_deletes(spark: SparkSession, path: str) -> dict:
    """Rewrite the folders that hold deleted records and drop the tombstones: ``{folders, removed}``. Other
    folders are not touched. The store's booked size shrinks by what went."""
    _finish(spark, path)
    gone = tombstones(spark, path)
    if gone.isEmpty():
        return {"folders": 0, "removed": 0}
    stored = read_or_empty(spark, STORED, path)
    hit = stored.join(gone, is_gone(stored, gone), "left_semi")
    counted = hit.groupBy("saved_date", "batch_id").agg(F.count(F.lit(1)).alias("rows"),
                                                        F.sum(utf16_len(record_json(hit))).alias("chars"))
    _replace(counted, _fold_path(path, "counted"))
    counted = spark.read.parquet(_fold_path(path, "counted"))
    dates = [r[0] for r in counted.select("saved_date").distinct().collect()]        # one value per day
    if not dates:
        _replace(spark.createDataFrame([], GONE), gone_path(path))
        return {"folders": 0, "removed": 0}
    of_days = F.col("saved_date").isin([d for d in dates if d is not None])
    touched = stored.where(of_days | F.col("saved_date").isNull() if None in dates else of_days)
    names = counted.select(*_folder_key(counted))
    here = touched.select("*", *_folder_key(touched)).join(names, ["_d", "_b"], "left_semi").drop("_d", "_b")
    kept = here.join(gone, is_gone(here, gone), "left_anti")
    staged = _fold_path(path, "rows")
    store_writer(kept).mode("overwrite").option("partitionOverwriteMode", "static").parquet(staged)
    left = read_or_empty(spark, STORED, staged)
    left = left.select(*_folder_key(left)).distinct().withColumn("left", F.lit(True))
    folders = (counted.select("*", *_folder_key(counted)).join(left, ["_d", "_b"], "left")
                      .select("saved_date", "batch_id", F.coalesce("left", F.lit(False)).alias("left")))
    last = read_or_empty(spark, SIZES, _size_path(path)).first()
    of_last = F.col("batch_id").eqNullSafe(F.lit(None if last is None else last["batch_id"]).cast("long"))
    n, rows, chars, own_rows, own_chars = counted.agg(
        F.count(F.lit(1)), F.sum("rows"), F.sum("chars"), F.sum(F.when(of_last, F.col("rows")).otherwise(0)),
        F.sum(F.when(of_last, F.col("chars")).otherwise(0))).first()
    sizes = [] if last is None else [(last["rows"] - rows, last["chars"] - chars, last["batch_id"],
                                      last["before_rows"] - (rows - own_rows), last["before_chars"] - (chars - own_chars))]
    _replace(spark.createDataFrame(sizes, SIZES), _fold_path(path, "size"))
    _replace(folders, _fold_path(path, "folders"))
    _finish(spark, path)
    return {"folders": n, "removed": rows}


def find_stored(spark: SparkSession, path: str, ids: list[str]) -> DataFrame:
    """First record (insertion order) of each of a few ids, read from the store itself (J4): the ids reach the
    files' Bloom filters, so row groups without them are not read. Absent ids give no row. For many ids use
    ``operators.evidence.lookup`` on ``read_evidence``."""
    ids = sorted({i for i in ids if i is not None})
    if len(ids) > MAX_POINT_IDS:
        raise ValueError(f"more than {MAX_POINT_IDS} ids: use operators.evidence.lookup")
    hits = read_evidence(spark, path).where(F.col("id").isin(ids))
    return first_by(hits, ["id"], store_order(hits))

"""Exports and the evidence store.

Everything is written by executors in parallel; the driver only builds paths.
"""

from __future__ import annotations

import datetime as _dt
import logging
import uuid

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.timeutil import iso_utc, to_millis, ts_lit
from ..functions.text import utf16_len
from ..operators.stats import record_json
from ..sources.evidence import GONE, gone_path, read_or_empty

log = logging.getLogger(__name__)


def dated(name: str, now) -> str:
    """``<name>_<yyyy-MM-dd>`` of ``now`` in UTC (K6)."""
    d = _dt.datetime.fromtimestamp(to_millis(now) / 1000, tz=_dt.timezone.utc)
    return f"{name}_{d:%Y-%m-%d}"


def export_json(df: DataFrame, root: str, now, name: str = "evidence_export") -> str:
    """JSON export (K1), scale form: a JSON-lines folder of records plus a
    one-row manifest ``{exportDate, version, totalIncidents}``. The total is
    an aggregate computed on the executors. Returns the export folder."""
    out = f"{root}/{dated(name, now)}"
    df.select(record_json(df).alias("value")).write.mode("overwrite").text(f"{out}/evidence")
    manifest = df.agg(F.count(F.lit(1)).alias("totalIncidents")).select(
        iso_utc(ts_lit(now)).alias("exportDate"), F.lit(S.EVIDENCE_VERSION).alias("version"),
        "totalIncidents")
    manifest.coalesce(1).write.mode("overwrite").json(f"{out}/manifest")
    return out


def export_json_document(df: DataFrame, root: str, now, name: str = "evidence_export") -> str:
    """The reference's single JSON document ``{exportDate, version,
    totalIncidents, evidence: [...]}``, written without passing the store
    through one task.

    Every record becomes one line (with a leading comma except the first),
    framed by a header line and a closing line, and the lines are range-sorted
    once by insertion order. The part files, concatenated in name order, are one valid JSON
    document (newlines between elements are JSON whitespace). Returns the
    folder.
    """
    out = f"{root}/{dated(name, now)}.json.d"
    spark = df.sparkSession
    place = F.struct(F.col("revision").cast("long").alias("revision"), F.col("seq").cast("long").alias("seq"))
    lines = df.select(place.alias("place"), record_json(df).alias("value"))
    # Records tied on the first place are told apart by their hash, equal ones by counting them.
    info = lines.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("place", F.xxhash64("value").alias("h"))).alias("first")).first()
    first = F.lit(False) if info["first"] is None else (
        F.col("place.revision").eqNullSafe(F.lit(info["first"]["place"]["revision"]))
        & F.col("place.seq").eqNullSafe(F.lit(info["first"]["place"]["seq"])) & (F.xxhash64("value") == F.lit(info["first"]["h"])))
    others = lines.where(~first).select(F.lit(2).alias("_part"), "place.*", F.concat(F.lit(","), "value").alias("value"))
    equal = (lines.where(first).groupBy("place", "value").agg(F.count(F.lit(1)).alias("m"))
                  .select("place", "value", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("i"))
                  .select(F.lit(1).alias("_part"), "place.*", F.concat(F.when(F.col("i") == 1, F.lit("")).otherwise(F.lit(",")), "value").alias("value")))
    body = equal.unionByName(others)
    ts = _dt.datetime.fromtimestamp(to_millis(now) / 1000, tz=_dt.timezone.utc)
    head = ('{"exportDate":"' + ts.strftime("%Y-%m-%dT%H:%M:%S.") + f"{ts.microsecond // 1000:03d}Z"
            + f'","version":"{S.EVIDENCE_VERSION}","totalIncidents":{info["n"]},"evidence":[')
    frame = spark.createDataFrame([(0, 0, 0, head), (3, 0, 0, "]}")],
                                  "_part int, revision long, seq long, value string")
    # Text sorts last: of the records of the first place the one without a comma comes first.
    (body.unionByName(frame).orderBy("_part", F.col("value").startswith(","), "revision", "seq").select("value")
         .write.mode("overwrite").text(out))
    return out


def _js_number(c):
    """Number → text the way JavaScript prints it for ordinary values."""
    return F.when(c.isNull(), F.lit(None).cast("string")).when(
        (c == F.floor(c)) & (F.abs(c) < F.lit(1e15)), F.floor(c).cast("long").cast("string")
    ).otherwise(c.cast("string"))


def csv_rows(df: DataFrame) -> DataFrame:
    cats = F.concat_ws("; ", F.transform(F.coalesce("categories", F.array().cast(S.CATEGORIES)),
                                         lambda c: c["category"]))
    return df.select(F.col("id").alias("ID"), iso_utc("timestamp").alias("Timestamp"),
                     F.col("severity").alias("Severity"), _js_number(F.col("max_score")).alias("Max Score"),
                     cats.alias("Categories"), F.col("source").alias("Source"), F.col("text").alias("Text"))


def export_csv(df: DataFrame, path: str) -> str | None:
    """CSV export (K2). Empty input writes nothing and returns the message
    'No evidence to export'; otherwise returns ``None`` after writing. Every
    field is quoted where needed (the reference quoted only Text)."""
    if df.limit(1).count() == 0:
        return S.EXPORT_EMPTY_MESSAGE
    (csv_rows(df).write.mode("overwrite").option("header", "true").option("quote", '"')
        .option("escape", '"').option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false").csv(path))
    return None


SIZES = T.StructType([T.StructField("rows", T.LongType()), T.StructField("chars", T.LongType()),
                      T.StructField("batch_id", T.LongType()), T.StructField("before_rows", T.LongType()),
                      T.StructField("before_chars", T.LongType())])


def _size_path(path: str) -> str:
    return f"{path.rstrip('/')}__size"


def book_size(spark, path: str, batch_id: int, rows: int, chars: int) -> dict:
    """Book one written batch and check the store's total against the limit: over it is a
    warning, writes go on (A3 on write).

    One row beside the store holds the totals up to the last batch and before it, so a write reads
    and replaces that row only; a replayed last batch replaces its own share. A store has one
    writer at a time."""
    last = read_or_empty(spark, SIZES, _size_path(path)).first()
    before = ((0, 0) if last is None else (last["before_rows"], last["before_chars"]) if last["batch_id"] == batch_id
              else (last["rows"], last["chars"]))
    total = (before[0] + rows, before[1] + chars)
    spark.createDataFrame([(*total, int(batch_id), *before)], SIZES).coalesce(1).write.mode("overwrite").option(
        "partitionOverwriteMode", "static").parquet(_size_path(path))
    size = 2 if not total[0] else total[1] + total[0] + 1
    if size > S.MAX_STORE_BYTES:
        log.warning("evidence store %s holds %s of %s units", path, size, S.MAX_STORE_BYTES)
    return {"rows": rows, "size": size, "over_quota": size > S.MAX_STORE_BYTES}


def store_writer(rows: DataFrame):
    """Writer of the store's layout for ``rows`` with ``saved_date`` and ``batch_id``. Files are sorted by id
    (the sort by folder is needed anyway) and carry a Bloom filter on it, so a lookup skips row groups."""
    return (rows.sortWithinPartitions("saved_date", "batch_id", "id").write
                .option("partitionOverwriteMode", "dynamic").option("parquet.bloom.filter.enabled#id", "true")
                .option("parquet.bloom.filter.adaptive.enabled", "true").partitionBy("saved_date", "batch_id"))


def write_batch(df: DataFrame, path: str, batch_id: int, mode: str = "append") -> dict:
    """Write records into the store's layout (save date, batch) and book their size. The batch is
    persisted while it is counted and written, so neither it is computed twice nor the store read.
    ``overwrite`` replaces the batch's own folders."""
    held = df.is_cached
    rows = df if held else df.persist()
    try:
        # No Observation: it would leave the session in a state in which MLlib's functions cannot be shipped.
        seen = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(utf16_len(record_json(rows))).alias("chars")).first()
        saved = F.to_date("saved_at") if "saved_at" in rows.columns else F.lit(None).cast("date")
        store_writer(rows.withColumn("saved_date", saved).withColumn("batch_id", F.lit(int(batch_id)).cast("long"))
                     ).mode(mode).parquet(path)
    finally:
        if not held:
            rows.unpersist()
    return book_size(df.sparkSession, path, batch_id, seen["rows"], seen["chars"] or 0)


def append_evidence(df: DataFrame, path: str) -> dict:
    """Append records (K5): never de-duplicated, partitioned by save date so
    time-bounded reads prune partitions. O(batch) per append. The live job writes
    the same layout under its own ``batch_id``; every append has a negative one of
    its own. Returns ``{rows, size, over_quota}``."""
    return write_batch(df, path, -1 - (uuid.uuid4().int >> 66))


def clear_store(spark, path: str) -> None:
    """Replace the store with an empty table of the same schema (J6), whatever the
    session's partition overwrite mode is."""
    empty = spark.createDataFrame([], S.EVIDENCE).withColumn("saved_date", F.to_date("saved_at")).withColumn(
        "batch_id", F.lit(-1).cast("long"))
    (empty.write.mode("overwrite").option("partitionOverwriteMode", "static")
          .partitionBy("saved_date", "batch_id").parquet(path))
    for beside, schema in ((_size_path(path), SIZES), (gone_path(path), GONE)):
        spark.createDataFrame([], schema).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(beside)

"""Structured Streaming operators.

Messages arrive as files (or any streaming source) with the MESSAGE schema.
Stateful dedup uses the state store; scoring with retry and the dual write run
in ``foreachBatch`` and are idempotent per ``batch_id`` (a replayed batch
overwrites its own folder), so a restarted query never double-writes.
"""

from __future__ import annotations

import datetime as _dt
import logging

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions.text import evidence_id
from ..operators.detect import dedup_first, filter_messages, pending
from ..sinks.export import write_batch
from ..sources.evidence import read_or_empty

log = logging.getLogger(__name__)

MESSAGE_IN = T.StructType([
    T.StructField("scope", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("ord", T.LongType()),
])
# As it lands: with the event time that a dedup with ttl reads (null where files lack it).
MESSAGE_TIMED = T.StructType(MESSAGE_IN.fields + [T.StructField("event_ts", T.TimestampType())])


def read_message_stream(spark: SparkSession, path: str, schema=MESSAGE_TIMED, fmt: str = "parquet",
                        max_files_per_trigger: int | None = None) -> DataFrame:
    """Message event source (S7): a folder that new files land in."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(path)


def trigger_options(available_now: bool = False, period_ms: int = S.SCAN_PERIOD_MS) -> dict:
    """Throttle (T1): bursts of changes coalesce to one micro-batch per period;
    ``available_now`` drains what is there and stops (tests, backfills)."""
    return {"availableNow": True} if available_now else {"processingTime": f"{period_ms} milliseconds"}


def run_to_completion(writer, available_now: bool = True, timeout_s: float | None = None):
    """Start a stream writer with the chosen trigger and wait for it; with ``timeout_s``
    a query that has not ended by then is stopped and reported."""
    q = writer.trigger(**trigger_options(available_now)).start()
    try:
        if timeout_s is None:
            q.awaitTermination()
        elif not q.awaitTermination(timeout_s):
            raise TimeoutError(f"stream {q.name or q.id} did not finish in {timeout_s}s")
        if q.exception():
            raise q.exception()
    finally:
        if q.isActive:
            q.stop()
    return q


def stream_dedup(df: DataFrame, keys=("scope", "id"), ttl: str | None = None,
                 event_time: str = "event_ts") -> DataFrame:
    """Stateful first-seen filter.

    Default: exact and unbounded, like the reference's per-session set —
    state grows with the number of distinct keys (RocksDB state store
    recommended at scale). With ``ttl`` the state expires behind a watermark
    on ``event_time``.
    """
    if "id" in keys and "id" not in df.columns:
        df = df.withColumn("id", evidence_id("text"))
    if ttl:
        return df.withWatermark(event_time, ttl).dropDuplicatesWithinWatermark(list(keys))
    return df.dropDuplicates(list(keys))


def _batch_path(path: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/batch_id={int(batch_id)}"


def _overwrite_batch(df: DataFrame, path: str, batch_id: int, fmt: str = "parquet") -> None:
    """Write one micro-batch as its own ``batch_id`` folder, empty ones too; a replay of
    the same batch replaces it instead of appending twice."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "static")
       .format(fmt).save(_batch_path(path, batch_id)))


def read_batches(spark: SparkSession, path: str, schema: T.StructType, batches=None) -> DataFrame:
    """Read a batch-partitioned table; missing → empty with ``batch_id``. With
    ``batches`` only those folders are looked at, the table's root is not listed."""
    full = T.StructType(schema.fields + [T.StructField("batch_id", T.LongType())])
    if batches is None:
        return read_or_empty(spark, full, path)
    ids = ",".join(str(int(b)) for b in batches)
    if not ids:
        return spark.createDataFrame([], full)
    return read_or_empty(spark, full, f"{path.rstrip('/')}/batch_id={{{ids}}}", basePath=path)


ATTEMPT = T.StructType([
    T.StructField("scope", T.StringType()), T.StructField("id", T.StringType()),
    T.StructField("ord", T.LongType()), T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()), T.StructField("attempt", T.IntegerType()),
])

# A failed message as it waits for the next batch.
WAITING = T.StructType([
    T.StructField("scope", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("ord", T.LongType()),
    T.StructField("id", T.StringType()), T.StructField("attempt", T.IntegerType()),
])


OK_KEYS = T.StructType([T.StructField("scope", T.StringType()), T.StructField("id", T.StringType())])


def _snapshot_path(attempts_path: str, upto: int) -> str:
    return f"{attempts_path.rstrip('/')}__ok/upto={upto}"


OK_BUCKETS = 256           # folders of a snapshot of successful keys, by hash of the id


def _bucket(c="id"):
    return F.pmod(F.xxhash64(c), F.lit(OK_BUCKETS)).cast("int")


def _read_ok_snapshot(spark: SparkSession, attempts_path: str, upto: int, buckets=None) -> DataFrame:
    """Successful keys up to a batch; with ``buckets`` only those folders are read."""
    if upto < 0:
        return spark.createDataFrame([], OK_KEYS)
    keys = spark.read.schema(T.StructType(OK_KEYS.fields + [T.StructField("bucket", T.IntegerType())])).parquet(
        _snapshot_path(attempts_path, upto))
    if buckets is not None:            # null: a snapshot from before there were buckets
        keys = keys.where(F.col("bucket").isin(list(buckets)) | F.col("bucket").isNull())
    return keys.select("scope", "id")


def _write_ok_snapshot(keys: DataFrame, attempts_path: str, upto: int) -> None:
    """One folder per bucket, sorted by id and with a Bloom filter on it."""
    (keys.withColumn("bucket", _bucket()).hint("rebalance", "bucket").sortWithinPartitions("bucket", "id")
         .write.mode("overwrite").option("partitionOverwriteMode", "static")
         .option("parquet.bloom.filter.enabled#id", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
         .partitionBy("bucket").parquet(_snapshot_path(attempts_path, upto)))


def _ok_attempts(spark: SparkSession, attempts_path: str, after: int, before: int) -> DataFrame:
    """Successful keys of batches in (after, before); other batches' folders are not listed."""
    a = read_batches(spark, attempts_path, ATTEMPT, range(after + 1, before))
    return a.where(F.col("status") == "ok").select("scope", "id")


def _waiting_path(attempts_path: str) -> str:
    return f"{attempts_path.rstrip('/')}__waiting"


def score_with_retry(attempts_path: str, scorer, on_scored=None, compact_every: int | None = 100):
    """``foreachBatch`` handler for score-and-route with retry.

    Per micro-batch: trim/length filter, the messages that failed in the batch
    before, first occurrence per (scope, text), drop texts that already have a
    successful attempt in *earlier* batches, score, record every attempt
    with its status, keep the failed messages whole for the next batch, and hand
    the successful rows to ``on_scored(df, batch_id)``. ``scorer(df)`` must
    return ``df`` plus ``status`` ('ok' / 'error') and ``error`` columns instead
    of raising; ``attempt`` counts a message's tries from 1.

    A failed message waits in ``<attempts>__waiting/batch_id=N`` and is offered
    again whether or not it arrives again; it leaves the queue with its first
    success. A replayed batch reads the queue of the batch before it again, so it
    sees the same state.

    History compaction: the handler of every ``compact_every``-th batch first
    writes the distinct successful keys of all batches before it (previous
    snapshot + the batches since) as a snapshot; later batches read that
    snapshot plus only the folders of the batches after it. Snapshot positions
    follow from the batch id alone, and rewriting one on replay gives the same
    rows. A snapshot lies in ``OK_BUCKETS`` folders by hash of the id and a batch reads those of
    its own messages (at most ``OK_BUCKETS`` numbers reach the driver), plus at most
    ``compact_every`` recent batches.
    """
    waiting_path = _waiting_path(attempts_path)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        snap = -1
        if compact_every:
            snap = (batch_id // compact_every) * compact_every - 1
            if snap >= 0 and batch_id % compact_every == 0:
                prev = snap - compact_every
                keys = (_read_ok_snapshot(spark, attempts_path, prev)
                        .unionByName(_ok_attempts(spark, attempts_path, prev, snap + 1))
                        .distinct())
                _write_ok_snapshot(keys, attempts_path, snap)
        waiting = read_batches(spark, waiting_path, WAITING, [batch_id - 1]).drop("batch_id")
        arrived = filter_messages(batch).select("scope", "source", "text", "ord").unionByName(
            waiting.select("scope", "source", "text", "ord"))
        tries = waiting.groupBy("scope", "id").agg(F.max("attempt").alias("_tries"))
        msgs = (dedup_first(arrived).join(tries, ["scope", "id"], "left")
                .withColumn("attempt", (F.coalesce("_tries", F.lit(0)) + 1).cast("int")).drop("_tries"))
        msgs = msgs.persist()
        buckets = sorted(r[0] for r in msgs.select(_bucket()).distinct().collect()) if snap >= 0 else []
        done = (_read_ok_snapshot(spark, attempts_path, snap, buckets)
                .unionByName(_ok_attempts(spark, attempts_path, snap, batch_id))
                .withColumn("status", F.lit("ok")))
        todo = pending(msgs, done).persist()
        try:
            scored = scorer(todo).persist()
            _overwrite_batch(scored.select(*[f.name for f in ATTEMPT.fields]), attempts_path, batch_id)
            _overwrite_batch(scored.where(F.col("status") != "ok").select(*[f.name for f in WAITING.fields]),
                             waiting_path, batch_id)
            if on_scored is not None:
                on_scored(scored.where(F.col("status") == "ok"), batch_id)
            scored.unpersist()
        finally:
            todo.unpersist()
            msgs.unpersist()
    return handle


def _write_evidence(batch: DataFrame, path: str, batch_id: int) -> None:
    """Into the store's own layout (save date, batch); a replay replaces its batch."""
    write_batch(batch, path, batch_id, "overwrite")


def dual_write(logs_path: str, evidence_path: str):
    """``foreachBatch`` handler writing incidents to the incident log and the
    evidence store (T4). The batch is persisted once; the log write comes
    first and a failing evidence write is reported, not raised, so it cannot
    undo the log (the reference's order and tolerance). What the store then lacks
    is in the log by batch: :func:`backfill_evidence` brings it over."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        b = batch.persist()
        try:
            _overwrite_batch(b, logs_path, batch_id)
            try:
                _write_evidence(b, evidence_path, batch_id)
            except Exception as e:  # noqa: BLE001
                log.warning("evidence write failed for batch %s: %s", batch_id, e)
        finally:
            b.unpersist()
    return handle


def backfill_evidence(spark: SparkSession, logs_path: str, evidence_path: str) -> list[int]:
    """Write the batches that are in the incident log but not in the store; their ids.

    Only the batch ids (one number per logged batch) come to the driver."""
    logs = spark.read.option("basePath", logs_path).parquet(logs_path)
    have = read_or_empty(spark, T.StructType([T.StructField("batch_id", T.LongType())]), evidence_path)
    missing = (logs.select(F.col("batch_id").cast("long").alias("batch_id")).distinct()
                   .join(have.distinct(), "batch_id", "left_anti"))
    ids = sorted(r[0] for r in missing.collect())
    for batch_id in ids:
        _write_evidence(logs.where(F.col("batch_id") == batch_id).drop("batch_id"), evidence_path, batch_id)
    return ids


def batch_time(spark: SparkSession, path: str, batch_id: int) -> str:
    """The time a batch was first handled, recorded so that a replay repeats it."""
    schema = T.StructType([T.StructField("now", T.StringType())])
    known = read_or_empty(spark, schema, _batch_path(path, batch_id)).first()
    if known is not None:
        return known["now"]
    now = _dt.datetime.now(_dt.timezone.utc).isoformat()
    spark.createDataFrame([(now,)], schema).coalesce(1).write.mode("overwrite").parquet(_batch_path(path, batch_id))
    return now


def stream_stats(df: DataFrame) -> DataFrame:
    """Live counters (T5): incidents per severity so far (complete mode)."""
    from ..operators.stats import normalized_severity
    return df.groupBy(normalized_severity("severity").alias("severity")).agg(
        F.count(F.lit(1)).alias("n"))


def stream_store_stats(records: DataFrame, fields=None, repeats: bool = False) -> DataFrame:
    """Live statistics of a growing store (T5): the one row of ``operators.stats.store_stats`` so far, in update
    or complete mode. Count, size, severities and the first and last record by insertion sequence are partial
    aggregates, and the state is that one row. Where batches may be replayed into the stream, ``repeats`` drops
    records whose ``(revision, seq)`` was seen (state: the two numbers of every record)."""
    from ..operators.stats import store_stats
    if repeats:
        records = records.dropDuplicates(["revision", "seq"])
    return store_stats(records, fields)


def overwrite_sink(path: str):
    """``foreachBatch`` handler replacing a small aggregate table each batch."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)
    return handle


def incident_writer(spark: SparkSession, out_root: str, now, **decide_kw):
    """``on_scored`` of the live job: decision, evidence record, insertion sequence, incident
    log and evidence store. A record's ``seq`` is its number in the whole store (see
    ``operators.sequence``); a replayed batch repeats its numbers."""
    from ..functions.decision import with_decision
    from ..operators.evidence import build_evidence, stamp
    from ..operators.sequence import allocate, numbered

    write = dual_write(f"{out_root}/incident_logs", f"{out_root}/evidence")

    def on_scored(ok: DataFrame, batch_id: int) -> None:
        flagged = with_decision(ok, **decide_kw).where("is_toxic").persist()
        try:
            at = now if now is not None else batch_time(spark, f"{out_root}/batch_times", batch_id)
            first = allocate(spark, f"{out_root}/evidence__sequence", batch_id, flagged.count())
            rows = numbered(flagged, ["ord"], ["scope", "id"], first)
            write(stamp(build_evidence(rows, at), at), batch_id)
        finally:
            flagged.unpersist()
    return on_scored


def live_detection(spark: SparkSession, input_path: str, scorer, out_root: str, now,
                   checkpoint: str, available_now: bool = False,
                   max_files_per_trigger: int | None = None, timeout_s: float | None = None, **decide_kw):
    """The live path of the reference as one streaming job:
    message files → trim/length filter → first occurrence per scope → score
    (failures recorded and retried in later batches) → decision → evidence
    record → incident log + evidence store (idempotent per batch).

    ``now`` is the records' time; None takes the time of each batch, recorded
    under ``out_root`` so that a replayed batch repeats it.
    ``scorer(df)`` adds ``scores`` plus ``status``/``error`` (see
    :func:`score_with_retry`). Writes under ``out_root``: ``attempts``,
    ``incident_logs``, ``evidence``. Returns the finished (available_now) or
    running query.
    """
    handler = score_with_retry(f"{out_root}/attempts", scorer, on_scored=incident_writer(spark, out_root, now, **decide_kw))
    # max_files_per_trigger bounds each micro-batch (and so the keys each
    # batch checks against the attempt history).
    writer = (read_message_stream(spark, input_path, max_files_per_trigger=max_files_per_trigger)
              .writeStream.foreachBatch(handler)
              .option("checkpointLocation", checkpoint))
    if available_now:
        return run_to_completion(writer, True, timeout_s)
    return writer.trigger(**trigger_options(False)).start()

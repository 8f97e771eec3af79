"""Retry by timer: failed messages wait in keyed state and come due without any new input.

``score_with_timer`` keeps the messages that failed in list state, in buckets by the hash of (scope,
id), and sets a processing-time timer for each time at which some of them are due. When it
fires, those due are scored again, as one batch; the delay doubles with every attempt up to a bound. The
engine runs a micro-batch at every trigger while timers are possible, so a message that failed is
tried again whether or not anything arrives. A batch's time is part of its log entry, so a replayed
batch sees the same timers due.

State, timers and outcomes are one transaction of the state store: a message is either in a bucket's
list or was passed on with its score. What comes out is one row per attempt; sinks write it
per ``batch_id``, so a replay replaces its own rows.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schemas as S
from ..operators import isolation
from ..operators.detect import filter_messages
from ..operators.scoring import from_logits
from .stream import ATTEMPT, _overwrite_batch, incident_writer, read_batches, read_message_stream, stream_dedup

FIRST_DELAY_MS, LAST_DELAY_MS = S.SCAN_PERIOD_MS, 5 * 60 * 1000
_MESSAGE = "scope string, source string, text string, ord long, id string"
WAITING_STATE = f"{_MESSAGE}, attempt int, due long"
ATTEMPTS = f"{_MESSAGE}, attempt int, status string, error string, logits array<double>"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def by_text(scorer_factory):
    """A model of texts (see ``operators.scoring.score_with``) as a model of messages."""
    def build():
        fn = scorer_factory()
        return lambda messages: fn(messages["text"])
    return build


class RetryByTimer(StatefulProcessor):
    """``model_factory()`` gives a function of a frame of messages (with ``attempt``, from 1) that
    returns one probability column per label, and may raise."""

    def __init__(self, model_factory, first_delay_ms: int, last_delay_ms: int):
        self.model_factory, self.first, self.last = model_factory, first_delay_ms, last_delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING_STATE)
        self.model = self.model_factory()
        self.labels = [S.ID2LABEL[i] for i in sorted(S.ID2LABEL)]

    def _tried(self, messages: pd.DataFrame, now: int) -> tuple[pd.DataFrame, list[tuple]]:
        """Outcomes of one attempt, and the state of those that failed."""
        at = pd.Series(range(len(messages)))
        logits, errors = isolation.score_apart(lambda part: self.model(messages.iloc[part.to_numpy()]), at, self.labels)
        out = messages.assign(status=["ok" if e is None else "error" for e in errors], error=errors, logits=logits)
        failed = out[out["status"] == "error"]
        wait = [min(self.first << min(int(a) - 1, 30), self.last) for a in failed["attempt"]]
        rows = [(*(None if pd.isna(v) else v for v in (r.scope, r.source, r.text)), None if pd.isna(r.ord) else int(r.ord), r.id,
                 int(r.attempt), now + w) for r, w in zip(failed.itertuples(), wait)]
        return out, rows

    def _wait(self, rows: list[tuple]) -> None:
        for due in {r[-1] for r in rows}:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        for frame in rows:
            out, failed = self._tried(frame.drop(columns="bucket").assign(attempt=1).reset_index(drop=True), now)
            if failed:
                self.waiting.appendList(failed)
                self._wait(failed)
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        due = [r for r in held if r[-1] <= now]
        if not due:
            return                      # another timer of this bucket, due in the same batch, took them
        messages = pd.DataFrame([tuple(r)[:-1] for r in due], columns=["scope", "source", "text", "ord", "id", "attempt"])
        out, failed = self._tried(messages.assign(attempt=messages["attempt"] + 1), now)
        left = [tuple(r) for r in held if r[-1] > now] + failed
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        self._wait(failed)
        yield out

    def close(self) -> None:
        pass


def score_with_timer(messages: DataFrame, model_factory, first_delay_ms: int = FIRST_DELAY_MS,
                     last_delay_ms: int = LAST_DELAY_MS, buckets: int | None = None) -> DataFrame:
    """One row per attempt for a stream of messages: trim and length filter, first occurrence per
    (scope, text), score, retry by timer until it succeeds.

    ``buckets`` (default: four per shuffle partition) groups messages for scoring in batches; it is fixed for
    the life of a checkpoint. Needs the RocksDB state store, which this sets for the session.
    """
    spark = messages.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    firsts = stream_dedup(filter_messages(messages)).select("scope", "source", "text", "ord", "id")
    keyed = firsts.withColumn("bucket", F.pmod(F.xxhash64("scope", "id"), F.lit(buckets)).cast("int"))
    return keyed.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=RetryByTimer(model_factory, first_delay_ms, last_delay_ms), outputStructType=ATTEMPTS,
        outputMode="Append", timeMode="ProcessingTime")


def attempts_sink(attempts_path: str, on_scored=None):
    """``foreachBatch`` handler: every attempt into its batch's folder, successes on to ``on_scored``."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            _overwrite_batch(rows.select(*ATTEMPT.fieldNames()), attempts_path, batch_id)
            if on_scored is not None:
                on_scored(from_logits(rows.where("status = 'ok'")), batch_id)
        finally:
            rows.unpersist()
    return handle


def waiting_messages(spark: SparkSession, attempts_path: str) -> DataFrame:
    """``(scope, id, attempt)`` of messages without a success so far."""
    tries = read_batches(spark, attempts_path, ATTEMPT)
    return (tries.groupBy("scope", "id").agg(F.max(F.col("status") == "ok").alias("_ok"), F.max("attempt").alias("attempt"))
                 .where("not _ok").drop("_ok"))


def run_until_drained(spark: SparkSession, writer, attempts_path: str, period_ms: int = S.SCAN_PERIOD_MS, timeout_s: float | None = None):
    """Run until the input is used up and no message waits any more, then stop (backfills, tests).

    ``availableNow`` is no choice here: the engine goes on as long as timers are possible, so such a run
    never ends. This one ends when the timers of all waiting messages have fired and they have succeeded.
    """
    query, began = writer.trigger(processingTime=f"{period_ms} milliseconds").start(), time.time()
    try:
        while query.isActive:
            progress = query.lastProgress
            if progress is not None and not progress.numInputRows and not waiting_messages(spark, attempts_path).limit(1).count():
                break
            if timeout_s is not None and time.time() - began > timeout_s:
                raise TimeoutError(f"messages still wait after {timeout_s} s")
            time.sleep(period_ms / 1000)
        if query.exception():
            raise query.exception()
    finally:
        query.stop()
    return query


def live_detection_timed(spark: SparkSession, input_path: str, scorer_factory, out_root: str, now, checkpoint: str,
                         max_files_per_trigger: int | None = None, drain: bool = False, period_ms: int = S.SCAN_PERIOD_MS,
                         timeout_s: float | None = None, first_delay_ms: int = FIRST_DELAY_MS, **decide_kw):
    """:func:`stream.live_detection` with timers: for a model in Python (``scorer_factory`` as for
    ``score_with``). With ``drain`` it ends when nothing is left to read or to try again; else it
    returns the running query."""
    messages = read_message_stream(spark, input_path, max_files_per_trigger=max_files_per_trigger)
    rows = score_with_timer(messages, by_text(scorer_factory), first_delay_ms)
    attempts = f"{out_root}/attempts"
    writer = (rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
                  .foreachBatch(attempts_sink(attempts, incident_writer(spark, out_root, now, **decide_kw))))
    if drain:
        return run_until_drained(spark, writer, attempts, period_ms, timeout_s)
    return writer.trigger(processingTime=f"{period_ms} milliseconds").start()

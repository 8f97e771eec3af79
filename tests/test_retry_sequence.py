"""Retry by timer, isolation of failing texts, insertion sequence, positions of repeated keys, store sizes."""

import json
import math
import os
import random
import sys
import time

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from msgshield import schemas as S
from msgshield.operators import evidence as ev_ops, isolation, scoring
from msgshield.operators.index import attach, positions
from msgshield.operators.sequence import allocate, numbered
from msgshield.plans import catalog as C, fixtures as fx
from msgshield.sinks import export as sink
from msgshield.sources.evidence import read_evidence
from msgshield.streaming import stream as st, timed

from conftest import SF_SMALL

cloudpickle.register_pickle_by_value(sys.modules[__name__])     # the workers have no path to the tests
MESSAGE = "scope string, source string, text string, ord long, event_ts timestamp"
LABELS = [S.ID2LABEL[i] for i in sorted(S.ID2LABEL)]


def even(texts):
    return pd.DataFrame({label: [1 / len(LABELS)] * len(texts) for label in LABELS})


# ---- one bad text does not stop the others ------------------------------------

@pytest.mark.parametrize("n,bad", [(10000, {7123}), (10000, {0, 9999}), (1, {0}), (5, set()), (0, set()), (64, set(range(0, 64, 3)))])
def test_only_the_texts_that_raise_fail(n, bad):
    calls = []

    def model(texts):
        calls.append(len(texts))
        if any(int(t) in bad for t in texts):
            raise ValueError("cannot read")
        return even(texts)
    logits, errors = isolation.score_apart(model, pd.Series(map(str, range(n)), dtype=object), LABELS)
    assert {i for i, e in enumerate(errors) if e is not None} == bad
    assert [x is None for x in logits] == [e is not None for e in errors]
    assert len(calls) <= 1 + 2 * len(bad) * (1 + math.ceil(math.log2(max(n, 2))))
    assert all(e == "ValueError: cannot read" for e in errors if e)


def test_a_model_that_is_down_is_not_asked_for_every_text():
    calls = []

    def down(texts):
        calls.append(len(texts))
        raise ConnectionError("refused")
    logits, errors = isolation.score_apart(down, pd.Series(["x"] * 5000), LABELS, patience=20)
    assert len(calls) == 20 and not any(logits) and all("refused" in e for e in errors)


def test_wrong_number_of_results_is_a_failure():
    logits, errors = isolation.score_apart(lambda t: even(t).head(1), pd.Series(["a", "b"]), LABELS)
    assert errors == [None, None]           # halves of one text give one result each
    logits, errors = isolation.score_apart(lambda t: even(t).head(0), pd.Series(["a"]), LABELS)
    assert errors == ["ValueError: 0 results for 1 texts"]


def test_stream_scorer_isolates_a_bad_text(spark):
    def factory():
        def model(texts):
            if (texts == "bad").any():
                raise RuntimeError("tokenizer")
            return even(texts)
        return model
    df = spark.createDataFrame([("bad" if i == 777 else f"text {i}",) for i in range(2000)], "text string")
    out = scoring.stream_scorer(factory)(df)
    assert {r.status: r["count"] for r in out.groupBy("status").count().collect()} == {"ok": 1999, "error": 1}
    bad = out.where("status = 'error'").first()
    assert bad.text == "bad" and bad.error == "RuntimeError: tokenizer" and bad.logits is None and bad.scores is None
    assert out.where("status = 'ok'").where(F.col("error").isNotNull() | (F.size("logits") != len(LABELS))).isEmpty()


# ---- retry by timer -------------------------------------------------------------

def _land(spark, rows, path):
    spark.createDataFrame(rows, MESSAGE).coalesce(1).write.mode("append").parquet(path)


def test_failed_messages_succeed_though_nothing_else_arrives(spark, tmp_dir):
    inp, out, ck = (os.path.join(tmp_dir, x) for x in ("in", "attempts", "ck"))
    _land(spark, [("s", "x", f"message {i}", i, None) for i in range(40)] + [("s", "x", "message 3", 99, None), ("s", "x", " ", 5, None),
                                                                              (None, None, "message null", None, None)], inp)
    got = []

    def model(messages):
        if any(a < 3 and t in ("message 3", "message null") for t, a in zip(messages["text"], messages["attempt"])):
            raise TimeoutError("busy")
        return even(messages)
    rows = timed.score_with_timer(st.read_message_stream(spark, inp), lambda: model, first_delay_ms=100, buckets=4)
    writer = rows.writeStream.outputMode("append").option("checkpointLocation", ck).foreachBatch(
        timed.attempts_sink(out, lambda df, b: got.extend(df.select("text", "attempt", F.size("scores")).collect())))
    timed.run_until_drained(spark, writer, out, period_ms=200, timeout_s=100)
    tries = st.read_batches(spark, out, st.ATTEMPT)
    seen = sorted((r.attempt, r.status) for r in tries.join(
        spark.createDataFrame([("message 3",), ("message null",)], "text string").select(F.sha2("text", 256).alias("id")), "id").collect())
    assert seen == sorted([(1, "error"), (2, "error"), (3, "ok")] * 2)
    assert tries.count() == 41 + 4 and len(got) == 41 and {r.attempt for r in got} == {1, 3}
    assert timed.waiting_messages(spark, out).isEmpty()
    errors = {r.error for r in tries.where("status = 'error'").collect()}
    assert errors == {"TimeoutError: busy"}


def test_waiting_messages_survive_a_restart(spark, tmp_dir):
    inp, out, ck = (os.path.join(tmp_dir, x) for x in ("in", "attempts", "ck"))
    _land(spark, [("s", "x", "first", 1, None), ("s", "x", "second", 2, None)], inp)

    def run(model, drain):
        rows = timed.score_with_timer(st.read_message_stream(spark, inp), lambda: model, first_delay_ms=100, buckets=2)
        writer = rows.writeStream.outputMode("append").option("checkpointLocation", ck).foreachBatch(timed.attempts_sink(out))
        if drain:
            timed.run_until_drained(spark, writer, out, period_ms=200, timeout_s=100)
            return
        query = writer.trigger(processingTime="200 milliseconds").start()
        try:
            for _ in range(120):
                if query.exception() or not timed.waiting_messages(spark, out).isEmpty():
                    break
                time.sleep(0.5)
        finally:
            query.stop()

    def fails(messages):
        if (messages["text"] == "first").any():
            raise TimeoutError("busy")
        return even(messages)
    run(fails, drain=False)
    assert [r.id for r in timed.waiting_messages(spark, out).collect()] == [
        spark.range(1).select(F.sha2(F.lit("first"), 256)).first()[0]]
    run(even, drain=True)
    assert timed.waiting_messages(spark, out).isEmpty()
    assert st.read_batches(spark, out, st.ATTEMPT).where("status = 'ok'").count() == 2


def test_live_detection_with_timers(spark, tmp_dir):
    inp, root, ck = (os.path.join(tmp_dir, n) for n in ("in", "out", "ck"))
    _land(spark, [("s", "x", f"message number {i}", i % 3, None) for i in range(30)], inp)

    def factory():
        return lambda texts: pd.DataFrame([[0.0] * (len(LABELS) - 1) + [1.0]] * len(texts), columns=LABELS)
    timed.live_detection_timed(spark, inp, factory, root, fx.NOW, ck, drain=True, period_ms=200, timeout_s=100)
    assert spark.read.parquet(f"{root}/attempts").where("status = 'ok'").count() == 30


# ---- insertion sequence -----------------------------------------------------------

def test_numbers_follow_from_the_batch_before_and_replays_repeat_them(spark, tmp_dir):
    ledger = os.path.join(tmp_dir, "ledger")
    assert [allocate(spark, ledger, b, n) for b, n in ((0, 5), (1, 0), (2, 3), (-77, 4), (3, 2))] == [0, 5, 5, 8, 12]
    assert [allocate(spark, ledger, b, n) for b, n in ((3, 2), (0, 5), (-77, 4))] == [12, 0, 8]
    assert allocate(spark, ledger, 3, 9) == 14            # more than it took: new numbers, none used twice
    os.rename(os.path.join(ledger, "head"), os.path.join(ledger, "lost"))
    assert allocate(spark, ledger, 4, 1) == 23


def test_sequence_is_unique_over_live_batches_and_replays(spark, tmp_dir):
    root = os.path.join(tmp_dir, "out")
    on_scored = st.incident_writer(spark, root, fx.NOW)
    decided = fx.with_fixture_scores(C.deduped_document_messages(spark, SF_SMALL), key="ord").withColumn("ord", F.lit(7).cast("long"))
    parts = [decided.where(F.crc32("id") % 3 == i) for i in range(3)]
    for batch, part in enumerate(parts):
        on_scored(part, batch)
    before = {r.id: r.seq for r in read_evidence(spark, f"{root}/evidence").collect()}
    on_scored(parts[2], 2)
    got = read_evidence(spark, f"{root}/evidence").collect()
    assert sorted(r.seq for r in got) == list(range(len(got))) and len(got) > 20
    assert {r.id: r.seq for r in got} == before
    store = read_evidence(spark, f"{root}/evidence")
    assert [r.pos for r in ev_ops.latest_log(store).orderBy(F.desc("seq")).collect()] == list(range(len(got)))


def test_numbered_gives_tied_records_a_number_each(spark):
    df = spark.createDataFrame([("s", "a", 1), ("s", "a", 1), (None, None, 1), ("s", "b", 0)], "scope string, id string, ord long")
    got = sorted((r.seq, r.id) for r in numbered(df, ["ord"], ["scope", "id"], 10).collect())
    assert [g[0] for g in got] == [10, 11, 12, 13] and got[0][1] == "b"


# ---- positions attached to records ---------------------------------------------------

def test_attach_keeps_user_columns_and_spreads_repeated_keys(spark):
    rows = [(None if i % 3 == 0 else i, f"text {i}", "k", "n", "p", "c") for i in range(3000)]
    df = spark.createDataFrame(rows, "ord long, text string, _k string, _nth string, _p string, _c0 string").repartition(8)
    at = positions(df, ["ord"], keep=["ord"], index_col="pos")
    out = attach(df, at, ["ord"], ["pos"])
    got = out.collect()
    assert out.columns == [*df.columns, "pos"] and sorted(r.pos for r in got) == list(range(3000))
    assert {(r._k, r._nth, r._p, r._c0) for r in got} == {("k", "n", "p", "c")} and len({r.text for r in got}) == 3000
    assert {r.pos for r in got if r.ord is None} == set(range(1000))


def test_no_record_passes_a_sort_window_or_list(spark):
    import re

    ev = fx.evidence(spark, SF_SMALL)
    for df in (ev_ops.newest_first(ev), ev_ops.latest_log(ev)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "to_json" not in plan
        for line in plan.splitlines():
            if re.search(r"^\W*Window \[", line):
                assert "_pid" in line             # offsets, one row per partition
            if re.search(r"^\W*Sort \[", line):
                assert "screenshot" not in line


def test_attach_random_keys_against_plain(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 3, 4 + i]), rng.choice(["a", None]), f"t{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "k long, j string, text string")
    out = attach(df, positions(df, ["k", "j"], keep=["k", "j"], index_col="pos"), ["k", "j"], ["pos"]).collect()
    key = lambda r: (r.k is not None, r.k or 0, r.j is not None, r.j or "")
    assert [key(r) for r in sorted(out, key=lambda r: r.pos)] == sorted(key(r) for r in out)
    assert sorted(r.pos for r in out) == list(range(200)) and sorted(r.text for r in out) == sorted(r[2] for r in rows)


# ---- store ---------------------------------------------------------------------------

def test_document_export_with_tied_and_equal_records_is_json(spark, tmp_dir):
    ev = fx.evidence(spark, SF_SMALL).limit(6).withColumn("seq", F.lit(0).cast("long")).checkpoint()
    tied = ev.unionByName(ev.limit(1)).unionByName(ev.limit(1))
    for name, df in (("tied", tied), ("nulls", tied.withColumn("seq", F.lit(None).cast("long"))), ("one", ev.limit(1)), ("none", ev.limit(0))):
        out = sink.export_json_document(df, tmp_dir, fx.NOW, name)
        text = "\n".join(open(os.path.join(out, f), encoding="utf-8").read() for f in sorted(os.listdir(out)) if f.startswith("part-"))
        doc = json.loads(text)
        assert len(doc["evidence"]) == doc["totalIncidents"] == df.count()


def test_sizes_are_booked_without_reading_the_store(spark, tmp_dir, monkeypatch):
    ev = fx.evidence(spark, SF_SMALL)
    store = os.path.join(tmp_dir, "store")
    first = sink.write_batch(ev, store, 0, "overwrite")
    again = sink.write_batch(ev, store, 0, "overwrite")
    from msgshield.operators.stats import store_stats
    assert first == again and first["size"] == store_stats(ev).first()["size"]
    second = sink.append_evidence(ev, store)
    assert second["rows"] == ev.count() and second["size"] == store_stats(read_evidence(spark, store).select(*ev.columns)).first()["size"]
    assert sink.write_batch(ev.limit(0), store, 1, "overwrite")["size"] == second["size"]

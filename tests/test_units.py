"""Unit cases: trigger, tolerant load fallback, validation no-op, repeated
attachments, display fallbacks, report id."""

import os

from pyspark.sql import functions as F

from msgshield import schemas as S
from msgshield.functions.codec import report_id
from msgshield.operators.corpus import ensure_validation
from msgshield.operators.evidence import build_evidence, merge_attachments
from msgshield.operators.report import format_report
from msgshield.sources.corpus import load_corpora, write_labelled_csv
from msgshield.streaming import stream as st


def test_processing_time_trigger(spark, tmp_dir):
    inp = os.path.join(tmp_dir, "in")
    spark.createDataFrame([("s", "src", "hello world", 1)], st.MESSAGE_IN).write.parquet(inp)
    out, ck = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck")
    assert st.trigger_options() == {"processingTime": "1200 milliseconds"}
    q = (st.read_message_stream(spark, inp).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", ck).trigger(**st.trigger_options()).start())
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(out).count() == 1


def test_missing_train_uses_first_split(spark, tmp_dir):
    df = spark.createDataFrame([("some text here", "1", 1), ("other text", "0", 2)],
                               "comment_text string, label string, ord long")
    write_labelled_csv(df, os.path.join(tmp_dir, "hindi_val"))
    ex, report = load_corpora(spark, [("hindi_val", os.path.join(tmp_dir, "hindi_val")),
                                      ("hindi_test", os.path.join(tmp_dir, "missing"))])
    got = sorted((r.split, int(r.ord)) for r in ex.collect())
    assert got == [("train", 1), ("train", 2), ("validation", 1), ("validation", 2)]
    rep = {r.source_name: r.status for r in report.collect()}
    assert rep == {"hindi_val": "loaded", "hindi_test": "failed"}


def test_ensure_validation_noop_when_present(spark):
    df = spark.createDataFrame([(1, "train"), (2, "validation"), (3, "train")], "ord long, split string")
    assert sorted(ensure_validation(df).collect()) == sorted(df.collect())
    only = spark.createDataFrame([(i, "train") for i in range(25)], "ord long, split string")
    moved = ensure_validation(only).where("split = 'validation'").count()
    assert moved == 3          # ceil(0.1 * 25)


def test_repeated_attachments_make_versions(spark):
    now = "2024-06-01T00:00:00Z"
    d = spark.createDataFrame([("same text", "s", True, 0.9, "HIGH", 5),
                               ("same text", "s", True, 0.9, "HIGH", 9)],
                              "text string, source string, is_toxic boolean, max_score double, "
                              "severity string, seq long")
    logs = build_evidence(d, now)
    att = spark.createDataFrame([(1, "same text", "data:a"), (2, "same text", "data:b"),
                                 (3, "nope", "data:c")], "ord long, text string, screenshot string")
    upd, versions, status = merge_attachments(logs, att, now)
    u = {r.seq: r for r in upd.collect()}
    assert u[5].screenshot == "data:b" and len(u[5].chain_of_custody) == 3
    assert u[9].screenshot is None and len(u[9].chain_of_custody) == 1
    v = sorted((r.revision, r.screenshot, len(r.chain_of_custody)) for r in versions.collect())
    assert v == [(1, "data:a", 2), (2, "data:b", 3)]
    assert {r.att_ord: r.matched for r in status.collect()} == {1: True, 2: True, 3: False}


def test_display_fallbacks(spark):
    schema = "id string, source string, text string, severity string, max_score double, " \
             f"categories {S.CATEGORIES.simpleString()}, timestamp timestamp"
    df = spark.createDataFrame([(None, "", None, "WEIRD", 0.15,
                                 [("a_b_c", 0.665, "HIGH")], None)], schema)
    r = format_report(df).first()
    assert (r.evidence_id, r.source_display, r.text_display) == ("N/A", "Unknown", "No content")
    assert r.banner_label == "HARMFUL CONTENT" and r.severity_badge == "WEIRD"
    assert r.banner_categories == "A B_C (67%)" and r.categories_display == "A_B_C (67%)"
    assert r.time_display == "N/A" and r.score_pct == 15.0


def test_report_id_format(spark):
    r = spark.range(1).select(report_id(1704067200000, F.lit("x")).alias("r")).first().r
    assert r.startswith("SR-LQU5M2O0-") and len(r) == len("SR-LQU5M2O0-") + 5 and r == r.upper()


def test_stream_dedup_with_ttl_watermark(spark, tmp_dir):
    from pyspark.sql import types as T
    schema = T.StructType(st.MESSAGE_IN.fields + [T.StructField("event_ts", T.TimestampType())])
    inp = os.path.join(tmp_dir, "in")
    rows = [("s", "a", "same message", 1, "2024-01-01 00:00:00"),
            ("s", "a", "same message", 2, "2024-01-01 00:10:00"),
            ("s", "a", "other message", 3, "2024-01-01 00:20:00")]
    (spark.createDataFrame(rows, "scope string, source string, text string, ord long, ts string")
          .withColumn("event_ts", F.to_timestamp("ts")).drop("ts").write.parquet(inp))
    out, ck = os.path.join(tmp_dir, "out"), os.path.join(tmp_dir, "ck")
    s = st.stream_dedup(st.read_message_stream(spark, inp, schema=schema), ttl="1 hour")
    st.run_to_completion(s.writeStream.format("parquet").option("path", out)
                         .option("checkpointLocation", ck).outputMode("append"))
    got = sorted(r.text for r in spark.read.parquet(out).collect())
    assert got == ["other message", "same message"]


def test_write_report_tables(spark, tmp_dir):
    from msgshield.operators.report import write_report
    from msgshield.plans import fixtures as fx
    ev = fx.evidence(spark, "/root/testdata/sf0.001")
    out = write_report(ev, tmp_dir, fx.NOW)
    assert out.endswith("evidence_report_2024-06-01")
    h = spark.read.parquet(f"{out}/header").first()
    assert h.total == ev.count() and h.report_id.startswith("SR-")
    d = spark.read.parquet(f"{out}/details")
    assert sorted(r.incident_no for r in d.collect()) == list(range(1, ev.count() + 1))
    s = spark.read.parquet(f"{out}/summary").collect()
    assert sum(r.n for r in s) == ev.count() and all(r.n > 0 for r in s)


def test_live_detection_end_to_end(spark, tmp_dir):
    from msgshield.plans import catalog as C
    from msgshield.plans import fixtures as fx
    inp, root, ck = (os.path.join(tmp_dir, n) for n in ("in", "out", "ck"))
    msgs = fx.document_messages(spark, "/root/testdata/sf0.001")
    C._land_files(msgs, inp)
    st.live_detection(spark, inp, C.fixture_scorer, root, fx.NOW, ck, available_now=True)
    attempts = spark.read.parquet(f"{root}/attempts")
    ev = spark.read.parquet(f"{root}/evidence")
    logs = spark.read.parquet(f"{root}/incident_logs")
    firsts = C.deduped_document_messages(spark, "/root/testdata/sf0.001")
    assert attempts.count() == firsts.count()
    flagged_ok = (C.with_decision(fx.with_fixture_scores(firsts, key="ord"))
                  .where("is_toxic AND ord % 11 != 0").count())
    assert ev.count() == logs.count() == flagged_ok
    assert ev.where("version = '1.0' AND encrypted = false").count() == flagged_ok


def test_prepare_corpus_both_paths(spark, tmp_dir):
    from msgshield.plans import catalog as C
    from msgshield.plans import fixtures as fx
    from msgshield.plans.training import prepare_corpus
    sf = "/root/testdata/sf0.01"
    raw = fx.hindi_raw(spark, sf)
    specs = []
    for name in ("hindi_train", "hindi_val", "hindi_test"):
        p = os.path.join(tmp_dir, name)
        write_labelled_csv(raw.where(F.col("source_name") == name).select("comment_text", "label", "ord"), p)
        specs.append((name, p))
    ev = prepare_corpus(spark, specs, fx.english_raw(spark, sf), fx.hinglish_raw(spark, sf), hold_out=True)
    want = {(r.split, r.corpus, r.label, r.n) for r in C.q_split_sizes(spark, sf).collect()}
    got = {(r.split, r.corpus, r.label, r.n) for r in ev["sizes"].collect()}
    assert got == want
    n = ev["examples"].count()
    assert sorted(r.pos for r in ev["examples"].select("pos").collect()) == list(range(n))
    tr = prepare_corpus(spark, specs[:1], fx.english_raw(spark, sf), None, hold_out=False)
    splits = {r.split for r in tr["examples"].select("split").distinct().collect()}
    assert splits == {"train", "validation"}


def test_review_store(spark, tmp_dir):
    from msgshield.plans import fixtures as fx
    from msgshield.plans.review import review_store
    from msgshield.sinks.export import append_evidence
    ev = fx.evidence(spark, "/root/testdata/sf0.001")
    store = os.path.join(tmp_dir, "store")
    append_evidence(ev, store)
    out = review_store(spark, store, os.path.join(tmp_dir, "out"), fx.NOW)
    n = ev.count()
    assert out["stats"].first().total == n
    assert sorted(r.pos for r in out["listing"].collect()) == list(range(n))
    assert spark.read.json(f"{out['export']}/manifest").first().totalIncidents == n
    assert spark.read.parquet(f"{out['report']}/details").count() == n

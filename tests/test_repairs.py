"""Cases the fixture tables do not reach: lost messages, odd labels, nested and broken
HTML, hot groups, mixed stores, missing sources."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from msgshield.functions.codec import report_id
from msgshield.operators import corpus as corp
from msgshield.operators import evidence as ev_ops
from msgshield.operators import metrics, report, scoring
from msgshield.plans import catalog as C
from msgshield.plans import fixtures as fx
from msgshield.plans.training import prepare_corpus
from msgshield.sinks import export as sink
from msgshield.sources import corpus as src
from msgshield.sources.evidence import read_evidence
from msgshield.sources.html import extract_from_html, extract_messages, parse_selector
from msgshield.streaming import stream as st

from conftest import SF_SMALL

MESSAGE = "scope string, source string, text string, ord long"


# ---- T3, T4: nothing is lost ------------------------------------------------

def test_failed_message_is_offered_again_without_arriving_again(spark, tmp_dir):
    path = os.path.join(tmp_dir, "attempts")
    got = []
    h = st.score_with_retry(path, C.flaky_scorer, on_scored=lambda df, b: got.extend(
        (b, r.text, r.ord, r.attempt) for r in df.select("text", "ord", "attempt").collect()))
    first = spark.createDataFrame([("s", "x", "message eleven", 11), ("s", "x", "message two", 2)], MESSAGE)
    other = spark.createDataFrame([("s", "x", "message three", 3)], MESSAGE)
    h(first, 0)
    h(other, 1)
    h(other, 1)                                   # a replay sees the same queue
    h(spark.createDataFrame([], MESSAGE), 2)
    assert sorted(set(got)) == [(0, "message two", 2, 1), (1, "message eleven", 11, 2), (1, "message three", 3, 1)]
    last = {(r.ord, r.batch_id): r.status for r in st.read_batches(spark, path, st.ATTEMPT).collect()}
    assert last == {(2, 0): "ok", (11, 0): "error", (11, 1): "ok", (3, 1): "ok"}


def test_backfill_brings_over_what_the_store_lacks(spark, tmp_dir):
    ev = fx.evidence(spark, SF_SMALL)
    logs, store = os.path.join(tmp_dir, "logs"), os.path.join(tmp_dir, "store")
    st.dual_write(logs, store)(ev.where("seq % 2 = 0"), 0)
    st._overwrite_batch(ev.where("seq % 2 = 1"), logs, 1)          # the store's write was lost
    assert st.backfill_evidence(spark, logs, store) == [1]
    assert st.backfill_evidence(spark, logs, store) == []
    assert read_evidence(spark, store).count() == ev.count()


def test_one_store_for_appends_and_the_live_job(spark, tmp_dir):
    ev = fx.evidence(spark, SF_SMALL)
    store = os.path.join(tmp_dir, "store")
    st.dual_write(os.path.join(tmp_dir, "logs"), store)(ev, 0)
    note = sink.append_evidence(ev, store)
    both = read_evidence(spark, store)
    assert both.count() == 2 * ev.count() and note["rows"] == ev.count() and not note["over_quota"]
    assert both.where("saved_date = date '2024-06-01'").count() == 2 * ev.count()


def test_live_records_carry_their_batch_time_and_a_replay_repeats_it(spark, tmp_dir):
    path = os.path.join(tmp_dir, "times")
    a = st.batch_time(spark, path, 0)
    b = st.batch_time(spark, path, 1)
    assert a < b and st.batch_time(spark, path, 0) == a


def test_dedup_with_ttl_on_the_shipped_reader(spark, tmp_dir):
    inp, out, ck = (os.path.join(tmp_dir, n) for n in ("in", "out", "ck"))
    rows = [("s", "x", "one", 1, "2024-01-01 00:00:00"), ("s", "x", "one", 2, "2024-01-01 00:01:00")]
    spark.createDataFrame(rows, MESSAGE + ", t string").withColumn("event_ts", F.col("t").cast("timestamp")).drop(
        "t").write.parquet(inp)
    s = st.stream_dedup(st.read_message_stream(spark, inp), ttl="1 hour")
    st.run_to_completion(s.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck))
    assert spark.read.parquet(out).count() == 1


# ---- stores -----------------------------------------------------------------

def test_clear_store_in_dynamic_overwrite_mode(spark, tmp_dir):
    store = os.path.join(tmp_dir, "store")
    sink.append_evidence(fx.evidence(spark, SF_SMALL), store)
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        sink.clear_store(spark, store)
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert read_evidence(spark, store).count() == 0


def test_a_broken_store_is_an_error_not_an_empty_one(spark, tmp_dir):
    bad = os.path.join(tmp_dir, "bad")
    os.makedirs(bad)
    with open(os.path.join(bad, "part-0.parquet"), "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):
        read_evidence(spark, bad).count()


# ---- corpus -----------------------------------------------------------------

def test_positional_fallback_renames_both_columns_at_once(spark):
    df = src.positional_fallback(spark.createDataFrame([(7, "words")], "id int, text string"))
    assert df.columns == ["text", "label"] and df.first() == (7, "words")


def test_load_with_a_fallback_source_of_odd_labels(spark, tmp_dir):
    a, b = os.path.join(tmp_dir, "a"), os.path.join(tmp_dir, "b")
    src.write_labelled_csv(spark.createDataFrame([("t1", "1", 0)], "text string, label string, ord int"), a)
    src.write_labelled_csv(spark.createDataFrame([("t2", "x")], "body string, target string"), b)
    ex, rep = src.load_corpora(spark, [("hindi_train", a), ("hindi_test", b)])
    assert {(r.text, r.label) for r in ex.collect()} == {("t1", 1), ("t2", 0)}
    assert {r.status for r in rep.collect()} == {"loaded"}


def test_a_missing_extra_corpus_is_left_out(spark, tmp_dir):
    p = os.path.join(tmp_dir, "hindi_train")
    src.write_labelled_csv(spark.createDataFrame([("t1", "1", 0)], "text string, label string, ord int"), p)
    got = prepare_corpus(spark, [("hindi_train", p)], os.path.join(tmp_dir, "none"),
                         spark.createDataFrame([(1,)], "wrong int"))
    assert got["examples"].count() == 1


def test_positional_split_of_a_corpus_with_nine_tenths_of_the_rows_is_spread(spark):
    n = 20_000
    df = spark.range(n).select(F.when(F.col("id") < n * 0.9, F.lit("hot")).otherwise(F.lit("cold")).alias("corpus"),
                               F.col("id").alias("ord"), F.repeat(F.lit("text "), 20).alias("text"))
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "1024"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        out = corp.positional_split(df)
        got = out.groupBy(F.spark_partition_id().alias("p"), "corpus", "split").agg(
            F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("t")).collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    hot = [r.n for r in got if r.corpus == "hot"]
    assert sum(hot) == n * 0.9 and max(sum(r.n for r in got if r.p == p) for p in {r.p for r in got}) < n / 3
    assert sum(r.n for r in got if r.split == "train") == int(0.9 * n * 0.9) + int(0.9 * n * 0.1)
    assert {r.t for r in got} == {100}


def test_positions_with_a_repeated_key_stay_a_permutation(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "ord long, x string")
    out = corp.seeded_shuffle(df, key="ord").collect()
    assert sorted(r.pos for r in out) == [0, 1, 2, 3] and {r.x for r in out} == set("abcd")


# ---- metrics and scoring ----------------------------------------------------

def test_metrics_count_every_observed_class(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (2, 1)], "label int, pred int").withColumn("pred_b", F.col("pred"))
    counts = {(r.label, r.pred): r.n for r in metrics.confusion(df).collect()}
    assert sum(counts.values()) == 4 and counts[(2, 1)] == 2 and counts[(1, 1)] == 0
    f1 = metrics.macro_f1(df).first().macro_f1
    both = metrics.compare_models(df, a="pred", b="pred_b").first()
    assert f1 == pytest.approx((2 / 3) / 3) and both.macro_f1_a == both.macro_f1_b == pytest.approx(f1)
    assert both.accuracy_a == 0.25


def test_scorers_take_null_texts_and_a_named_model_is_built_once_per_worker(spark, tmp_dir):
    train = spark.createDataFrame([("bad bad", 0), ("good good", 1), (None, 1)], "text string, label int")
    model, _ = scoring.fit_scorer(train, train, grid=({"regParam": 0.1},), num_features=64)
    assert scoring.score(train, model).count() == 3 and scoring.evaluate(model, train).first().n == 3
    builds = os.path.join(tmp_dir, "builds")
    os.makedirs(builds)

    def factory():
        import uuid
        open(os.path.join(builds, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda t: pd.DataFrame({"abusive": [0.9] * len(t), "non-abusive": [0.1] * len(t)})
    df = spark.range(400).repartition(16).select(F.col("id").cast("string").alias("text"))
    assert scoring.score_with(df, factory, name="test-model").select("pred").collect()
    files = os.listdir(builds)
    assert len(files) == len({f.split("-")[0] for f in files})


# ---- attachments and reports ------------------------------------------------

def test_many_attachments_on_one_id_cost_their_number(spark):
    d = spark.createDataFrame([("hot", "s", True, 0.9, "HIGH", 5)],
                              "text string, source string, is_toxic boolean, max_score double, severity string, seq long")
    logs = ev_ops.build_evidence(d, fx.NOW)
    att = spark.range(40).select(F.col("id").alias("ord"), F.lit("hot").alias("text"),
                                 F.concat(F.lit("data:"), F.col("id")).alias("screenshot"))
    first, versions, custody, status = ev_ops.attachment_events(logs, att, fx.NOW)
    assert custody.count() == versions.count() == status.count() == 40
    assert versions.select(F.max(F.size("chain_of_custody"))).first()[0] == 1
    assert first.first().last_shot == "data:39"
    nested = ev_ops.nest_custody(versions.where("revision in (1, 40)").drop("att_ord"), custody)
    assert sorted(len(r.chain_of_custody) for r in nested.collect()) == [2, 41]


def test_report_id_tail_is_base_36_of_the_salts_crc(spark):
    import zlib
    import numpy as np
    r = spark.range(1).select(report_id(1704067200000, F.lit("x")).alias("r")).first().r
    assert r == f"SR-LQU5M2O0-{np.base_repr(zlib.crc32(b'x'), 36)[-5:].rjust(5, '0')}"
    ev = fx.evidence(spark, SF_SMALL).limit(6).cache()
    b = ev.withColumn("seq", F.col("seq") + 1)      # a store of the same size, other content
    assert report.report_header(ev, fx.NOW).first().report_id != report.report_header(b, fx.NOW).first().report_id


def test_short_dashboard_time(spark):
    df = spark.createDataFrame([("2024-02-05 01:01:00",), (None,)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    assert {r[0] for r in df.select(report.short_time("t")).collect()} == {"5/2/24, 6:31 am", "N/A"}


# ---- extraction -------------------------------------------------------------

def _texts(html, *rules):
    return [t for _, _, t in extract_from_html(html, [parse_selector(r) for r in rules])]


def test_inner_list_does_not_close_the_outer_item():
    html = '<ul><li><div role="row"><ul><li>x</li></ul><div dir="auto">hello there</div></div></li></ul>'
    assert _texts(html, 'div[role="row"] div[dir="auto"]') == ["hello there"]


def test_stray_end_tag_closes_nothing_outside_its_scope():
    assert _texts('<b><div dir="auto">part one</b> part two</div>', 'div[dir="auto"]') == ["part one part two"]


def test_deep_pages_need_no_recursion():
    assert _texts("<div dir='auto'>" + "<b>" * 20_000 + "deep", 'div[dir="auto"]') == ["deep"]


def test_source_of_odd_urls(spark):
    urls = ["https://a_b.example.com/x", "https://example.com/a|b", "https://user@Example.com:81/?q=a b", "nothing", None]
    pages = spark.createDataFrame([(i, u, '<p class="m">some text</p>') for i, u in enumerate(urls)],
                                  "page_id long, url string, html string")
    got = {r.page_id: r.source for r in extract_messages(pages, ("p.m",)).collect()}
    assert got == {0: "a_b.example.com", 1: "example.com", 2: "example.com", 3: None, 4: None}


# ---- S5: headers of any kind ----------------------------------------------------

def test_a_header_that_clashes_with_the_fallback_names_is_loaded(spark, tmp_dir):
    files = {"train": "a,b,text\nx one,0,old\nx two,1,old\n", "val": "text,Label,label_2\ny,1,z\n", "test": "text,label\nx three,1\n"}
    for name, body in files.items():
        with open(os.path.join(tmp_dir, f"{name}.csv"), "w", encoding="utf-8") as f:
            f.write(body)
    specs = [(n, os.path.join(tmp_dir, f"{n}.csv")) for n in files] + [("gone", os.path.join(tmp_dir, "gone.csv"))]
    examples, report = src.load_corpora(spark, specs)
    status = {r.source_name: (r.status, r.rows) for r in report.collect()}
    assert status["train"] == ("loaded", 2) and status["test"] == ("loaded", 1) and status["gone"][0] == "failed"
    rows = {r.text: (r.label, r.text_2) for r in examples.where("source_name = 'train'").collect()}
    assert rows == {"x one": (0, "old"), "x two": (1, "old")}
    odd = spark.createDataFrame([("1", "2", "3", "4")], ["a", "b", "Text", "Text_2"])
    assert src.positional_fallback(odd).columns == ["text", "label", "Text_2_", "Text_2"]


def test_optimiser_passes_do_not_grow_with_small_partitions(spark, monkeypatch):
    """Every pass shuffles a gradient per partition, so passes run over a task per core (or by bytes), all rows in them."""
    seen = []

    class Seen:
        def __init__(self, inner):
            self.inner = inner

        def fit(self, df):
            seen.append((df.rdd.getNumPartitions(), df.count()))
            return self.inner.fit(df)

    plain = scoring.classifier
    monkeypatch.setattr(scoring, "classifier", lambda *a: Seen(plain(*a)))
    train = spark.createDataFrame([(f"w{i % 7} w{i % 5} x", i % 2) for i in range(300)], "text string, label int").repartition(60)
    scoring.fit_scorer(train, train, grid=({"regParam": 0.1},), num_features=64)
    scoring.fit_scorer(train, train, grid=({"regParam": 0.1},), num_features=64, partitions=9)
    monkeypatch.setattr(scoring, "PASS_BYTES", 100)
    scoring.fit_scorer(train, train, grid=({"regParam": 0.1},), num_features=64)
    size = sum(len(f"w{i % 7} w{i % 5} x") for i in range(300))
    assert seen == [(spark.sparkContext.defaultParallelism, 300), (9, 300), (-(-size // 100), 300)]


def test_landed_files_follow_the_inputs_partitions(spark, tmp_dir):
    """A stream's input is landed by the tasks that read it, not gathered in four."""
    from msgshield.plans import catalog
    msgs = spark.range(1000).repartition(12).selectExpr("'en' scope", "'s' source", "concat('text ', id) text", "id ord")
    catalog._land_files(msgs, f"{tmp_dir}/in")
    landed = spark.read.parquet(f"{tmp_dir}/in")
    assert len(landed.inputFiles()) == 12 and sorted(r.ord for r in landed.collect()) == list(range(1000))

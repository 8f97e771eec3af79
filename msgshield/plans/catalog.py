"""Registered queries: one per operator of the inventory, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the given tables (through :mod:`fixtures`) and runs over
them whole. Outputs are flat scalar columns named like the oracle SQL in
:mod:`msgshield.plans.oracle`.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas as S
from ..functions import codec
from ..functions.decision import abusive_sum, with_decision
from ..functions.labels import argmax, id2label, is_abusive_label, label2id, lenient_label
from ..functions.text import evidence_id, utf16_len, with_fixed_tokens
from ..operators import corpus as corp
from ..operators import detect, evidence as ev_ops, metrics, report as rep, scoring, stats
from ..session import read_table, scratch_path
from ..sinks import export as sink, upkeep
from ..sources import corpus as src
from ..sources import html as html_src
from ..sources.evidence import STORED, read_evidence
from ..streaming import stream as st, timed
from . import fixtures as fx

QUERIES: dict = {}


def register(name):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _ms(c):
    return F.unix_millis(F.col(c) if isinstance(c, str) else c)


# ---------------------------------------------------------------------------
# Detection: P5, J1, J2, P6–P9, P10
# ---------------------------------------------------------------------------

def deduped_document_messages(spark, sf_dir) -> DataFrame:
    return detect.dedup_first(detect.filter_messages(fx.document_messages(spark, sf_dir)))


@register("severity_counts")
def q_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents → trim/length filter → first-occurrence dedup → fixture score
    → decision → evidence → severity counts (the end-to-end slice)."""
    firsts = deduped_document_messages(spark, sf_dir)
    decided = with_decision(fx.with_fixture_scores(firsts, key="ord"))
    evid = ev_ops.build_evidence(decided, fx.NOW, seq="ord")
    return stats.severity_counts(evid)


@register("filter_messages")
def q_filter_messages(spark, sf_dir):
    kept = detect.filter_messages(fx.conversation_messages(spark, sf_dir))
    return kept.select("conv_id", "ord", "text", utf16_len("text").alias("n_units"))


@register("dedup_first")
def q_dedup_first(spark, sf_dir):
    return deduped_document_messages(spark, sf_dir).select("scope", "id", "ord", "source")


@register("retry_pending")
def q_retry_pending(spark, sf_dir):
    firsts = deduped_document_messages(spark, sf_dir)
    attempts = fx.attempts_for(firsts)
    return detect.pending(firsts, attempts).select("scope", "id", "ord")


@register("label_match")
def q_label_match(spark, sf_dir):
    d = fx.scored_documents(spark, sf_dir)
    return (d.select("doc_id", F.posexplode("scores").alias("pos", "sc"))
             .select("doc_id", F.col("pos").cast("int").alias("pos"),
                     F.col("sc.label").alias("label"),
                     is_abusive_label(F.col("sc.label")).alias("is_abusive")))


@register("decide")
def q_decide(spark, sf_dir):
    d = with_decision(fx.scored_documents(spark, sf_dir))
    return d.select("doc_id", "is_toxic", "max_score", "severity")


@register("categories")
def q_categories(spark, sf_dir):
    d = with_decision(fx.scored_documents(spark, sf_dir))
    first = F.get(F.col("categories"), 0)
    return d.select("doc_id", F.size("categories").alias("n_categories"),
                    first["category"].alias("category"), first["score"].alias("category_score"),
                    first["severity"].alias("category_severity"),
                    F.size("all_scores").alias("n_all_scores"))


@register("abusive_sum")
def q_abusive_sum(spark, sf_dir):
    d = fx.scored_documents(spark, sf_dir)
    return d.select("doc_id", abusive_sum("scores").alias("abusive_sum"))


@register("evidence_id")
def q_evidence_id(spark, sf_dir):
    return fx.documents(spark, sf_dir).select("doc_id", evidence_id("text").alias("id"))


# ---------------------------------------------------------------------------
# Evidence: P11, P12, J4–J8, A1–A3, O1, O2
# ---------------------------------------------------------------------------

def _flat_evidence(df):
    first_event = F.get(F.col("chain_of_custody"), 0)
    return df.select(
        "id", "seq", "source", "severity", "max_score", "score", "label", "timestamp_ms",
        _ms("timestamp").alias("timestamp_epoch_ms"),
        F.size("chain_of_custody").alias("n_custody"),
        first_event["action"].alias("custody_action"),
        first_event["actor"].alias("custody_actor"),
        _ms(first_event["timestamp"]).alias("custody_ms"),
        F.col("screenshot").isNull().alias("no_screenshot"),
        F.size("categories").alias("n_categories"),
        F.size("all_scores").alias("n_all_scores"),
        "revision")


@register("build_evidence")
def q_build_evidence(spark, sf_dir):
    return _flat_evidence(fx.evidence(spark, sf_dir))


@register("stamp_evidence")
def q_stamp_evidence(spark, sf_dir):
    e = fx.evidence(spark, sf_dir)
    return e.select("seq", _ms("saved_at").alias("saved_at_ms"), "version", "encrypted")


@register("lookup_id")
def q_lookup_id(spark, sf_dir):
    found = ev_ops.lookup(fx.evidence(spark, sf_dir), fx.lookup_ids(spark, sf_dir))
    # Integer outputs stay non-null (-1 = none) so engines that widen nullable
    # ints to floats still compare equal; the operator itself returns null.
    return found.select("id", "found", F.coalesce("seq", F.lit(-1)).alias("seq"), "severity")


@register("delete_ids")
def q_delete_ids(spark, sf_dir):
    kept = ev_ops.delete_ids(fx.evidence(spark, sf_dir), fx.delete_ids(spark, sf_dir))
    return kept.select("id", "seq")


def _merge(spark, sf_dir):
    logs = fx.evidence(spark, sf_dir)
    return logs, ev_ops.attachment_events(logs, fx.attachments(spark, sf_dir), fx.NOW)


def _n_custody():
    """Events of a stored version: its original trail and one per attachment so far."""
    return (F.size("chain_of_custody") + F.col("revision")).alias("n_custody")


@register("merge_attachments")
def q_merge_attachments(spark, sf_dir):
    _, (_, versions, _, status) = _merge(spark, sf_dir)
    v = versions.select("att_ord", "revision", _n_custody(), "screenshot")
    none = F.lit(-1)
    return status.join(v, "att_ord", "left").select(
        "att_ord", "id", F.coalesce("seq", none).alias("seq"), "matched",
        F.coalesce("revision", none).alias("revision"), F.coalesce("n_custody", none).alias("n_custody"),
        "screenshot")


@register("current_evidence")
def q_current_evidence(spark, sf_dir):
    logs, (_, versions, _, _) = _merge(spark, sf_dir)
    store = logs.unionByName(versions.select(*logs.columns))
    cur = ev_ops.current_evidence(store)
    return cur.select("id", "seq", "revision", _n_custody(), "screenshot")


@register("custody_events")
def q_custody_events(spark, sf_dir):
    _, (_, _, custody, _) = _merge(spark, sf_dir)
    return custody.select("id", "seq", "revision", "action", _ms("timestamp").alias("timestamp_ms"), "actor")


STRING_FIELDS = [("id", "id"), ("source", "source"), ("text", "text"), ("severity", "severity"),
                 ("label", "label"), ("version", "version")]


@register("store_stats")
def q_store_stats(spark, sf_dir):
    st = stats.store_stats(fx.evidence(spark, sf_dir), fields=STRING_FIELDS)
    return st.withColumns({"oldest": _ms("oldest"), "newest": _ms("newest")})


@register("quota_check")
def q_quota_check(spark, sf_dir):
    return stats.quota_check(fx.evidence(spark, sf_dir), fields=STRING_FIELDS)


@register("newest_first")
def q_newest_first(spark, sf_dir):
    return ev_ops.newest_first(fx.evidence(spark, sf_dir)).select("seq", "pos")


@register("latest_log")
def q_latest_log(spark, sf_dir):
    return ev_ops.latest_log(fx.evidence(spark, sf_dir)).select("seq", "pos")


# ---------------------------------------------------------------------------
# Corpus: S1–S5, P1–P4, J3, J9, O3–O5, O7, A4
# ---------------------------------------------------------------------------


@register("csv_scan")
def q_csv_scan(spark, sf_dir):
    raw = fx.raw_corpus(spark, sf_dir, string_labels=True).select("ord", "comment_text", "label")
    path = scratch_path(spark, "csv_scan")
    src.write_labelled_csv(raw, path)
    back = src.read_labelled_csv(spark, path)
    return back.select(F.col("ord").cast("long").alias("ord"), "comment_text", "label")


@register("alias_columns")
def q_alias_columns(spark, sf_dir):
    parts = [("hindi", fx.hindi_raw(spark, sf_dir).drop("source_name")),
             ("english", fx.english_raw(spark, sf_dir)),
             ("hinglish", fx.hinglish_raw(spark, sf_dir))]
    out = [src.resolve_aliases(df).select(F.lit(name).alias("corpus"), "ord",
                                          evidence_id("text").alias("id"),
                                          F.col("label").cast("int").alias("label"))
           for name, df in parts]
    return corp.concat_corpora(*out)


@register("positional_columns")
def q_positional_columns(spark, sf_dir):
    raw = fx.raw_corpus(spark, sf_dir).select(F.col("comment_text").alias("body"),
                                              F.col("label").alias("target"), "ord")
    df = src.positional_fallback(src.resolve_aliases(raw))
    return df.select("ord", evidence_id("text").alias("id"), F.col("label").cast("int").alias("label"))


@register("split_route")
def q_split_route(spark, sf_dir):
    raw = fx.raw_corpus(spark, sf_dir)
    return raw.select("ord", "source_name", src.route_split("source_name").alias("split"))


def _hindi_specs(spark, sf_dir, with_missing=True):
    raw = fx.raw_corpus(spark, sf_dir)
    root = scratch_path(spark, "corpora")
    specs = []
    for name in ("hindi_train", "hindi_val", "hindi_test"):
        path = f"{root}/{name}"
        src.write_labelled_csv(raw.where(F.col("source_name") == name)
                                  .select("comment_text", "label", "ord"), path)
        specs.append((name, path))
    if with_missing:
        specs.append(("hindi_extra", f"{root}/hindi_extra_missing"))
    return specs


@register("load_report")
def q_load_report(spark, sf_dir):
    _, report = src.load_corpora(spark, _hindi_specs(spark, sf_dir))
    return report.select("source_name", "split", "status", "rows")


@register("clean_examples")
def q_clean_examples(spark, sf_dir):
    raw = src.resolve_aliases(fx.raw_corpus(spark, sf_dir, string_labels=True))
    c = src.clean_examples(raw, keep=["ord"])
    return c.select("ord", evidence_id("text").alias("id"), F.col("label").alias("label_raw"))


@register("lenient_label")
def q_lenient_label(spark, sf_dir):
    raw = src.resolve_aliases(fx.raw_corpus(spark, sf_dir, string_labels=True))
    c = src.clean_examples(raw, keep=["ord"])
    return c.select("ord", F.col("label").alias("label_raw"), lenient_label("label").alias("label"))


@register("collapse_classes")
def q_collapse_classes(spark, sf_dir):
    e = fx.classes_raw(spark, sf_dir)
    return corp.normalize_english(e.withColumn("class_raw", F.col("class"))) \
        .select("ord", F.col("class_raw").alias("class"), "label")


@register("invert_label")
def q_invert_label(spark, sf_dir):
    h = fx.inverted_raw(spark, sf_dir)
    return corp.normalize_hinglish(h.withColumn("label_raw", F.col("label"))) \
        .select("ord", "label_raw", "label")


def hindi_examples(spark, sf_dir):
    raw = src.resolve_aliases(fx.hindi_raw(spark, sf_dir))
    c = src.clean_examples(raw, keep=["ord", "source_name"])
    return c.select("text", lenient_label("label").alias("label"), F.lit("hindi").alias("corpus"),
                    src.route_split("source_name").alias("split"), "ord")


def extra_examples(spark, sf_dir):
    e = corp.normalize_english(fx.english_raw(spark, sf_dir)).withColumn("corpus", F.lit("english"))
    h = corp.normalize_hinglish(fx.hinglish_raw(spark, sf_dir)).withColumn("corpus", F.lit("hinglish"))
    return corp.concat_corpora(e.select("text", "label", "corpus", "ord"),
                               h.select("text", "label", "corpus", "ord"))


def all_examples(spark, sf_dir):
    """Hindi with its routed splits + the extra corpora split 90/10 by position."""
    return corp.concat_corpora(hindi_examples(spark, sf_dir),
                               corp.positional_split(extra_examples(spark, sf_dir)))


@register("concat_corpora")
def q_concat_corpora(spark, sf_dir):
    both = corp.concat_corpora(hindi_examples(spark, sf_dir), extra_examples(spark, sf_dir))
    return both.select("corpus", "ord", evidence_id("text").alias("id"), "label", "split")


@register("positional_split")
def q_positional_split(spark, sf_dir):
    return corp.positional_split(fx.by_language(spark, sf_dir)).select("corpus", "ord", "split")


@register("seeded_shuffle")
def q_seeded_shuffle(spark, sf_dir):
    train = all_examples(spark, sf_dir).where(F.col("split") == "train")
    return corp.seeded_shuffle(train, key="ord").select("corpus", "ord", "pos")


@register("ensure_validation")
def q_ensure_validation(spark, sf_dir):
    df = corp.positional_split(fx.by_language(spark, sf_dir))
    return corp.ensure_validation(df).select("corpus", "ord", "split")


@register("head_n")
def q_head_n(spark, sf_dir):
    return corp.head(fx.by_language(spark, sf_dir), 10).select("corpus", "ord", "label")


@register("split_sizes")
def q_split_sizes(spark, sf_dir):
    return corp.split_sizes(all_examples(spark, sf_dir))


@register("isolation_check")
def q_isolation_check(spark, sf_dir):
    ex = all_examples(spark, sf_dir)
    return corp.leakage(ex.where(F.col("split") == "train"), ex.where(F.col("split") == "test"))


# ---------------------------------------------------------------------------
# Metrics and scoring: O8, A5–A8, M1–M5, K7, P16
# ---------------------------------------------------------------------------


def predictions(spark, sf_dir):
    d = fx.labelled_with_logits(spark, sf_dir)
    return d.select("doc_id", "label", argmax("logits").alias("pred"),
                    argmax("logits_b").alias("pred_b"))


@register("argmax")
def q_argmax(spark, sf_dir):
    return predictions(spark, sf_dir).select("doc_id", "pred", "pred_b")


@register("id2label")
def q_id2label(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return p.select("doc_id", "pred", id2label("pred").alias("pred_label"),
                    label2id(id2label("pred")).alias("pred_back"))


@register("confusion")
def q_confusion(spark, sf_dir):
    return metrics.confusion(predictions(spark, sf_dir))


@register("accuracy")
def q_accuracy(spark, sf_dir):
    return metrics.accuracy(predictions(spark, sf_dir))


@register("macro_f1")
def q_macro_f1(spark, sf_dir):
    return metrics.macro_f1(predictions(spark, sf_dir)).select(F.round("macro_f1", 12).alias("macro_f1"))


@register("compare_models")
def q_compare_models(spark, sf_dir):
    c = metrics.compare_models(predictions(spark, sf_dir), a="pred", b="pred_b")
    # Sums over three classes: the last digit depends on their order.
    return c.withColumns({k: F.round(k, 12) for k in ("macro_f1_a", "macro_f1_b")})


@register("fix_length")
def q_fix_length(spark, sf_dir):
    t = with_fixed_tokens(fx.documents(spark, sf_dir).select("doc_id", "text"), mask="mask")
    return t.select("doc_id", F.size("tokens").alias("size"),
                    F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("n_real"),
                    F.get("tokens", 0).alias("first_token"), F.get("tokens", 127).alias("last_token"))


@register("map_batches")
def q_map_batches(spark, sf_dir):
    def count_chars(pdf):
        # Python len counts code points, like the reference's str handling.
        return pdf.assign(n_chars_py=pdf["text"].map(len).astype("int64"))[["doc_id", "n_chars_py"]]
    d = fx.documents(spark, sf_dir).select("doc_id", "text")
    return scoring.map_batches(d, count_chars, "doc_id long, n_chars_py long")


_MODEL_CACHE: dict = {}


def fitted_model(spark, sf_dir):
    """Fit once per (session, data dir): train on the train split, choose on
    the Hindi validation split."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODEL_CACHE:
        ex = all_examples(spark, sf_dir)
        model, report = scoring.fit_scorer(ex.where(F.col("split") == "train"),
                                           ex.where(F.col("split") == "validation"))
        _MODEL_CACHE[key] = (model, report)
    return _MODEL_CACHE[key]


@register("fit_scorer")
def q_fit_scorer(spark, sf_dir):
    """The grid and how many of its points were chosen (one)."""
    report = fitted_model(spark, sf_dir)[1]
    return report.select("reg_param", F.expr("count_if(chosen) OVER ()").alias("n_chosen"))


@register("evaluate_scorer")
def q_evaluate_scorer(spark, sf_dir):
    model, _ = fitted_model(spark, sf_dir)
    ex = all_examples(spark, sf_dir)
    m = scoring.evaluate(model, ex.where(F.col("split") == "test"))
    return m.select("n", ((F.col("accuracy") > 0.5) & (F.col("macro_f1") > 0) & (F.col("log_loss") > 0)).alias("sane"))


@register("score_messages")
def q_score_messages(spark, sf_dir):
    """Trim/length filter and dedup *before* the model, then decide."""
    model, _ = fitted_model(spark, sf_dir)
    firsts = deduped_document_messages(spark, sf_dir)
    scored = with_decision(scoring.score(firsts, model))
    return scored.select("scope", "id", "ord", F.col("pred").isin(0, 1).alias("scored"))


@register("scorer_roundtrip")
def q_scorer_roundtrip(spark, sf_dir):
    model, _ = fitted_model(spark, sf_dir)
    path = scratch_path(spark, "scorer")
    scoring.save_scorer(model, path)
    loaded = scoring.load_scorer(path)
    d = fx.documents(spark, sf_dir).select("doc_id", "text")
    a = scoring.score(d, model, keep=["doc_id"]).select("doc_id", F.col("pred").alias("pred_before"))
    b = scoring.score(d, loaded, keep=["doc_id"]).select("doc_id", F.col("pred").alias("pred_after"))
    return a.join(b, "doc_id").select("doc_id", (F.col("pred_before") == F.col("pred_after")).alias("same"))


# ---------------------------------------------------------------------------
# Reports, codecs, exports, store: P13, O6, K1–K6, P14, P15, J6, S8
# ---------------------------------------------------------------------------


@register("format_report")
def q_format_report(spark, sf_dir):
    f = rep.format_report(fx.evidence(spark, sf_dir))
    return f.select("seq", "banner_label", "banner_categories", "severity_badge", "score_pct",
                    "score_text", "time_display", "time_short", "source_display")


@register("number_incidents")
def q_number_incidents(spark, sf_dir):
    return rep.number_incidents(fx.evidence(spark, sf_dir)).select("seq", "incident_no")


@register("report_details")
def q_report_details(spark, sf_dir):
    d = rep.report_details(fx.evidence(spark, sf_dir))
    return d.select("incident_no", "evidence_id", "time_display", "source_display", "score_pct",
                    "score_text", "categories_display", "severity_badge", "text_display")


@register("report_summary")
def q_report_summary(spark, sf_dir):
    return rep.report_summary(fx.evidence(spark, sf_dir)).select("severity", "level", "n", "line")


@register("report_id")
def q_report_id(spark, sf_dir):
    """The report header; of the id its fixed part, and whether the tail is five base-36 digits."""
    h = rep.report_header(fx.evidence(spark, sf_dir), fx.NOW)
    return h.select("title", "generated_at", "total", F.regexp_extract("report_id", "^(.*-)", 1).alias("id_start"),
                    F.col("report_id").rlike("-[0-9A-Z]{5}$").alias("id_tail"))


@register("decode_attachment")
def q_decode_attachment(spark, sf_dir):
    a = fx.attachments(spark, sf_dir).withColumn("_d", codec.decode_attachment("screenshot"))
    return a.select("ord", F.col("_d.mime").alias("mime"), F.col("_d.n_bytes").alias("n_bytes"),
                    F.decode(F.col("_d.bytes"), "UTF-8").alias("decoded"))


@register("encrypt_roundtrip")
def q_encrypt_roundtrip(spark, sf_dir):
    key = codec.aes_key(spark, spark.conf.get("msgshield.evidence.key", None) or os.urandom(32))
    ev = fx.evidence(spark, sf_dir)
    enc = codec.encrypt_columns(ev, ["text", "source"], key).withColumn("encrypted", F.lit(True))
    dec = codec.decrypt_columns(enc.withColumn("_cipher", F.col("text")), ["text", "source"], key)
    return dec.join(ev.select("seq", F.col("text").alias("_plain")), "seq").select(
        "seq", "id", "text", "source", "encrypted",
        (F.col("_cipher") != F.col("_plain")).alias("cipher_differs"))


@register("export_json")
def q_export_json(spark, sf_dir):
    out = sink.export_json(fx.evidence(spark, sf_dir), scratch_path(spark, "export"), fx.NOW)
    back = spark.read.schema("id string, severity string, maxScore double, timestamp string, "
                             "timestampMs long").json(f"{out}/evidence")
    return back.select("id", "severity", F.col("maxScore").alias("max_score"), "timestamp",
                       F.col("timestampMs").alias("timestamp_ms"))


@register("export_csv")
def q_export_csv(spark, sf_dir):
    path = scratch_path(spark, "csv_export")
    sink.export_csv(fx.evidence(spark, sf_dir), path)
    return (spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
            .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
            .csv(path))


def _stored(spark, sf_dir):
    path = scratch_path(spark, "store")
    ev = fx.evidence(spark, sf_dir)
    sink.append_evidence(ev.where(F.col("seq") % 2 == 0), path)
    sink.append_evidence(ev.where(F.col("seq") % 2 == 1), path)
    return path


@register("append_evidence")
def q_append_evidence(spark, sf_dir):
    return read_evidence(spark, _stored(spark, sf_dir)).select("id", "seq", "severity")


@register("evidence_scan")
def q_evidence_scan(spark, sf_dir):
    present = read_evidence(spark, _stored(spark, sf_dir))
    missing = read_evidence(spark, scratch_path(spark, "no_store"))
    return present.unionByName(missing).select("id", "seq", "severity")


@register("clear_store")
def q_clear_store(spark, sf_dir):
    """Records before and after."""
    path = _stored(spark, sf_dir)
    before = read_evidence(spark, path).count()
    sink.clear_store(spark, path)
    return read_evidence(spark, path).agg(F.lit(before).cast("long").alias("before"), F.count(F.lit(1)).alias("after"))


@register("delete_stored")
def q_delete_stored(spark, sf_dir):
    """Records left by a deletion, as read under its tombstones and after they were folded."""
    path = _stored(spark, sf_dir)
    upkeep.delete_stored(spark, path, fx.delete_ids(spark, sf_dir), fx.NOW, "labelled-toxic")
    before = read_evidence(spark, path).select(F.lit("tombstones").alias("state"), "id", "seq").checkpoint()
    upkeep.fold_deletes(spark, path)
    return before.unionByName(read_evidence(spark, path).select(F.lit("folded").alias("state"), "id", "seq"))


@register("find_stored")
def q_find_stored(spark, sf_dir):
    """The store's first record of the smallest id of every severity."""
    path = _stored(spark, sf_dir)
    ids = read_evidence(spark, path).groupBy("severity").agg(F.min("id").alias("id")).collect()   # one per severity
    return upkeep.find_stored(spark, path, [r["id"] for r in ids]).select("id", "seq", "severity")


# ---------------------------------------------------------------------------
# Streaming: S7, T1–T5 (availableNow runs, compared with the batch oracle)
# ---------------------------------------------------------------------------


def _land_files(df, path):
    """Drop messages into a stream input folder as Parquet files: one per partition of ``df``, so their number
    grows with the input and no task takes more than its own part."""
    df.select("scope", "source", "text", "ord").write.mode("append").parquet(path)


def fixture_scorer(df):
    """Deterministic scorer with failures: status error where ord % 11 = 0."""
    failed = F.col("ord") % 11 == 0
    return fx.with_fixture_scores(df, key="ord").withColumns({
        "status": F.when(failed, F.lit("error")).otherwise(F.lit("ok")),
        "error": F.when(failed, F.lit("scorer unavailable"))})


@register("stream_source")
def q_stream_source(spark, sf_dir):
    inp, out, ck = (scratch_path(spark, n) for n in ("in", "out", "ck"))
    _land_files(fx.conversation_messages(spark, sf_dir), inp)
    s = st.read_message_stream(spark, inp)
    st.run_to_completion(s.writeStream.format("parquet").option("path", out)
                         .option("checkpointLocation", ck).outputMode("append"))
    return spark.read.parquet(out).select("scope", "source", "ord", "text")


@register("stream_dedup")
def q_stream_dedup(spark, sf_dir):
    inp, out, ck = (scratch_path(spark, n) for n in ("in", "out", "ck"))
    _land_files(fx.document_messages(spark, sf_dir), inp)
    s = st.stream_dedup(detect.filter_messages(st.read_message_stream(spark, inp)))
    st.run_to_completion(s.writeStream.format("parquet").option("path", out)
                         .option("checkpointLocation", ck).outputMode("append"))
    return spark.read.parquet(out).select("scope", "id")


def flaky_scorer(df):
    """Fails a message's first attempt where ord % 11 = 0; the next succeeds."""
    failed = (F.col("ord") % 11 == 0) & (F.col("attempt") == 1)
    return fx.with_fixture_scores(df, key="ord").withColumns({
        "status": F.when(failed, F.lit("error")).otherwise(F.lit("ok")),
        "error": F.when(failed, F.lit("scorer unavailable"))})


@register("stream_retry")
def q_stream_retry(spark, sf_dir):
    inp, attempts, ck = (scratch_path(spark, n) for n in ("in", "attempts", "ck"))
    msgs = fx.document_messages(spark, sf_dir)
    handler = st.score_with_retry(attempts, flaky_scorer)
    for parity in (0, 1):        # two arrivals: even ords, then odd ords
        _land_files(msgs.where(F.col("ord") % 2 == parity), inp)
        s = st.read_message_stream(spark, inp)
        st.run_to_completion(s.writeStream.foreachBatch(handler).option("checkpointLocation", ck))
    return st.read_batches(spark, attempts, st.ATTEMPT).select("scope", "id", "ord", "status", "attempt")


def failing_first(messages: pd.DataFrame) -> pd.DataFrame:
    """A model that raises at the first attempt of ids whose first byte is a multiple of 11."""
    if any(a == 1 and int(i[:2], 16) % 11 == 0 for i, a in zip(messages["id"], messages["attempt"])):
        raise ConnectionError("scorer unavailable")
    return pd.DataFrame({S.ID2LABEL[i]: [1.0 / len(S.ID2LABEL)] * len(messages) for i in S.ID2LABEL})


@register("stream_timed_retry")
def q_stream_timed_retry(spark, sf_dir):
    """All messages arrive at once; those that fail come due by timer, with no further input."""
    inp, attempts, ck = (scratch_path(spark, n) for n in ("in", "attempts", "ck"))
    _land_files(fx.document_messages(spark, sf_dir), inp)
    rows = timed.score_with_timer(st.read_message_stream(spark, inp), lambda: failing_first, first_delay_ms=200)
    timed.run_until_drained(spark, rows.writeStream.outputMode("append").option("checkpointLocation", ck)
                            .foreachBatch(timed.attempts_sink(attempts)), attempts, period_ms=200)
    return st.read_batches(spark, attempts, st.ATTEMPT).select("scope", "id", "status", "attempt")


def _incident_stream(spark, inp):
    s = detect.filter_messages(st.read_message_stream(spark, inp))
    decided = with_decision(fx.with_fixture_scores(s, key="ord"))
    return ev_ops.stamp(ev_ops.build_evidence(decided, fx.NOW, seq="ord"), fx.NOW)


@register("stream_incidents")
def q_stream_incidents(spark, sf_dir):
    inp, logs, evid, ck = (scratch_path(spark, n) for n in ("in", "logs", "evidence", "ck"))
    _land_files(fx.document_messages(spark, sf_dir), inp)
    inc = _incident_stream(spark, inp)
    st.run_to_completion(inc.writeStream.foreachBatch(st.dual_write(logs, evid))
                         .option("checkpointLocation", ck))
    a = spark.read.parquet(logs).select(F.lit("incident_logs").alias("table"), "id", "seq", "severity")
    b = spark.read.parquet(evid).select(F.lit("evidence").alias("table"), "id", "seq", "severity")
    return a.unionByName(b)


@register("stream_stats")
def q_stream_stats(spark, sf_dir):
    inp, out, ck = (scratch_path(spark, n) for n in ("in", "out", "ck"))
    _land_files(fx.document_messages(spark, sf_dir), inp)
    counts = st.stream_stats(_incident_stream(spark, inp))
    st.run_to_completion(counts.writeStream.outputMode("complete")
                         .foreachBatch(st.overwrite_sink(out)).option("checkpointLocation", ck))
    return spark.read.parquet(out).select("severity", "n")


@register("stream_store_stats")
def q_stream_store_stats(spark, sf_dir):
    out, ck = scratch_path(spark, "out"), scratch_path(spark, "ck")
    records = spark.readStream.schema(STORED).option("maxFilesPerTrigger", 4).parquet(_stored(spark, sf_dir))
    live = st.stream_store_stats(records, fields=STRING_FIELDS)
    st.run_to_completion(live.writeStream.outputMode("update").foreachBatch(st.overwrite_sink(out)).option("checkpointLocation", ck))
    return spark.read.parquet(out).withColumns({"oldest": _ms("oldest"), "newest": _ms("newest")})


# ---------------------------------------------------------------------------
# Extraction: S6 (rows-only: no HTML parser in the oracle engine)
# ---------------------------------------------------------------------------

FIXTURE_RULES = html_src.REFERENCE_RULES + ("article p",)


@register("extract_messages")
def q_extract_messages(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    return html_src.extract_messages(pages, FIXTURE_RULES)


@register("extract_counts")
def q_extract_counts(spark, sf_dir):
    """Elements found per page by a rule that SQL can state: one per ``<article`` tag."""
    pages = read_table(spark, sf_dir, "pages")
    found = html_src.extract_messages(pages, ("article",))
    return found.groupBy("page_id", "source").agg(F.count(F.lit(1)).alias("n"))


@register("extract_lateral")
def q_extract_lateral(spark, sf_dir):
    """Extraction as a table function of SQL, counted like ``extract_counts``."""
    html_src.register_udtf(spark, "extract_articles", ("article",))
    pages = read_table(spark, sf_dir, "pages")
    found = spark.sql("SELECT p.page_id, p.url FROM {pages} p, LATERAL extract_articles(p.html) m", pages=pages)
    return found.groupBy("page_id", html_src.url_host(F.col("url")).alias("source")).agg(F.count(F.lit(1)).alias("n"))

"""Properties from the survey: dedup idempotent, split disjoint/covering,
shuffle a partition-independent permutation, crypto round trip, custody grows."""

import os

from pyspark.sql import functions as F

from msgshield.functions import codec
from msgshield.operators import corpus as corp
from msgshield.operators.detect import dedup_first, filter_messages
from msgshield.operators.index import global_index
from msgshield.operators.metrics import compare_models
from msgshield.operators.stats import severity_counts
from msgshield.plans import catalog as C
from msgshield.plans import fixtures as fx

from conftest import SF_SMALL


def test_dedup_idempotent(spark):
    m = filter_messages(fx.document_messages(spark, SF_SMALL))
    once = dedup_first(m)
    twice = dedup_first(once)
    assert sorted(once.select("scope", "id", "ord").collect()) == \
        sorted(twice.select("scope", "id", "ord").collect())


def test_positional_split_sizes(spark):
    ex = C.extra_examples(spark, SF_SMALL)
    sp = corp.positional_split(ex)
    n = {r.corpus: r["count"] for r in ex.groupBy("corpus").count().collect()}
    tr = {r.corpus: r["count"] for r in sp.where("split = 'train'").groupBy("corpus").count().collect()}
    assert sp.count() == ex.count()
    for c, k in n.items():
        assert tr.get(c, 0) == int(0.9 * k)
    # train rows are exactly the first positions
    for c in n:
        rows = sp.where(F.col("corpus") == c).orderBy("ord").collect()
        flags = [r.split for r in rows]
        assert flags == sorted(flags, key=lambda s: s != "train")


def test_global_index_independent_of_partitioning(spark):
    df = fx.documents(spark, SF_SMALL).select("doc_id")
    a = global_index(df.repartition(3), [corp.shuffle_key("doc_id"), F.col("doc_id")], index_col="p")
    b = global_index(df.repartition(11), [corp.shuffle_key("doc_id"), F.col("doc_id")], index_col="p")
    ra = sorted((r.doc_id, r.p) for r in a.collect())
    assert ra == sorted((r.doc_id, r.p) for r in b.collect())
    assert sorted(p for _, p in ra) == list(range(df.count()))


def test_encrypt_roundtrip_identity(spark):
    key = os.urandom(32)
    ev = fx.evidence(spark, SF_SMALL).select("seq", "text", "source")
    enc = codec.encrypt_columns(ev, ["text", "source"], key)
    assert enc.join(ev.withColumnRenamed("text", "t0"), ["seq"]).where("text = t0").count() == 0
    dec = codec.decrypt_columns(enc, ["text", "source"], key)
    assert sorted(dec.collect()) == sorted(ev.collect())
    same = codec.encrypt_columns(ev, ["text"], key, enabled=False)
    assert sorted(same.collect()) == sorted(ev.collect())


def test_severity_counts_sum_to_total(spark):
    r = severity_counts(fx.evidence(spark, SF_SMALL)).first()
    assert r.high + r.medium + r.low + r.unknown == r.total


def test_custody_only_grows(spark):
    logs = fx.evidence(spark, SF_SMALL)
    from msgshield.operators.evidence import merge_attachments
    upd, versions, status = merge_attachments(logs, fx.attachments(spark, SF_SMALL), fx.NOW)
    before = {r.seq: r.n for r in logs.select("seq", F.size("chain_of_custody").alias("n")).collect()}
    after = {r.seq: r.n for r in upd.select("seq", F.size("chain_of_custody").alias("n")).collect()}
    assert set(before) == set(after)
    assert all(after[s] >= before[s] for s in before)
    assert upd.count() == logs.count()


def test_compare_same_model_delta_zero(spark):
    p = C.predictions(spark, SF_SMALL)
    r = compare_models(p, a="pred", b="pred").first()
    assert r.accuracy_delta == 0.0 and r.macro_f1_a == r.macro_f1_b


def test_key_not_in_plan(spark):
    key = b"K" * 16 + os.urandom(16)
    ev = fx.evidence(spark, SF_SMALL).select("seq", "text")
    enc = codec.encrypt_columns(ev, ["text"], key)
    qe = enc._jdf.queryExecution()
    text = qe.toString() + qe.executedPlan().toString()
    assert key.hex() not in text.lower() and "KKKKKKKKKKKKKKKK" not in text
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text
    dec = codec.decrypt_columns(enc, ["text"], key)
    assert sorted(dec.collect()) == sorted(ev.collect())

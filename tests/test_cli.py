"""The command line end to end on the fixture tables: prepare → train →
evaluate → detect → review."""

import os

from pyspark.sql import functions as F

from msgshield import cli
from msgshield.plans import fixtures as fx
from msgshield.sources.corpus import write_labelled_csv

SF = "/root/testdata/sf0.01"


def test_cli_end_to_end(spark, tmp_dir):
    raw = fx.hindi_raw(spark, SF)
    srcs = []
    for name in ("hindi_train", "hindi_val", "hindi_test"):
        p = os.path.join(tmp_dir, name)
        write_labelled_csv(raw.where(F.col("source_name") == name).select("comment_text", "label", "ord"), p)
        srcs += ["--source", f"{name}={p}"]
    eng, hin = os.path.join(tmp_dir, "eng"), os.path.join(tmp_dir, "hin")
    fx.english_raw(spark, SF).write.parquet(eng)
    fx.hinglish_raw(spark, SF).write.parquet(hin)
    corpus, model = os.path.join(tmp_dir, "corpus"), os.path.join(tmp_dir, "model")
    cli.main(["prepare", *srcs, "--english", eng, "--hinglish", hin, "--out", corpus], spark)
    assert spark.read.parquet(f"{corpus}/examples").count() == 399
    cli.main(["train", "--examples", f"{corpus}/examples", "--model", model], spark)
    m = cli.main(["evaluate", "--examples", f"{corpus}/examples", "--model", model], spark)
    assert m["n"] == 42 and 0.0 <= m["accuracy"] <= 1.0
    msgs = os.path.join(tmp_dir, "msgs")
    fx.document_messages(spark, SF).write.parquet(msgs)
    store = os.path.join(tmp_dir, "store")
    cli.main(["detect", "--messages", msgs, "--model", model, "--store", store,
              "--now", "2024-06-01T00:00:00Z"], spark)
    out = cli.main(["review", "--store", store, "--out", os.path.join(tmp_dir, "rev"),
                    "--now", "2024-06-01T00:00:00Z"], spark)
    n = spark.read.parquet(store).count()
    assert spark.read.parquet(f"{out['report']}/details").count() == n

"""Command line for the common jobs (submit with spark-submit or run locally).

  prepare   labelled CSV sources (+ English / Hinglish tables) → examples, report, leakage, sizes
  train     examples → fitted scorer (chosen on the validation split) + fit report
  evaluate  examples + scorer → hold-out metrics
  detect    messages table + scorer → evidence records appended to the store
  live      message files as they land + scorer → incident log and evidence store
  review    store → statistics, report tables, JSON export

Tables are Parquet folders. Example:
  python -m msgshield.cli prepare --source hindi_train=/data/train.csv --source hindi_test=/data/test.csv \\
      --english /data/english --out /data/corpus
"""

from __future__ import annotations

import argparse
import datetime as _dt
import json

from pyspark.sql import SparkSession, functions as F

from .operators import scoring
from .plans.detection import detect_batch
from .plans.review import review_store
from .plans.training import prepare_corpus
from .streaming.stream import live_detection


def _now(s):
    return s or _dt.datetime.now(_dt.timezone.utc).isoformat()


def main(argv=None, spark: SparkSession | None = None) -> dict:
    ap = argparse.ArgumentParser(prog="msgshield")
    sub = ap.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("prepare")
    p.add_argument("--source", action="append", required=True, help="name=csv_path, e.g. hindi_train=...")
    p.add_argument("--english")
    p.add_argument("--hinglish")
    p.add_argument("--train-path", action="store_true",
                   help="training data path (all extra rows to train, carve validation)")
    p.add_argument("--out", required=True)
    t = sub.add_parser("train")
    t.add_argument("--examples", required=True)
    t.add_argument("--model", required=True)
    e = sub.add_parser("evaluate")
    e.add_argument("--examples", required=True)
    e.add_argument("--model", required=True)
    d = sub.add_parser("detect")
    d.add_argument("--messages", required=True)
    d.add_argument("--model", required=True)
    d.add_argument("--store", required=True)
    d.add_argument("--now")
    v = sub.add_parser("live")
    v.add_argument("--input", required=True, help="folder that message files land in")
    v.add_argument("--model", required=True)
    v.add_argument("--out", required=True, help="root of attempts, incident_logs and evidence")
    v.add_argument("--checkpoint", required=True)
    v.add_argument("--available-now", action="store_true", help="drain what is there and stop")
    r = sub.add_parser("review")
    r.add_argument("--store", required=True)
    r.add_argument("--out", required=True)
    r.add_argument("--now")
    a = ap.parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"msgshield-{a.cmd}").getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")

    if a.cmd == "prepare":
        specs = [tuple(x.split("=", 1)) for x in a.source]
        res = prepare_corpus(spark, specs, a.english, a.hinglish, hold_out=not a.train_path)
        for k in ("examples", "report", "leakage", "sizes"):
            res[k].write.mode("overwrite").parquet(f"{a.out}/{k}")
        return {"out": a.out}
    if a.cmd == "train":
        ex = spark.read.parquet(a.examples)
        model, report = scoring.fit_scorer(ex.where(F.col("split") == "train"),
                                           ex.where(F.col("split") == "validation"))
        scoring.save_scorer(model, a.model)
        report.write.mode("overwrite").parquet(f"{a.model}_fit_report")
        return {"model": a.model}
    if a.cmd == "evaluate":
        ex = spark.read.parquet(a.examples)
        m = scoring.evaluate(scoring.load_scorer(a.model), ex.where(F.col("split") == "test")).first()
        out = m.asDict()
        print(json.dumps(out))
        return out
    if a.cmd == "detect":
        model = scoring.load_scorer(a.model)
        detect_batch(spark.read.parquet(a.messages), model, _now(a.now), store_path=a.store)
        return {"store": a.store}
    if a.cmd == "live":
        query = live_detection(spark, a.input, scoring.stream_scorer(scoring.load_scorer(a.model)), a.out, None,
                               a.checkpoint, available_now=a.available_now)
        if not a.available_now:
            query.awaitTermination()
        return {"evidence": f"{a.out}/evidence"}
    res = review_store(spark, a.store, a.out, _now(a.now))
    return {"report": res["report"], "export": res["export"]}


if __name__ == "__main__":
    main()

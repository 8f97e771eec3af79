"""Model path: train/choose/evaluate in one call, both scorer kinds, MLlib
cross-check of accuracy, long-form severity counts, page messages."""

import pandas as pd
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from msgshield.operators import scoring
from msgshield.operators.metrics import accuracy
from msgshield.operators.stats import severity_counts_long
from msgshield.plans import catalog as C
from msgshield.plans import fixtures as fx
from msgshield.plans.training import train_and_evaluate
from msgshield.sources.html import page_messages

from conftest import SF_SMALL


def multiclass_check(pred):
    """MLlib's accuracy, to cross-check A6."""
    ev = MulticlassClassificationEvaluator(labelCol="label", predictionCol="pred", metricName="accuracy")
    return ev.evaluate(pred.withColumn("label", F.col("label").cast("double"))
                           .withColumn("pred", F.col("pred").cast("double")))


def test_train_and_evaluate_and_both_scorers(spark):
    ex = C.all_examples(spark, "/root/testdata/sf0.01")
    model, report, metrics = train_and_evaluate(ex, grid=({"regParam": 0.1},))
    assert report.count() == 1 and report.first().chosen
    m = metrics.first()
    assert m.n == ex.where("split = 'test'").count() and 0.0 <= m.accuracy <= 1.0
    docs = fx.documents(spark, SF_SMALL).select("doc_id", "text")
    a = scoring.score_any(docs, model)

    def factory():
        return lambda texts: pd.DataFrame({"abusive": [0.9] * len(texts),
                                           "non-abusive": [0.1] * len(texts)})
    b = scoring.score_any(docs, factory)
    assert a.count() == b.count() == docs.count()
    assert {r.pred for r in b.select("pred").collect()} == {0}
    pred = scoring.score(ex.where("split = 'test'"), model).select("label", "pred")
    assert abs(accuracy(pred).first().accuracy - multiclass_check(pred)) < 1e-12


def test_severity_counts_long_zero_filled(spark):
    rows = {r.severity: r.n for r in severity_counts_long(fx.evidence(spark, SF_SMALL)).collect()}
    assert set(rows) == {"HIGH", "MEDIUM", "LOW", "UNKNOWN"} and rows["LOW"] == 0
    assert sum(rows.values()) == fx.evidence(spark, SF_SMALL).count()


def test_page_messages_filtered_and_ordered(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    m = page_messages(pages, C.FIXTURE_RULES)
    rows = m.collect()
    assert rows and all(len(r.text.encode("utf-16-be")) // 2 >= 5 for r in rows)
    assert m.select("scope", "ord").distinct().count() == len(rows)
    assert set(m.columns) == {"scope", "source", "text", "ord"}

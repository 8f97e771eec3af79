"""Classification metrics (A5–A8) over (label, prediction) columns.

Rows are reduced to a ``classes x classes`` count table first (partial
aggregation, one tiny shuffle); every metric is then computed on that table,
whose size does not grow with the data. Classes are always the observed
ones, so a label outside the expected set counts everywhere alike.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, functions as F


def pair_counts(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")) \
             .agg(F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, label: str = "label", pred: str = "pred", classes=(0, 1)) -> DataFrame:
    """Counts per (label, prediction) pair (A5): every pair of ``classes``, unobserved
    ones as 0, and every other pair that occurs, so no row is left out."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b, 0) for a, b in itertools.product(classes, classes)],
                                 "label int, pred int, n long")
    return (pair_counts(df, label, pred).unionByName(grid)
            .groupBy("label", "pred").agg(F.sum("n").alias("n")))


def accuracy(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Share of rows with prediction == label."""
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def class_counts(counts: DataFrame, by=(), extra=()) -> DataFrame:
    """``(by, cls, tp, fp, fn)`` from pair counts in one grouped pass, for every class seen
    in labels or predictions. ``extra`` columns are summed with the label's side."""
    n, zero = F.col("n"), F.lit(0).cast("long")
    hit = F.col("label").eqNullSafe(F.col("pred"))

    def side(cls, tp, fp, fn, own):
        return F.struct(F.col(cls).alias("cls"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"),
                        *[(F.col(c) if own else F.lit(0.0)).alias(c) for c in extra])

    both = F.array(side("label", F.when(hit, n).otherwise(zero), zero, F.when(hit, zero).otherwise(n), True),
                   side("pred", zero, F.when(hit, zero).otherwise(n), zero, False))
    return (counts.select(*by, F.explode(both).alias("s")).select(*by, "s.*").groupBy(*by, "cls")
                  .agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", *extra)]))


def _f1() -> F.Column:
    den = F.lit(2) * F.col("tp") + F.col("fp") + F.col("fn")
    return F.when(den == 0, F.lit(0.0)).otherwise((F.lit(2) * F.col("tp")).cast("double") / den.cast("double"))


def per_class_f1(counts: DataFrame) -> DataFrame:
    """F1 per class seen in labels or predictions: ``2tp / (2tp + fp + fn)``,
    0 when the denominator is 0."""
    return class_counts(counts).select("cls", _f1().alias("f1"))


def summarise(counts: DataFrame, by=(), extra=()) -> DataFrame:
    """``(by, n, accuracy, macro_f1)`` from pair counts; classes are those observed.
    A class's true positives and false negatives add up to its rows, so one pass
    gives all three."""
    rows = F.sum(F.col("tp") + F.col("fn"))
    return class_counts(counts, by, extra).groupBy(*by).agg(
        F.coalesce(rows, F.lit(0)).alias("n"), (F.sum("tp").cast("double") / rows.cast("double")).alias("accuracy"),
        (F.sum(_f1()) / F.count(F.lit(1))).alias("macro_f1"),
        *[(F.sum(c) / rows.cast("double")).alias(c) for c in extra])


def macro_f1(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Unweighted mean of per-class F1 over classes in label ∪ prediction."""
    return summarise(pair_counts(df, label, pred)).select("macro_f1")


def compare_models(df: DataFrame, a: str = "pred_a", b: str = "pred_b",
                   label: str = "label") -> DataFrame:
    """Accuracy and macro F1 of two prediction columns on the same rows, and
    the accuracy difference (second − first) (A8).

    The two columns are unpivoted so both models share one pass and one
    grouped aggregate; a model's classes are those in its labels and
    predictions, as in A7.
    """
    long = df.select(F.col(label).alias("label"), a, b).unpivot(["label"], [a, b], "model", "pred")
    counts = long.groupBy("model", "label", "pred").agg(F.count(F.lit(1)).alias("n"))
    wide = summarise(counts, by=["model"]).agg(
        F.max(F.when(F.col("model") == a, F.col("accuracy"))).alias("accuracy_a"),
        F.max(F.when(F.col("model") == a, F.col("macro_f1"))).alias("macro_f1_a"),
        F.max(F.when(F.col("model") == b, F.col("accuracy"))).alias("accuracy_b"),
        F.max(F.when(F.col("model") == b, F.col("macro_f1"))).alias("macro_f1_b"))
    return wide.withColumn("accuracy_delta", F.col("accuracy_b") - F.col("accuracy_a"))

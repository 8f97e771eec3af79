"""Corpus → model → metrics as one call each.

``prepare_corpus`` reproduces both of the reference's data paths:
``hold_out=True`` (evaluation: 90/10 positional split of the extra corpora,
their 10 % joins the test split only if a test split loaded) and
``hold_out=False`` (training: all extra rows go to train; a missing
validation split is carved out of train).
"""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import corpus as corp
from ..operators import scoring
from ..sources import corpus as src

log = logging.getLogger(__name__)


def _extra(spark: SparkSession, given, normalise, corpus: str, order: str) -> DataFrame | None:
    """An extra corpus from a frame or a Parquet path; one that is missing or lacks
    its columns is reported and left out, like a main source that fails."""
    if given is None:
        return None
    try:
        df = spark.read.parquet(given) if isinstance(given, str) else given
        return normalise(df).withColumn("corpus", F.lit(corpus)).select("text", "label", "corpus", order)
    except AnalysisException as e:
        log.warning("corpus %s is left out: %s", corpus, e.getCondition())
        return None


def prepare_corpus(spark: SparkSession, specs, english: DataFrame | str | None = None,
                   hinglish: DataFrame | str | None = None, hold_out: bool = True,
                   carve_validation: bool | None = None, order: str = "ord") -> dict:
    """Returns ``{examples, report, leakage, sizes}``.

    ``specs``: ``(source_name, csv_path)`` pairs of the main corpus (split by
    name). ``english``: frame or path with ``tweet, class``; ``hinglish``: with
    ``tweet, label``; both need an ``order`` column giving source order, and one that
    cannot be read is left out.
    ``examples`` has ``text, label, corpus, split, ord, pos`` where ``pos``
    is the row's place in the seeded shuffle of its split.
    """
    main, report = src.load_corpora(spark, specs)
    main = main.withColumn(order, F.col(order).cast("long")).select(
        "text", "label", "corpus", "split", order)
    has_test = main.where(F.col("split") == "test").limit(1).count() > 0
    extras = [_extra(spark, english, corp.normalize_english, "english", order),
              _extra(spark, hinglish, corp.normalize_hinglish, "hinglish", order)]
    extras = [e for e in extras if e is not None]
    parts = [main]
    if extras:
        extra = corp.concat_corpora(*extras)
        if hold_out:
            extra = corp.positional_split(extra, order=order)
            if not has_test:
                extra = extra.where(F.col("split") == "train")
        else:
            extra = extra.withColumn("split", F.lit("train"))
        parts.append(extra)
    examples = corp.concat_corpora(*parts)
    carve = (not hold_out) if carve_validation is None else carve_validation
    if carve:
        examples = corp.ensure_validation(examples, key=order)
    examples = corp.seeded_shuffle(examples.withColumn("_k", F.concat_ws(":", "corpus", order)),
                                   key="_k").drop("_k")
    train = examples.where(F.col("split") == "train")
    test = examples.where(F.col("split") == "test")
    return {"examples": examples, "report": report, "leakage": corp.leakage(train, test),
            "sizes": corp.split_sizes(examples)}


def train_and_evaluate(examples: DataFrame, grid=scoring.DEFAULT_GRID):
    """Fit on train, choose on validation, evaluate on test:
    ``(model, fit_report, test_metrics)``."""
    model, fit_report = scoring.fit_scorer(examples.where(F.col("split") == "train"),
                                           examples.where(F.col("split") == "validation"), grid)
    metrics = scoring.evaluate(model, examples.where(F.col("split") == "test"))
    return model, fit_report, metrics

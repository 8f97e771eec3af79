"""Threshold + severity decision over a score list.

Pure higher-order expressions (filter / transform / aggregate) so the decision
runs inside whole-stage codegen next to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import schemas as S
from .labels import is_abusive_label


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _abusive(x, abusive, safe) -> Column:
    return is_abusive_label(x["label"], abusive, safe)


def flagging_scores(scores, threshold=S.FLAG_THRESHOLD, abusive=S.ABUSIVE_LABELS,
                    safe=S.SAFE_LABELS) -> Column:
    """Scores that flag: abusive label and score >= threshold (NaN/null never flag)."""
    return F.filter(_c(scores), lambda x: _abusive(x, abusive, safe)
                    & x["score"].isNotNull() & ~F.isnan(x["score"])
                    & (x["score"] >= F.lit(threshold)))


def abusive_sum(scores, abusive=S.ABUSIVE_LABELS, safe=S.SAFE_LABELS) -> Column:
    """Sum of scores carrying an abusive label (P9); null scores add 0."""
    return F.aggregate(F.filter(_c(scores), lambda x: _abusive(x, abusive, safe)),
                       F.lit(0.0), lambda acc, x: acc + F.coalesce(x["score"], F.lit(0.0)))


def decide(scores, threshold=S.FLAG_THRESHOLD, high=S.HIGH_THRESHOLD,
           abusive=S.ABUSIVE_LABELS, safe=S.SAFE_LABELS,
           category=S.CATEGORY_NAME) -> Column:
    """Decision struct ``{is_toxic, categories, max_score, severity, all_scores}``.

    Flag if any abusive score >= threshold; ``max_score`` is the max over the
    flagging scores (0.0 otherwise); HIGH if it is > high (strict), else
    MEDIUM; severity null when not flagged. ``categories`` holds one struct
    when flagged and is empty otherwise.
    """
    s = _c(scores)
    flag = flagging_scores(s, threshold, abusive, safe)
    is_toxic = F.coalesce(F.size(flag) > 0, F.lit(False))
    max_score = F.coalesce(F.array_max(F.transform(flag, lambda x: x["score"])), F.lit(0.0))
    severity = F.when(is_toxic, F.when(max_score > F.lit(high), F.lit("HIGH"))
                      .otherwise(F.lit("MEDIUM")))
    categories = F.when(is_toxic, F.array(F.struct(
        F.lit(category).alias("category"), max_score.alias("score"),
        severity.alias("severity")))).otherwise(F.array().cast(S.CATEGORIES))
    return F.struct(is_toxic.alias("is_toxic"), categories.alias("categories"),
                    max_score.alias("max_score"), severity.alias("severity"),
                    s.alias("all_scores"))


def with_decision(df, scores="scores", out="decision", **kw):
    """Add the decision struct and flatten its fields next to the input."""
    d = decide(scores, **kw)
    return (df.withColumn(out, d)
              .withColumns({"is_toxic": F.col(f"{out}.is_toxic"),
                            "categories": F.col(f"{out}.categories"),
                            "max_score": F.col(f"{out}.max_score"),
                            "severity": F.col(f"{out}.severity"),
                            "all_scores": F.col(f"{out}.all_scores")})
              .drop(out))

"""Counterfactual-regularised toxicity classifier.

A logistic regression over word and word-prefix features. For each labelled text
that names an identity group, a counterfactual text is made in which every identity
term is swapped for another of its group, and the squared change of the score (log odds)
is penalised, so that a group's name alone does not move a score. Identity
terms are always features, else the penalty would have nothing to hold.

Fitting: at most ``SAMPLE_ROWS`` labelled rows, drawn by a seeded hash over all
labels, are used (documents that repeat a drawn id count as well; the driver holds
at most twice as many). Features are counted on the cluster; those
whose association with the label is significant (G test, ``LEAST_G``) are kept, ``MAX_FEATURES`` at
most, so the model's size is bounded and can be broadcast. Scoring is one pass
over whole texts without a shuffle.

Defined results: null text is scored as an empty text (the model's prior); rows without
an id count as held out; labels that are null or have no document are not
learned from; if there is no label to learn from, every score is 0.5; repeated rows
score alike. Id, language, source and labels are not features.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import prepare, written

SAMPLE_ROWS = 30_000
MAX_FEATURES = 20_000
LEAST_G = 12.0             # chance of an unrelated feature: about 1 in 2,000
PREFIXES = (3, 4, 5, 6)
FOLDS = 5
RIDGE = 1e-4
SWAP_PENALTY = 1.0
STEPS = 400
THRESHOLD = 0.5
SEED = 11
_CACHE = 500_000           # words a worker remembers the features of
_TRIM = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum()) + "¡¿«»„“”‘’…–—"

# Identity terms by group, English, German, French and Spanish (fixed values).
IDENTITY_GROUPS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("woman", "man", "girl", "boy"),
    ("women", "men", "girls", "boys"),
    ("black", "white", "asian", "african", "european", "latino", "arab"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("deaf", "blind", "disabled", "autistic"),
    ("frau", "mann", "mädchen", "junge"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("femme", "homme", "fille", "garçon"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("mujer", "hombre", "niña", "niño"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
)
_GROUPS_OF = {t: [g for g in IDENTITY_GROUPS if t in g] for group in IDENTITY_GROUPS for t in group}


def plain(word: str) -> str:
    """A word in lower case without marks at its ends."""
    return word.lower().strip(_TRIM)


def features_of(word: str) -> list[str]:
    """A plain word and its prefixes (marked ``*``)."""
    return [word] + [word[:n] + "*" for n in PREFIXES if len(word) > n] if word else []


def swapped(words: set[str], rng: random.Random) -> set[str] | None:
    """The words with every identity term swapped within its group, a term of several groups (of several
    languages or numbers) within one drawn; None if there is none."""
    found = words & _GROUPS_OF.keys()
    if not found:
        return None
    return (words - found) | {rng.choice([o for o in rng.choice(_GROUPS_OF[t]) if o != t]) for t in sorted(found)}


def _words(text: str | None) -> set[str]:
    return {p for p in map(plain, set((text or "").split())) if p}


def _all_features(words) -> set[str]:
    return {f for w in words for f in features_of(w)}


@dataclass
class ToxicityModel:
    bias: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)
    _seen: dict[str, tuple] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"bias": self.bias, "weights": self.weights, "_seen": {}}

    def _hits(self, token: str) -> tuple:
        hits = self._seen.get(token)
        if hits is None:
            if len(self._seen) > _CACHE:
                self._seen.clear()
            hits = self._seen[token] = tuple(f for f in features_of(plain(token)) if f in self.weights)
        return hits

    def score(self, text: str | None) -> float:
        hits = {f for t in set((text or "").split()) for f in self._hits(t)}
        z = self.bias + math.fsum(self.weights[f] for f in hits)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def held_out(doc_id, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """``(text, toxic)`` of the drawn labelled rows; only their ids are broadcast."""
    drawn = (labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
                   .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
                   .orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(rows))
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "toxic")


def _count_features(sample: DataFrame) -> DataFrame:
    """``(feature, docs, toxic)``: how many texts hold a feature, and how many toxic ones."""
    def batches(it):
        for batch in it:
            seen, bad = Counter(), Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = _all_features(_words(text))
                found.add("")                      # counts the texts themselves
                seen.update(found)
                if toxic:
                    bad.update(found)
            names = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array([seen[n] for n in names], pa.int64()),
                 pa.array([bad[n] for n in names], pa.int64())], ["feature", "docs", "toxic"])

    return (sample.select("text", "toxic").mapInArrow(batches, "feature string, docs long, toxic long")
                  .groupBy("feature").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic")))


def _choose(counts: DataFrame, max_features: int, least_g: float) -> list[str]:
    total = counts.where("feature = ''").first()
    if total is None:
        return []
    n, bad = total["docs"], total["toxic"]
    hits, others = F.col("toxic"), F.col("docs") - F.col("toxic")

    def cell(seen, row, column):
        """One cell's part of the G statistic, 2 x observed x ln(observed / expected)."""
        return F.when(seen > 0, 2 * seen * F.log(seen * F.lit(float(n)) / (row * column))).otherwise(F.lit(0.0))

    absent = F.lit(n) - F.col("docs")
    g = (cell(hits, F.col("docs"), F.lit(float(bad))) + cell(others, F.col("docs"), F.lit(float(n - bad)))
         + cell(F.lit(bad) - hits, absent, F.lit(float(bad))) + cell(F.lit(n - bad) - others, absent, F.lit(float(n - bad))))
    top = (counts.where("feature <> ''").withColumn("g", g).where(F.col("g") >= least_g)
                 .orderBy(F.desc("g"), "feature").limit(max_features))
    return [r["feature"] for r in top.select("feature").collect()]


def _encode(sample: DataFrame, vocabulary: dict[str, int]) -> list:
    """The sample as feature numbers, each with its counterfactual (or null)."""
    def batches(it):
        for batch in it:
            own, other = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _words(text)
                swap = swapped(words, random.Random(f"{SEED}:{i}"))
                own.append(sorted(vocabulary[f] for f in _all_features(words) if f in vocabulary))
                other.append(None if swap is None else
                             sorted(vocabulary[f] for f in _all_features(swap) if f in vocabulary))
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array(own, pa.list_(pa.int32())), pa.array(other, pa.list_(pa.int32()))],
                ["toxic", "own", "other"])

    rows = sample.select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    return rows.mapInArrow(batches, "toxic int, own array<int>, other array<int>")


def fit_weights(own: list, toxic, other: list, size: int, ridge: float = RIDGE,
                swap_penalty: float = SWAP_PENALTY, steps: int = STEPS) -> tuple[float, np.ndarray]:
    """Minimise mean log loss + ridge + swap_penalty x mean squared change under swaps (Adam)."""
    y = np.asarray(toxic, np.float64)

    def sparse(lists):
        counts = np.array([len(x) for x in lists], np.int64)
        cols = np.concatenate([np.asarray(x, np.int64) for x in lists]) if counts.sum() else np.zeros(0, np.int64)
        return np.repeat(np.arange(len(lists)), counts), cols

    rows, cols = sparse(own)
    pairs = [i for i, o in enumerate(other) if o is not None]
    rows_a, cols_a = sparse([own[i] for i in pairs])
    rows_b, cols_b = sparse([other[i] for i in pairs])
    w = np.zeros(size + 1)
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.bincount(rows, w[cols], len(y)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / len(y)
        grad = np.append(np.bincount(cols, error[rows], size) + 2 * ridge * w[:-1], error.sum())
        if pairs:
            change = (np.bincount(rows_a, w[cols_a], len(pairs)) - np.bincount(rows_b, w[cols_b], len(pairs)))
            pull = 2 * swap_penalty * change / len(pairs)
            grad[:-1] += np.bincount(cols_a, pull[rows_a], size) - np.bincount(cols_b, pull[rows_b], size)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return float(w[-1]), w[:-1]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, max_features: int = MAX_FEATURES,
        least_g: float = LEAST_G, **options) -> ToxicityModel:
    """Learn from labelled rows that are not held out."""
    prepare(docs.sparkSession)
    sample = written(_sample(docs, labels, rows), "toxicity-sample")
    names = _choose(_count_features(sample), max_features, least_g)
    names += sorted(_GROUPS_OF.keys() - set(names))      # whole terms: their prefixes open ordinary words
    encoded = _encode(sample, {f: i for i, f in enumerate(names)}).limit(2 * rows).collect()
    if not encoded:
        return ToxicityModel()
    bias, w = fit_weights([r["own"] for r in encoded], [r["toxic"] for r in encoded],
                          [r["other"] for r in encoded], len(names), **options)
    return ToxicityModel(bias, {f: float(x) for f, x in zip(names, w) if x})


def with_score(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """Add the score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return docs.withColumn(out, score(F.col(text)))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents the classifier does not reject."""
    return with_score(docs, fit(docs, labels), out="_score").where(F.col("_score") < THRESHOLD).drop("_score")

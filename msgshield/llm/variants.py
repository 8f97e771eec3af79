"""Spelling variants: words one edit apart, through an index of variable-length grams (VGRAM).

Words are padded at both ends. A gram starts at every place; it has two characters, and one more
as long as the gram so far is frequent among the words (more than one ``GRAM_SHARE``-th of all
places) and shorter than ``MAX_GRAM``. So the dictionary is extended only where grams are frequent,
and it is fixed by its frequent grams alone: at most ``GRAM_SHARE`` per length whatever the number
of words, which bounds what the tasks receive.

A gram is settled by the characters it covers, so an edit of one character touches only grams that
cover its place. The largest number of grams over one place is a word's bound (its affected grams,
at most ``MAX_GRAM``); all others reappear in the other word, at the same place or one further. Ordered
by frequency, the first of them is therefore among the first bound + 1 grams of both words: only these
shortest lists are merged. A list is named by gram, place and length of word, a word looks up
its own length and the next one (same place and the one after), and pairs that meet are
verified. Words of five characters and more have two grams more than their bound, so no pair is missed.

A word's form is its nearest frequent word; forms are followed by pointer doubling. Counts
double at least with every step, so 63 steps and six rounds are enough.

Defined results: null text has no words; a null id counts as an empty one in the deletion rule; texts of
any length are taken whole; rows that repeat count again; ties between forms go to the smallest word in
code-point order; no rows (or no frequent words) give no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import prepare, written

LEAST_LENGTH, LEAST = 5, 3        # code points, occurrences
DELETE_EVERY = 97                 # of a document's words, one in so many loses a character
FORM_TIMES = 2                    # a form is so many times as frequent
MIN_GRAM, MAX_GRAM = 2, 4
GRAM_SHARE = 5000
_RUN = re.compile("[a-zÀ-ÿ]+")
_FLUSH = 1 << 18                  # distinct words held before they are passed on


def words_of(text: bytes) -> list[str]:
    """Runs of letters, A-Z lower-cased."""
    return _RUN.findall(text.lower().decode())


def after_deletions(words: list[str], doc_id, every: int = DELETE_EVERY) -> Counter:
    """Counts of a document's words once the chosen ones have lost a character."""
    start, out = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), Counter()
    for word, n in Counter(words).items():
        h = zlib.crc32(word.encode(), start)
        if h % every == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
        out[word] += n
    return out


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least: int = LEAST) -> DataFrame:
    """``(word, n)`` of the words that are long and frequent enough."""
    def batches(it):
        counts = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                              ["word", "n"])
        for batch in it:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                for word, n in after_deletions(words_of(text or b""), doc_id).items():
                    if len(word) >= least_length:
                        counts[word] += n
                if len(counts) > _FLUSH:
                    yield out()
                    counts = Counter()
        yield out()

    rows = docs.select("doc_id", "text").mapInArrow(batches, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _padded(word: str) -> str:
    return f"^{word}$"


def frequent_grams(words: DataFrame, gram_share: int = GRAM_SHARE) -> dict[str, int]:
    """Grams that start at more than one ``gram_share``-th of all places, with their counts."""
    def batches(it):
        for batch in it:
            padded = [_padded(w) for w in batch.column(0).to_pylist()]
            counts = Counter(chain.from_iterable(
                [p[i:i + q] for i in range(len(p) - q + 1)] for p in padded for q in range(MIN_GRAM, MAX_GRAM + 1)))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                             ["gram", "f"])

    places = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    counts = words.select("word").mapInArrow(batches, "gram string, f long").groupBy("gram").agg(F.sum("f").alias("f"))
    return {r.gram: r.f for r in counts.where(F.col("f") * gram_share > places).collect()}   # gram_share per length at most


def grams(padded: str, frequent: dict[str, int]) -> list[str]:
    """The gram at every place of a padded word."""
    out, end = [], len(padded)
    for at in range(end - MIN_GRAM + 1):
        stop = at + MIN_GRAM
        while stop < end and stop - at < MAX_GRAM and padded[at:stop] in frequent:
            stop += 1
        out.append(padded[at:stop])
    return out


def bound(of: list[str], length: int) -> int:
    """Most grams that one edit of a word with ``length`` characters touches."""
    covered = [0] * (length + 2)
    for at, gram in enumerate(of):
        for i in range(at, at + len(gram)):
            covered[i] += 1
    return max(covered[1:-1])


def short_lists(word: str, frequent: dict[str, int]) -> list[tuple[str, int]]:
    """``(gram, place)`` of the bound + 1 grams with the shortest lists."""
    of = grams(_padded(word), frequent)
    order = sorted((frequent.get(gram, 0), gram, at) for at, gram in enumerate(of))
    return [(gram, at) for _, gram, at in order[:bound(of, len(word)) + 1]]


def near_pairs(words: DataFrame, gram_share: int = GRAM_SHARE) -> DataFrame:
    """``(a, b)``: all pairs of words that differ by one edit, once, the shorter or smaller first."""
    spark = words.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_grams(words, gram_share))

    def batches(it):
        for batch in it:
            word, gram, place = [], [], []
            for w in batch.column(0).to_pylist():
                for g, at in short_lists(w, frequent.value):
                    word.append(w)
                    gram.append(g)
                    place.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(gram, pa.string()), pa.array(place, pa.int32())],
                                             ["word", "gram", "place"])

    lists = written(words.select("word").mapInArrow(batches, "word string, gram string, place int")
                         .withColumn("size", F.length("word")), "gram-lists")
    listed = lists.select(F.col("word").alias("b"), "gram", "place", "size")
    place, size = F.col("place"), F.col("size")
    looked = lists.select(F.col("word").alias("a"), "gram", F.explode(F.array(
        F.struct(place.alias("place"), size.alias("size")), F.struct(place.alias("place"), (size + 1).alias("size")),
        F.struct((place + 1).alias("place"), (size + 1).alias("size")))).alias("at")).select("a", "gram", "at.place", "at.size")
    met = looked.join(listed, ["gram", "place", "size"]).where(
        ((F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return written(met.select("a", "b").distinct(), "near-words")


def _followed(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of words that have a form."""
    steps = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = written(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                               F.col("next").isNotNull().alias("moved")), "roots")
        steps = jumped.select("word", "root")
        if not jumped.agg(F.max("moved")).first()[0]:
            return steps


def variant_groups(docs: DataFrame, least_length: int = LEAST_LENGTH, least: int = LEAST) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of the vocabulary."""
    prepare(docs.sparkSession)
    words = written(vocabulary(docs, least_length, least), "vocabulary")
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).union(pairs.select("b", "a"))
    near = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("m")), "near")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("at"))
    placed = words.join(best, "word", "left")
    m = -F.col("at.less")
    has = m >= FORM_TIMES * F.col("n")
    table = written(placed.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                  F.when(has, F.col("at.near")).alias("form"), F.when(has, m).alias("form_n")), "word-forms")
    roots = _followed(table.where("form is not null").select("word", "form"))
    return table.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

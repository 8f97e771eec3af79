"""Phrase collocations by set-oriented mining (SETM): occurrence relations and merge joins.

Pieces of text (between sentence marks and line ends) are lists of words. The relation of
occurrences ``R1(piece, pos, g1)`` of frequent words is written once, bucketed by piece and sorted
by (piece, pos). Phrases of k words extend those of k - 1:

- merge join: ``R(k-1)`` meets ``R1`` on the piece and the adjacent position; both are bucketed by
  piece and in order, so nothing is shuffled (``Rk`` holds the position after its last word);
- group count: occurrences per phrase, with map-side sums; ``least`` and more stay;
- semi-join: only occurrences of frequent phrases are written as ``Rk``, again sorted, and extended.
  Phrases are looked up in a bitmap of fixed size, so a few of others are extended as well; the next
  group count leaves none of them.

Words are named by numbers of their frequency table and phrases by those of their words, so
occurrences carry no text. The words' table is broadcast when a count and a byte sum show it to be
small (``BROADCAST_ROWS``, ``BROADCAST_BYTES``); beyond that the same join is shuffled. Everything is
counted per language, a word of two languages is two words.

Scores are exact: products are decimals of 38 digits (enough for counts up to 10 ** 16).

Defined results: null text is empty, null lang is ``und``, rows without an id or that repeat one
are texts of their own, pieces of any length are taken whole, ties in the score go by count and
then by phrase, an empty table gives no rows, columns besides text and lang are not looked at.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import scratch_path
from .common import cleaning_up, prepare, written

MAX_WORDS = 3
LEAST = 10                    # occurrences of a candidate
SHARE = 50                    # percent of a phrase's occurrences that a longer one may explain
TOP = 2000                    # phrases reported per language
BROADCAST_ROWS, BROADCAST_BYTES = 1 << 20, 1 << 25
BUCKET_ROWS = 1 << 21         # occurrences of a bucket
BITMAP_BITS, ROW_BITS = 1 << 26, 1 << 15   # of frequent phrases: 8 MiB whatever their number, in rows of 4 KiB
_OUT_ROWS = 1 << 17           # occurrences of an Arrow batch
_CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9)


def pieces_of(text: bytes) -> list[list[bytes]]:
    """Words of every piece of a UTF-8 text that has words."""
    return [words for piece in text.translate(_CLEAN).split(b"\n") if (words := piece.split())]


def word_counts(docs: DataFrame) -> DataFrame:
    """``(lang, word, n)``: occurrences of every word; summed per ``_OUT_ROWS`` distinct ones before the shuffle."""
    def batches(it):
        counts = defaultdict(Counter)

        def out():
            for lang, of in counts.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(of), pa.string()), pa.array(list(of), pa.binary()).cast(pa.string()),
                     pa.array(list(of.values()), pa.int64())], ["lang", "word", "n"])
            counts.clear()

        for batch in it:
            for text, lang in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                counts[lang].update(chain.from_iterable(pieces_of(text)))
            if sum(map(len, counts.values())) > _OUT_ROWS:
                yield from out()
        yield from out()

    rows = docs.mapInArrow(batches, "lang string, word string, n long")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def occurrences(docs: DataFrame) -> DataFrame:
    """``(lang, piece, pos, word)`` for every word of pieces of two words and more."""
    def batches(it):
        piece = TaskContext.get().partitionId() << 40          # the same again if the task is repeated
        for batch in it:
            words, sizes, langs = [], [], []

            def out():
                n = np.array(sizes, np.int64)
                first = np.cumsum(n) - n
                return pa.RecordBatch.from_arrays(
                    [pa.array(langs, pa.string()).take(pa.array(np.repeat(np.arange(len(n)), n))),
                     pa.array(np.repeat(piece + np.arange(len(n)), n)),
                     pa.array((np.arange(n.sum()) - np.repeat(first, n)).astype(np.int32)),
                     pa.array(words, pa.binary()).cast(pa.string())], ["lang", "piece", "pos", "word"])

            for text, lang in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                for of in pieces_of(text):
                    if len(of) > 1:
                        words += of
                        sizes.append(len(of))
                        langs.append(lang)
                if len(words) > _OUT_ROWS:
                    yield out()
                    piece += len(sizes)
                    words, sizes, langs = [], [], []
            if words:
                yield out()
                piece += len(sizes)

    return docs.mapInArrow(batches, "lang string, piece long, pos int, word string")


def _small(df: DataFrame, bytes_of=None) -> DataFrame:
    """Marked for broadcast if its rows (and bytes) are counted to be few."""
    n, size = df.agg(F.count(F.lit(1)), F.sum(bytes_of) if bytes_of is not None else F.lit(0)).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


class _Relations:
    """Sorted occurrence relations: tables of the shared folder, bucketed by piece."""

    def __init__(self, spark, buckets: int):
        self.spark, self.buckets, self.names = spark, buckets, []
        self.run = uuid.uuid4().hex[:12]

    def write(self, df: DataFrame, k: int) -> DataFrame:
        name = f"occurrences_{self.run}_{k}"
        self.names.append(name)
        with cleaning_up(self.spark):
            (df.write.format("parquet").option("path", scratch_path(self.spark, name)).bucketBy(self.buckets, "piece")
               .sortBy("piece", "pos").saveAsTable(name))
        return self.spark.table(name)

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _extended(longer: DataFrame, words: DataFrame, k: int) -> DataFrame:
    """``(piece, pos, g1, ..., gk)``: phrases of ``k - 1`` words, whose ``pos`` is the one after their last word, with
    the word that is there; ``pos`` moves on."""
    a, b = longer.alias("a"), words.alias("b").hint("merge")
    return a.join(b, (F.col("a.piece") == F.col("b.piece")) & (F.col("a.pos") == F.col("b.pos"))).select(
        "a.piece", (F.col("a.pos") + 1).alias("pos"), *[f"a.g{i}" for i in range(1, k)], F.col("b.g1").alias(f"g{k}"))


def _may_be_in(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Semi-join by a bitmap of fixed size, which is broadcast: all rows whose keys are in ``table``, and a few others
    (a fuller bitmap lets more through, never fewer)."""
    def at(rows):
        slot = F.pmod(F.xxhash64(*keys), F.lit(BITMAP_BITS))
        return rows.withColumn("_slot", slot).withColumn("_row", F.shiftright("_slot", ROW_BITS.bit_length() - 1).cast("int"))

    long = F.pmod(F.shiftright("_slot", 6), F.lit(ROW_BITS // 64)).cast("int")
    bit = F.expr("cast(_slot & 63 as int)")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    none = df.sparkSession.range(BITMAP_BITS // 64).select(
        F.floor(F.col("id") / (ROW_BITS // 64)).cast("int").alias("_row"), (F.col("id") % (ROW_BITS // 64)).cast("int").alias("i"), F.lit(0).cast("long").alias("x"))
    longs = at(table).select("_row", long.alias("i"), one.alias("x")).union(none).groupBy("_row", "i").agg(F.bit_or("x").alias("x"))
    # A list holds the longs of one row: ROW_BITS / 64.
    bits = longs.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("l")).select("_row", F.col("l")["x"].alias("_bits"))
    found = F.call_function("shiftrightunsigned", F.get("_bits", long), bit).bitwiseAND(F.lit(1).cast("long")) == 1
    return at(df).join(F.broadcast(written(bits, "frequent-bits")), "_row").where(found).select(*df.columns)


def frequent_phrases(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST) -> tuple[list[DataFrame], DataFrame]:
    """Tables ``(lang, words, f)`` of frequent phrases of 1, 2, ... words, and ``(lang, n)``."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    counts = written(word_counts(docs), "words")
    total = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    words = written(counts.where(F.col("n") >= least).select(
        F.monotonically_increasing_id().alias("g1"), "lang", "word", F.col("n").alias("f")), "frequent-words")
    levels = [words.select("g1", "lang", F.array("word").alias("words"), "f")]

    n = counts.agg(F.sum("n")).first()[0] or 0
    rel = _Relations(spark, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET_ROWS)))
    # Bucketed by piece, joined on (piece, pos); a bucket of one file is read in the order in which it was written.
    settings = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}
    whole = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        known = _small(words.select("lang", "word", "g1"), F.octet_length("lang") + F.octet_length("word"))
        first = occurrences(docs).join(known, ["lang", "word"]).select("piece", "pos", "g1")
        r1 = rel.write(first.repartition(rel.buckets, "piece"), 1)
        before = r1.withColumn("pos", F.col("pos") + 1)
        for k in range(2, max_words + 1):
            phrase = [f"g{i}" for i in range(1, k + 1)]
            grown = _extended(before, r1, k)
            table = written(grown.groupBy(*phrase).agg(F.count(F.lit(1)).alias("f")).where(F.col("f") >= least), "frequent-groups")
            last = words.select(F.col("g1").alias(phrase[-1]), "word")
            levels.append(written(table.join(levels[-1].select(*phrase[:-1], "lang", "words"), phrase[:-1]).join(last, phrase[-1]).select(
                *phrase, "lang", F.concat("words", F.array("word")).alias("words"), "f"), "frequent-phrases"))
            if k < max_words:
                before = rel.write(_may_be_in(grown, table, phrase), k)
    finally:
        for name, value in whole.items():
            spark.conf.set(name, value)
        rel.drop()
    return [level.select("lang", "words", "f") for level in levels], total


def _phrase(words) -> Column:
    return F.array_join(words, " ")


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, share: int = SHARE,
                 top: int | None = TOP) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's ``top`` phrases (all, if null).

    ``a`` is the phrase's count, ``l`` and ``r`` those of the two parts of its weakest cut and
    ``score`` floor(1000000 a a / (l r)) of that cut; phrases that a longer one explains are dropped.
    """
    levels, total = frequent_phrases(docs, max_words, least)
    parts = levels[0]
    for level in levels[1:-1]:
        parts = parts.unionByName(level)
    parts = parts.select("lang", _phrase("words").alias("part"), "f")
    found = levels[1]
    for level in levels[2:]:
        found = found.unionByName(level)
    size = F.size("words")

    longer = found.where(size > 2).select("lang", F.col("f").alias("longest"), F.explode(F.array(
        F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))).alias("inner"))
    explained = longer.groupBy("lang", _phrase("inner").alias("phrase")).agg(F.max("longest").alias("longest"))
    kept = (found.select("lang", _phrase("words").alias("phrase"), "words", F.col("f").alias("a"))
                 .join(explained, ["lang", "phrase"], "left")
                 .where(F.coalesce(100 * F.col("longest") < share * F.col("a"), F.lit(True))))

    cuts = kept.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", _phrase(F.slice("words", F.lit(1), F.col("cut"))).alias("head"),
        _phrase(F.slice("words", F.col("cut") + 1, size)).alias("tail"))
    head, tail = (parts.select("lang", F.col("part").alias(p), F.col("f").alias(f)) for p, f in (("head", "l"), ("tail", "r")))
    exact = "cast({} as decimal(19,0))".format
    scored = cuts.join(head, ["lang", "head"]).join(tail, ["lang", "tail"]).withColumn("score", F.expr(
        f"({exact('a')} * {exact('a')} * cast(1000000 as decimal(7,0))) div ({exact('l')} * {exact('r')})"))
    best = (scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r")).alias("at"), F.first("a").alias("a"))
                  .select("lang", "phrase", "a", "at.l", "at.r", "at.score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Mixing sources to target weights by capped water-filling.

Every source gets ``level x weight`` words, but never more than ``max_epochs``
times what it holds: sources that would exceed this are clamped, and what they
leave is shared among the rest by weight, until no source is above its cap.
A source's target then becomes whole repetitions of all its documents plus one
seeded fractional repetition.

The fractional repetition takes documents in the order of a seeded hash while they
fit into the words still missing; further passes fill what is left with
documents that still fit. A hash bucket narrows every running sum to a fraction of
a source, so no source is ever in one task.

Defined results: null text has size 0; null source is a source of its own, last in
order; rows that agree in id, source and size are one unit and get the
same number of copies; sources without words get target 0 and no copies; empty input gives
no rows. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.index import global_index
from .common import DOCUMENT_COLUMNS, WORD, prepare, written

WEIGHT_CYCLE = (5, 2, 1)   # weights of the sources in code point order, repeating
MAX_EPOCHS = 3
BUCKETS = 4096             # hash buckets a source's documents are spread over
PASSES = 4
SEED = "mix-1"


def _source_key(c: Column) -> Column:
    """Never null, so joins and groups need no null handling."""
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), c))


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, skey, size)``: words per document, narrow and written once."""
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return written(docs.select("doc_id", "source", n.alias("size"))
                       .withColumn("skey", _source_key(F.col("source"))), "mix-sizes")


def cyclic_weights(sources: DataFrame, cycle=WEIGHT_CYCLE) -> DataFrame:
    """Weights by the sources' position in code point order, null last."""
    pos = global_index(sources.withColumn("_null", F.col("source").isNull()), ["_null", "skey"])
    weights = F.array(*[F.lit(int(w)) for w in cycle])
    return pos.withColumn("weight", F.element_at(weights, (F.col("idx") % len(cycle) + 1).cast("int"))
                          ).drop("idx", "_null")


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS, total: int | None = None) -> DataFrame:
    """Add ``target`` to ``(.., source_size, weight)``.

    Each round is one distributed aggregate; only the sums come to the driver. The
    level rises from round to round, so a clamped source stays clamped, and the
    loop ends when a round clamps nothing new.
    """
    cap = F.col("source_size") * F.lit(max_epochs)
    if total is None:
        total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, -1
    while True:
        under = cap < F.lit(level) * F.col("weight")
        n, held, free = sources.agg(F.count_if(under), F.sum(F.when(under, cap)),
                                    F.sum(F.when(~under, F.col("weight")))).first()
        if n == clamped or not free:
            break
        clamped, level = n, (total - (held or 0)) / free
    return sources.withColumn("target", F.when(cap < F.lit(level) * F.col("weight"), cap.cast("double"))
                              .otherwise(F.lit(level) * F.col("weight")))


def _take_while_fits(units: DataFrame, room: DataFrame) -> DataFrame:
    """Flag units, in seeded order, while their running size fits the source's ``room``."""
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = (units.groupBy("skey", "bucket").agg(F.sum("words").alias("_s")).join(room, "skey")
                 .withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0)))
                 .select("skey", "bucket", "_before", "room"))
    inside = (Window.partitionBy("skey", "bucket").orderBy("h", "doc_id", "size")
                    .rowsBetween(Window.unboundedPreceding, 0))
    return (units.join(plan, ["skey", "bucket"])
                 .withColumn("fits", (F.col("room") > 0)      # a source without room takes no empty documents either
                             & (F.col("_before") + F.sum("words").over(inside) <= F.col("room")))
                 .drop("_before", "room"))


def copies(sizes: DataFrame, sources: DataFrame, seed: str = SEED, passes: int = PASSES) -> DataFrame:
    """``(doc_id, skey, size, copies)`` per unit from sources with ``target``."""
    full = F.when(F.col("source_size") > 0,
                  F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = written(sources.withColumn("whole", full.cast("long"))
                   .withColumn("room", F.floor("target").cast("long") - F.col("whole") * F.col("source_size")),
                   "mix-plan")
    h = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
              .cast("binary"))
    units = (sizes.groupBy("doc_id", "skey", "size").agg(F.count(F.lit(1)).alias("rows"))
                  .withColumn("words", F.col("size") * F.col("rows")).withColumn("h", h)
                  .withColumn("bucket", F.conv(F.substring("h", 1, 3), 16, 10).cast("int") % BUCKETS))
    room = plan.select("skey", "room")
    taken = None
    for _ in range(passes):
        flagged = written(_take_while_fits(units, room), "mix-pass")
        won = flagged.where("fits")
        taken = won.drop("fits") if taken is None else taken.union(won.drop("fits"))
        used = won.groupBy("skey").agg(F.sum("words").alias("_u"))
        room = written(room.join(used, "skey", "left").select(
            "skey", (F.col("room") - F.coalesce("_u", F.lit(0))).alias("room")), "mix-room")
        units = (flagged.where("not fits").drop("fits").join(room, "skey")
                        .where("words <= room").drop("room"))
    extra = taken.select("doc_id", "skey", "size", F.lit(1).alias("_x"))
    base = sizes.select("doc_id", "skey", "size", F.lit(0).alias("_x")).distinct()
    return (base.union(extra).groupBy("doc_id", "skey", "size").agg(F.max("_x").alias("_x"))
                .join(plan.select("skey", "source_size", "target", "whole"), "skey")
                .withColumn("copies", F.col("whole") + F.col("_x")).drop("whole", "_x"))


def mix_plan(docs: DataFrame, cycle=WEIGHT_CYCLE, max_epochs: int = MAX_EPOCHS,
             total: int | None = None, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """``(sizes, units)``: every row's size, and the copies of every unit."""
    prepare(docs.sparkSession)
    sizes = sized(docs)
    sources = written(sizes.groupBy("source", "skey").agg(F.sum("size").alias("source_size")), "mix-src")
    return sizes, copies(sizes, water_fill(cyclic_weights(sources, cycle), max_epochs, total), seed)


def _with_copies(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Join rows holding ``doc_id, skey, size`` to their unit, null ids included."""
    keys = {"doc_id": "_id", "skey": "_key", "size": "_size"}
    return (rows.join(units.withColumnsRenamed(keys),
                      F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("skey") == F.col("_key"))
                      & (F.col("size") == F.col("_size"))).drop(*keys.values()))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: size, its source's size and target, words taken."""
    sizes, units = mix_plan(docs, **options)
    return _with_copies(sizes, units).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: documents, each as often as its copies say."""
    _, units = mix_plan(docs, **options)
    units = written(units.where("copies > 0").select("doc_id", "skey", "size", "copies"), "mix-units")
    keyed = (docs.select(*DOCUMENT_COLUMNS).withColumn("skey", _source_key(F.col("source")))
                 .withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")))
    return (_with_copies(keyed, units)
            .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select(*DOCUMENT_COLUMNS))

"""Document fingerprints: a threshold-scaled sketch of word shingles.

Every distinct shingle hash below a fixed fraction of the hash range is retained, so
a sketch grows with its document, sketches merge by union, and the share of one
sketch found in another estimates containment even between very unequal documents. A
document whose hashes all lie above the threshold keeps its smallest, so only a text
without words has an empty sketch. The hash is the first 15 hex digits of MD5, which SQL
engines share; the threshold is on the first digit.

Succession (each document's next by ascending id) needs neither a global window nor a
join of texts: ids are cut into ranges of about ``range_docs`` documents, each range gets
a copy of the next range's first document, and ``lead`` runs inside ranges, so a text
travels once. At most ``MAX_RANGES`` ids and range bounds are on the driver or broadcast.

Defined results: null text is empty; repeated ids follow each other in the order of
their texts' hash; rows without an id come in no order, so they have no next document
(their second half is replaced by nothing, ``near_next`` is 0); two empty sketches
are alike (1), an empty and a filled one are not (0); no rows give no rows. Only
DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import prepare, words_of

SHINGLE = 5
RETAIN = 4                 # hex digits 0 to 3 of 16: a quarter of all hashes
DIGITS = 15
RANGE_DOCS = 1000
MAX_RANGES = 10_000


def with_sketch(df: DataFrame, text: str, out: str, shingle: int = SHINGLE, retain: int = RETAIN) -> DataFrame:
    """Add ``out``: the sorted retained hashes of column ``text`` as longs."""
    n = F.size("_w")
    whole = F.array(F.concat_ws(" ", "_w"))
    many = F.transform(F.sequence(F.lit(1), n - (shingle - 1)),
                       lambda i: F.concat_ws(" ", F.slice("_w", i, shingle)))
    shingles = F.when(n == 0, F.array().cast("array<string>")).when(n <= shingle, whole).otherwise(many)
    limit = F.lit(format(retain, "x"))
    kept = F.filter("_h", lambda x: x < limit)
    return (df.withColumn("_w", words_of(F.col(text)))
              .withColumn("_h", F.transform(shingles, lambda s: F.md5(s.cast("binary"))))
              .withColumn("_k", kept)
              .withColumn("_k", F.when((F.size("_k") == 0) & (F.size("_h") > 0), F.array(F.array_min("_h")))
                          .otherwise(F.col("_k")))
              .withColumn(out, F.array_sort(F.array_distinct(F.transform(
                  "_k", lambda x: F.conv(F.substring(x, 1, DIGITS), 16, 10).cast("long")))))
              .drop("_w", "_h", "_k"))


def sketch_string(sketch) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.lpad(F.hex(x), DIGITS, "0"))), "")


def merge(a, b, retain: int = RETAIN) -> Column:
    """Sketch of the union of two documents' shingles: a text's least hash, kept where it has none
    below the threshold, goes where the other text has one."""
    digits = format(retain, "x")
    both = F.array_sort(F.array_union(a, b))
    below = F.filter(both, lambda x: x < F.lit(retain << 4 * (DIGITS - len(digits))))
    return F.when(F.size(below) > 0, below).otherwise(F.slice(both, 1, 1))


def containment(a, b) -> Column:
    """Estimated share of ``a``'s shingles that are in ``b``."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a, b) -> Column:
    """Estimated resemblance (shared over all shingles)."""
    both = F.size(F.array_intersect(a, b))
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
             .otherwise(both / (F.size(a) + F.size(b) - both)))


def _range_of(doc_id, bounds: list) -> Column:
    """How many bounds are at or below the id: a binary search in an array literal."""
    if not bounds:
        return F.lit(0)
    values = F.array(*[F.lit(b) for b in bounds])
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def halve(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = (s["lo"] < s["hi"]) & (F.get(values, mid) <= doc_id)
        return F.struct(F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"),
                        F.when(below, s["hi"]).otherwise(F.when(s["lo"] < s["hi"], mid).otherwise(s["hi"])).alias("hi"))

    return F.aggregate(steps, start, halve)["lo"]


def with_next(docs: DataFrame, range_docs: int = RANGE_DOCS, text: str = "text") -> DataFrame:
    """``(doc_id, text, sketch, next_text, next_sketch)``, ids ascending, the first after the last."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = rows.where("doc_id is not null")
    count = placed.count()
    ranges = max(1, min(MAX_RANGES, -(-count // range_docs)))
    probabilities = [i / ranges for i in range(1, ranges)]
    cuts = placed.approxQuantile("doc_id", probabilities, 1 / (10 * ranges)) if count and probabilities else []
    bounds = sorted({int(c) for c in cuts})
    bucket = _range_of(F.col("doc_id"), bounds).cast("int")
    lows = sorted((r[0], r[1]) for r in placed.groupBy(bucket.alias("b")).agg(F.min("doc_id")).collect())
    ghosts = [(low, lows[i - 1][0]) for i, (_, low) in enumerate(lows)]   # i - 1 wraps to the last range
    first = spark.createDataFrame(ghosts, "_low long, bucket int")
    both = (placed.withColumn("bucket", bucket).withColumn("ghost", F.lit(False))
            .unionByName(placed.join(F.broadcast(first), F.col("doc_id") == F.col("_low"))
                         .select("doc_id", "text", "bucket", F.lit(True).alias("ghost"))))
    order = Window.partitionBy("bucket").orderBy("ghost", "doc_id", F.xxhash64("text"), "text")
    followed = (with_sketch(both, "text", "sketch")
                .withColumn("next_text", F.lead("text").over(order))
                .withColumn("next_sketch", F.lead("sketch").over(order))
                .where("not ghost").drop("ghost", "bucket"))
    alone = (with_sketch(rows.where("doc_id is null"), "text", "sketch")
             .withColumn("next_text", F.lit(None).cast("string"))
             .withColumn("next_sketch", F.lit(None).cast("array<bigint>")))
    return followed.unionByName(alone)


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are."""
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half),
                      F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = with_sketch(with_next(docs).withColumn("edited", edited), "edited", "edited_sketch")
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        sketch_string("sketch").alias("fingerprint"),
        sketch_string("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"),
        F.coalesce(likeness("sketch", "next_sketch"), F.lit(0.0)).alias("near_next"))

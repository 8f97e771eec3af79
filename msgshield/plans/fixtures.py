"""Deterministic stand-ins for the reference's inputs, derived with Spark from
the given tables (see FIXTURES.md). Every frame here grows with the tables.

The same formulas are written in SQL in :mod:`msgshield.plans.oracle` so the
two engines can be compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.decision import with_decision
from ..functions.text import evidence_id
from ..operators.evidence import build_evidence, stamp
from ..session import read_table

# Fixed instants of the fixtures (UTC).
NOW = "2024-06-01T00:00:00Z"
BASE_MS = 1704067200000      # 2024-01-01 00:00:00 UTC
MINUTE_MS = 60000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def fixture_score(doc_id) -> F.Column:
    """s = (doc_id * 37 % 1000) / 1000 as DOUBLE."""
    return (doc_id * F.lit(37) % F.lit(1000)).cast("double") / F.lit(1000.0)


def fixture_label(doc_id) -> F.Column:
    m = doc_id % F.lit(5)
    return (F.when(m == 1, F.lit(" Abusive ")).when(m == 2, F.lit("label_0"))
             .when(m == 3, F.lit("label_1")).otherwise(F.lit("abusive")))


def with_fixture_scores(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add ``s, label_a, scores, logits, logits_b`` computed from ``key``."""
    k = F.col(key)
    s = fixture_score(k)
    return df.withColumns({
        "s": s,
        "label_a": fixture_label(k),
        "scores": F.array(
            F.struct(fixture_label(k).alias("label"), s.alias("score")),
            F.struct(F.lit("non-abusive").alias("label"), (F.lit(1.0) - s).alias("score"))),
        "logits": F.array(s, F.lit(1.0) - s),
        "logits_b": F.array(s - F.lit(0.05), F.lit(1.0) - s),
    })


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_fixture_scores(documents(spark, sf_dir))


def fixture_timestamp_ms(doc_id) -> F.Column:
    return F.lit(BASE_MS) + (doc_id * F.lit(7919) % F.lit(100000)) * F.lit(MINUTE_MS)


def evidence(spark: SparkSession, sf_dir: str, encrypted: bool = False) -> DataFrame:
    """Evidence store of the fixtures: every flagged document (not de-duplicated,
    so ids repeat where texts repeat), ``seq = doc_id``."""
    docs = with_decision(scored_documents(spark, sf_dir))
    docs = docs.withColumns({"_ts_ms": fixture_timestamp_ms(F.col("doc_id")),
                             "_ts": F.timestamp_millis(fixture_timestamp_ms(F.col("doc_id")))})
    ev = build_evidence(docs, NOW, text="text", source="source", seq="doc_id",
                        timestamp="_ts", timestamp_ms="_ts_ms")
    return stamp(ev, NOW, encrypted=encrypted)


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One screenshot per document (flagged or not); its payload is the whole text."""
    shot = F.concat(F.lit("data:image/png;base64,"), F.regexp_replace(F.base64(F.encode(F.col("text"), "UTF-8")), "[\r\n]", ""))
    return documents(spark, sf_dir).select(F.col("doc_id").alias("ord"), "text", shot.alias("screenshot"))


def lookup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids to look up: the SHA-256 of every text of documents and conversations."""
    texts = documents(spark, sf_dir).select("text").unionByName(
        read_table(spark, sf_dir, "conversations").select("text"))
    return texts.select(evidence_id(F.col("text")).alias("id"))


def delete_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids to delete: the SHA-256 of every text labelled toxic."""
    return _labelled(spark, sf_dir).where("toxic = 1").select(evidence_id(F.col("text")).alias("id"))


def document_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages from documents: ``scope = lang``, ``ord = doc_id``."""
    return documents(spark, sf_dir).select(
        F.col("lang").alias("scope"), F.col("source"), F.col("text"),
        F.col("doc_id").alias("ord"))


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages from conversations: ``scope = conv_id``, ``source = role``, ``ord = turn``."""
    return read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("scope"), F.col("role").alias("source"),
        F.col("text"), F.col("turn").alias("ord"), F.col("conv_id"))


def attempts_for(messages: DataFrame) -> DataFrame:
    """Scoring attempts of the fixtures: none yet for ``ord % 13 = 0``; status
    ``error`` where ``ord % 11 = 0``, else ``ok``."""
    return (messages.where(F.col("ord") % 13 != 0)
            .select("scope", "id", F.when(F.col("ord") % 11 == 0, F.lit("error"))
                    .otherwise(F.lit("ok")).alias("status")))


# ---------------------------------------------------------------------------
# Labelled corpora (FIXTURES §3): documents joined with labels, ord = doc_id.
# ---------------------------------------------------------------------------

def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels")
    return documents(spark, sf_dir).join(labels, "doc_id")


def hindi_split_name(doc_id) -> F.Column:
    m = doc_id % F.lit(10)
    return (F.when(m == 0, F.lit("hindi_test")).when(m == 1, F.lit("hindi_val"))
             .otherwise(F.lit("hindi_train")))


def messy_label(doc_id) -> F.Column:
    """The messy string column of the lenient cast."""
    m = doc_id % F.lit(5)
    return (F.when(m == 0, F.lit("1")).when(m == 1, F.lit("0")).when(m == 2, F.lit("x"))
             .when(m == 3, F.lit("1.9")).otherwise(F.lit(None).cast("string")))


def raw_corpus(spark: SparkSession, sf_dir: str, string_labels: bool = False) -> DataFrame:
    """A raw corpus of the whole table: ``comment_text, label, ord, source_name``.
    The messy labels go with every document, the numeric ones (1 - toxic) with
    every labelled document."""
    if string_labels:
        d, label = documents(spark, sf_dir), messy_label(F.col("doc_id"))
    else:
        d, label = _labelled(spark, sf_dir), (F.lit(1) - F.col("toxic")).cast("int")
    return d.select(F.col("text").alias("comment_text"), label.alias("label"),
                    F.col("doc_id").alias("ord"), hindi_split_name(F.col("doc_id")).alias("source_name"))


def by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled document, one corpus per language."""
    return _labelled(spark, sf_dir).select(
        "text", (F.lit(1) - F.col("toxic")).cast("int").alias("label"), F.col("lang").alias("corpus"),
        F.col("doc_id").alias("ord"))


def classes_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-class labels of every labelled document (toxic 0 → 2; toxic 1 → doc_id % 2)."""
    cls = F.when(F.col("toxic") == 0, F.lit(2)).otherwise((F.col("doc_id") % 2).cast("int"))
    return _labelled(spark, sf_dir).select(F.col("text").alias("tweet"), cls.cast("int").alias("class"),
                                           F.col("doc_id").alias("ord"))


def inverted_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverted labels (0 = non-hate) of every labelled document."""
    return _labelled(spark, sf_dir).select(F.col("text").alias("tweet"), F.col("toxic").cast("int").alias("label"),
                                           F.col("doc_id").alias("ord"))


def hindi_raw(spark: SparkSession, sf_dir: str, string_labels: bool = False) -> DataFrame:
    """Hindi stand-in (lang fr): ``comment_text, label`` (label = 1 - toxic), plus
    ``ord`` and the source name it would come from. With ``string_labels``
    the label is the messy string column used for the lenient cast."""
    d = _labelled(spark, sf_dir).where(F.col("lang") == "fr")
    label = messy_label(F.col("doc_id")) if string_labels else (F.lit(1) - F.col("toxic")).cast("int")
    return d.select(F.col("text").alias("comment_text"), label.alias("label"),
                    F.col("doc_id").alias("ord"), hindi_split_name(F.col("doc_id")).alias("source_name"))


def english_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English stand-in (lang en): ``tweet, class`` (toxic 0 → 2; toxic 1 → doc_id % 2)."""
    d = _labelled(spark, sf_dir).where(F.col("lang") == "en")
    cls = F.when(F.col("toxic") == 0, F.lit(2)).otherwise((F.col("doc_id") % 2).cast("int"))
    return d.select(F.col("text").alias("tweet"), cls.cast("int").alias("class"),
                    F.col("doc_id").alias("ord"))


def hinglish_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hinglish stand-in (lang es, de): ``tweet, label`` (label = toxic, inverted later)."""
    d = _labelled(spark, sf_dir).where(F.col("lang").isin("es", "de"))
    return d.select(F.col("text").alias("tweet"), F.col("toxic").cast("int").alias("label"),
                    F.col("doc_id").alias("ord"))


def labelled_with_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with true label ``1 - toxic`` (2, a class no model predicts, for
    clean ones of low quality) and both models' logits."""
    d = _labelled(spark, sf_dir)
    odd = (F.col("toxic") == 0) & (F.col("quality") == 0)
    return with_fixture_scores(d).select(
        "doc_id", F.when(odd, F.lit(2)).otherwise(F.lit(1) - F.col("toxic")).cast("int").alias("label"), "logits", "logits_b",
        "text", "lang")


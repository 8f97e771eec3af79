"""Evidence records: build (P11), stamp (P12), lookup / delete (J4, J5),
attachment merge (J7), current version (J8), orderings (O1, O2).

Records are append-only; ``seq`` carries the insertion order the reference
got from array position, ``revision`` counts re-saved versions of a record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import schemas as S
from ..functions.text import evidence_id
from ..functions.timeutil import ts_lit, to_millis
from .firsts import first_by, last_by
from .index import attach, positions


def _falsy_str(c):
    """JS ``x || fallback`` for strings: null and '' are falsy."""
    return F.when(c.isNull() | (c == ""), F.lit(None)).otherwise(c)


def _falsy_num(c):
    """JS ``x || fallback`` for numbers: null, NaN and 0 are falsy."""
    return F.when(c.isNull() | F.isnan(c) | (c == 0), F.lit(None)).otherwise(c)


def custody_event(action: str, ts, actor: str = S.SYSTEM_ACTOR):
    return F.struct(F.lit(action).alias("action"), ts.alias("timestamp"),
                    F.lit(actor).alias("actor"))


def build_evidence(decided: DataFrame, now, *, text: str = "text", source: str = "source",
                   seq: str = "seq", timestamp=None, timestamp_ms=None,
                   screenshot=None, flagged_only: bool = True) -> DataFrame:
    """One evidence record per flagged row.

    JS-falsy defaulting as the logger does it: severity null/'' → UNKNOWN,
    max score null/NaN/0 → 0, arrays → empty, screenshot '' → null; legacy
    ``score`` = max score, else an input ``score``, else 0; legacy ``label`` =
    first category name, else an input ``label``, else 'unknown'. The custody
    trail starts with one CREATED/SYSTEM event at the record time.
    ``timestamp`` / ``timestamp_ms`` default to ``now``.
    """
    df = decided.where(F.col("is_toxic")) if flagged_only else decided
    cols = set(df.columns)
    ts = F.col(timestamp) if isinstance(timestamp, str) else (timestamp if timestamp is not None
                                                              else ts_lit(now))
    ts_ms = (F.col(timestamp_ms) if isinstance(timestamp_ms, str) else timestamp_ms)
    ts_ms = F.coalesce(ts_ms, F.lit(to_millis(now))) if ts_ms is not None else F.lit(to_millis(now))
    shot = F.col(screenshot) if isinstance(screenshot, str) else (
        screenshot if screenshot is not None else F.lit(None).cast("string"))
    cats = F.coalesce(F.col("categories"), F.array().cast(S.CATEGORIES)) \
        if "categories" in cols else F.array().cast(S.CATEGORIES)
    scores = F.coalesce(F.col("all_scores"), F.array().cast(S.SCORES)) \
        if "all_scores" in cols else F.array().cast(S.SCORES)
    max_score = F.coalesce(_falsy_num(F.col("max_score")), F.lit(0.0)) \
        if "max_score" in cols else F.lit(0.0)
    in_score = _falsy_num(F.col("score")) if "score" in cols else F.lit(None).cast("double")
    in_label = _falsy_str(F.col("label")) if "label" in cols else F.lit(None).cast("string")
    severity = _falsy_str(F.col("severity")) if "severity" in cols else F.lit(None).cast("string")
    first_cat = _falsy_str(F.get(cats, 0)["category"])
    return df.select(
        evidence_id(F.col(text)).alias("id"),
        ts.cast("timestamp").alias("timestamp"),
        ts_ms.cast("long").alias("timestamp_ms"),
        F.col(source).cast("string").alias("source"),
        F.col(text).alias("text"),
        F.coalesce(severity, F.lit("UNKNOWN")).alias("severity"),
        max_score.cast("double").alias("max_score"),
        cats.alias("categories"),
        scores.alias("all_scores"),
        _falsy_str(shot).alias("screenshot"),
        F.array(custody_event(S.CREATED_ACTION, ts.cast("timestamp"))).alias("chain_of_custody"),
        F.coalesce(_falsy_num(max_score), in_score, F.lit(0.0)).cast("double").alias("score"),
        F.coalesce(first_cat, in_label, F.lit(S.UNKNOWN_LABEL)).alias("label"),
        F.col(seq).cast("long").alias("seq"),
        F.lit(0).alias("revision"),
    )


def stamp(df: DataFrame, now, encrypted: bool = False) -> DataFrame:
    """Provenance stamp: ``saved_at``, ``version`` and a truthful ``encrypted``
    flag (set by the caller from whether P15 ran, not a constant)."""
    return df.withColumns({"saved_at": ts_lit(now), "version": F.lit(S.EVIDENCE_VERSION),
                           "encrypted": F.lit(bool(encrypted))})


def store_order(df: DataFrame):
    """Insertion-order key of a store row (re-saved versions come after)."""
    return F.struct(F.col("revision"), F.col("seq"))


def lookup(evidence: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """First record (insertion order) per requested id, or nulls when absent.

    The store is first cut to requested ids (semi join; AQE broadcasts the id
    side when its measured size is under the threshold, else sort-merge),
    then reduced to one row per id with ``min_by`` (partial aggregation, so a
    hot id is pre-reduced on the map side), then outer-joined to the ids.
    """
    want = ids.select(F.col(id_col).alias("id")).distinct()
    hits = evidence.join(want, "id", "left_semi")
    first = first_by(hits, ["id"], store_order(hits))
    return (want.join(first, "id", "left")
                .withColumn("found", F.col("seq").isNotNull()))


def delete_ids(evidence: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Remove every record whose id is listed; absent ids are not an error."""
    return evidence.join(ids.select(F.col(id_col).alias("id")), "id", "left_anti")


def attachment_events(logs: DataFrame, attachments: DataFrame, now, text: str = "text",
                      screenshot: str = "screenshot", order: str = "ord"):
    """Attach screenshots to the first log row of each text, in linear form.

    Attachments match on the SHA-256 of their text. Only the first log row of an
    id (lowest ``seq``) is touched. Returns ``(first, versions, custody, status)``:

    - ``first``: one row per id with attachments: ``id, seq, n_att, last_shot``;
    - ``versions``: one new store version per attachment, revision j for the j-th,
      with its own screenshot and the record's original custody;
    - ``custody``: one SCREENSHOT_ADDED event per attachment, ``(id, seq,
      revision, action, timestamp, actor)``; version j's trail is its original one plus
      the events up to revision j (see :func:`nest_custody`);
    - ``status``: one row per attachment with ``matched``.

    Positions are taken over ``(id, order)`` only (skew-safe: the range sort spreads
    a hot id); screenshots join afterwards and never pass the sort.
    """
    att = attachments.select(F.col(order).alias("att_ord"), evidence_id(F.col(text)).alias("id"),
                             F.col(screenshot).alias("att_screenshot"))
    placed = positions(att, ["id", "att_ord"], keep=["id", "att_ord"], index_col="_g")
    starts = placed.groupBy("id").agg(F.min("_g").alias("_first"), F.count(F.lit(1)).alias("n_att"),
                                      F.max("att_ord").alias("_last"))
    numbered = (placed.join(starts.select("id", "_first"), "id")
                      .withColumn("revision", (F.col("_g") - F.col("_first") + 1).cast("int"))
                      .select("id", "att_ord", "revision"))
    first_log = first_by(logs.where(F.col("id").isNotNull()), ["id"], F.col("seq"))
    first_seq = first_log.select("id", "seq")
    shots = attach(att, numbered, ["id", "att_ord"], ["revision"])
    last = (starts.join(att.groupBy("id", F.col("att_ord").alias("_last")).agg(
                F.max("att_screenshot").alias("last_shot")), ["id", "_last"]).select("id", "n_att", "last_shot"))
    first = first_seq.join(last, "id")
    versions = (shots.join(first_log.drop("revision"), "id").withColumn("screenshot", F.col("att_screenshot"))
                     .drop("att_screenshot"))
    if "saved_at" in versions.columns:     # a re-save is stamped when it happens
        versions = versions.withColumn("saved_at", ts_lit(now))
    custody = numbered.join(first_seq, "id").select(
        "id", "seq", "revision", F.lit(S.SCREENSHOT_ACTION).alias("action"), ts_lit(now).alias("timestamp"),
        F.lit(S.SYSTEM_ACTOR).alias("actor"))
    status = numbered.join(first_seq, "id", "left").select(
        "att_ord", "id", "seq", F.col("seq").isNotNull().alias("matched"))
    return first, versions, custody, status


def nest_custody(records: DataFrame, custody: DataFrame) -> DataFrame:
    """Custody trails nested into records for export: every record gets its events up
    to its own revision. Output grows with the square of an id's attachments, so
    stores keep :func:`attachment_events`' rows instead."""
    events = custody.select("id", "seq", F.col("revision").alias("_r"),
                            F.struct("action", "timestamp", "actor").alias("_e"))
    key = ["id", "seq", "revision"]
    added = (records.select(*key).join(events, ["id", "seq"]).where(F.col("_r") <= F.col("revision"))
                    .groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_r", "_e"))).alias("_a")))
    return (records.join(added, key, "left")
                   .withColumn("chain_of_custody", F.when(F.col("_a").isNull(), F.col("chain_of_custody")).otherwise(
                       F.concat("chain_of_custody", F.transform("_a", lambda x: x["_e"]))))
                   .select(*records.columns))


def merge_attachments(logs: DataFrame, attachments: DataFrame, now, text: str = "text",
                      screenshot: str = "screenshot", order: str = "ord"):
    """The reference's nested form of :func:`attachment_events`.

    The first log row of each matched id gets the last attachment's screenshot and one
    event per attachment; every attachment appends a new version of that record.
    Returns ``(logs_updated, new_versions, status)``.
    """
    first, versions, custody, status = attachment_events(logs, attachments, now, text, screenshot, order)
    event = custody_event(S.SCREENSHOT_ACTION, ts_lit(now))
    updated = (logs.join(first, ["id", "seq"], "left")
                   .withColumn("screenshot", F.when(F.col("n_att").isNull(), F.col("screenshot")).otherwise(F.col("last_shot")))
                   .withColumn("chain_of_custody", F.when(F.col("n_att").isNull(), F.col("chain_of_custody")).otherwise(
                       F.concat("chain_of_custody", F.array_repeat(event, F.col("n_att").cast("int")))))
                   .select(*logs.columns))
    return updated, nest_custody(versions, custody).select(*versions.columns), status


def current_evidence(evidence: DataFrame) -> DataFrame:
    """Newest version per id (insertion order: revision, then seq)."""
    return last_by(evidence, ["id"], store_order(evidence))


def newest_first(df: DataFrame, index_col: str = "pos") -> DataFrame:
    """Newest timestamp first, ties in insertion order; ``pos`` = display row."""
    keys = ["revision", "seq"]
    order = [F.col("timestamp").desc(), F.col("revision").asc(), F.col("seq").asc()]
    return attach(df, positions(df, order, keep=keys, index_col=index_col), keys, [index_col])


def latest_log(df: DataFrame, index_col: str = "pos") -> DataFrame:
    """Reverse insertion order; ``pos`` = display row."""
    keys = ["revision", "seq"]
    order = [F.col("revision").desc(), F.col("seq").desc()]
    return attach(df, positions(df, order, keep=keys, index_col=index_col), keys, [index_col])

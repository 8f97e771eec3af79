"""Batch detection over a table of messages: the live path for backfills.

messages → trim/length filter → first occurrence per scope → score (MLlib
model or pandas scorer factory) → decision → evidence records (stamped),
optionally appended to the store. The filter and dedup run before the model,
so the scorer only sees distinct, long-enough texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..functions.decision import with_decision
from ..operators.detect import dedup_first, filter_messages
from ..operators.evidence import build_evidence, stamp
from ..operators.scoring import score_any
from ..operators.sequence import allocate, numbered
from ..sinks.export import append_evidence


def detect_batch(messages: DataFrame, scorer, now, store_path: str | None = None,
                 **decide_kw) -> DataFrame:
    """Evidence records for the flagged messages of ``messages``
    (``scope, source, text, ord``). With ``store_path`` they are also appended
    to the evidence store, numbered after what it holds. ``decide_kw`` overrides threshold / label sets."""
    firsts = dedup_first(filter_messages(messages))
    flagged = with_decision(score_any(firsts, scorer), **decide_kw).where("is_toxic").checkpoint(eager=True)
    first = allocate(flagged.sparkSession, f"{store_path}__sequence", -1 - (uuid.uuid4().int >> 66), flagged.count()) if store_path else 0
    records = stamp(build_evidence(numbered(flagged, ["ord"], ["scope", "id"], first), now), now)
    if store_path:
        append_evidence(records, store_path)
    return records

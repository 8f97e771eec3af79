"""SQL fragments shared by the oracle queries (DuckDB dialect).

They restate the fixture formulas and the reference's rules independently of
the DataFrame code, so a mismatch shows a real difference.
"""

from __future__ import annotations

from .. import schemas as S

# JS whitespace set as a SQL string expression built from code points.
WS = "(" + " || ".join(f"chr({ord(c)})" for c in S.JS_WHITESPACE) + ")"


def js_trim(x: str) -> str:
    return f"trim({x}, {WS})"


def utf16_len(x: str) -> str:
    return (f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))")


def score(k: str) -> str:
    return f"(CAST(({k}) * 37 % 1000 AS DOUBLE) / 1000)"


def label_a(k: str) -> str:
    return (f"(CASE ({k}) % 5 WHEN 1 THEN ' Abusive ' WHEN 2 THEN 'label_0' "
            f"WHEN 3 THEN 'label_1' ELSE 'abusive' END)")


def abusive(label: str) -> str:
    return f"(lower({js_trim(label)}) = 'abusive')"


def flagged(k: str) -> str:
    """Fixture decision: the first score entry flags; 'non-abusive' never does."""
    return f"({abusive(label_a(k))} AND {score(k)} >= {S.FLAG_THRESHOLD})"


def max_score(k: str) -> str:
    return f"(CASE WHEN {flagged(k)} THEN {score(k)} ELSE 0.0 END)"


def severity(k: str) -> str:
    return (f"(CASE WHEN NOT {flagged(k)} THEN NULL WHEN {score(k)} > {S.HIGH_THRESHOLD} "
            f"THEN 'HIGH' ELSE 'MEDIUM' END)")


def ts_ms(k: str) -> str:
    return f"(1704067200000 + (({k}) * 7919 % 100000) * 60000)"


NOW_MS = 1717200000000   # 2024-06-01 00:00:00 UTC

# Messages from documents after P5 (trim + length filter).
DOC_MESSAGES = f"""
  doc_msgs AS (
    SELECT lang AS scope, source, {js_trim('text')} AS text, doc_id AS ord FROM documents
  ),
  doc_kept AS (
    SELECT * FROM doc_msgs WHERE text IS NOT NULL AND {utf16_len('text')} >= {S.MIN_MESSAGE_UNITS}
  ),
  doc_first AS (
    SELECT scope, sha256(text) AS id, min(ord) AS ord FROM doc_kept GROUP BY scope, sha256(text)
  )"""

# Evidence fixture: all flagged documents, seq = doc_id.
EVIDENCE = f"""
  ev AS (
    SELECT sha256(text) AS id, doc_id AS seq, source, text,
           {severity('doc_id')} AS severity, {max_score('doc_id')} AS max_score,
           {ts_ms('doc_id')} AS ts_ms, 0 AS revision
    FROM documents WHERE {flagged('doc_id')}
  )"""

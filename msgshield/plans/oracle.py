"""DuckDB twins of the registered queries (same column names and types)."""

from __future__ import annotations

from .. import schemas as S
from .sqlfrag import (DOC_MESSAGES, EVIDENCE, NOW_MS, WS, abusive, flagged, js_trim, label_a,
                      max_score, score, severity, utf16_len)

ORACLE: dict = {}

ORACLE["severity_counts"] = f"""
WITH {DOC_MESSAGES},
  sev AS (SELECT {severity('ord')} AS severity FROM doc_first WHERE {flagged('ord')})
SELECT count(*) FILTER (WHERE severity = 'HIGH') AS high,
       count(*) FILTER (WHERE severity = 'MEDIUM') AS medium,
       count(*) FILTER (WHERE severity = 'LOW') AS low,
       count(*) FILTER (WHERE severity NOT IN ('HIGH','MEDIUM','LOW') OR severity IS NULL) AS unknown,
       count(*) AS total
FROM sev"""

ORACLE["filter_messages"] = f"""
WITH m AS (SELECT conv_id, turn AS ord, {js_trim('text')} AS text FROM conversations)
SELECT conv_id, ord, text, {utf16_len('text')} AS n_units FROM m
WHERE text IS NOT NULL AND {utf16_len('text')} >= {S.MIN_MESSAGE_UNITS}"""

ORACLE["dedup_first"] = f"""
WITH {DOC_MESSAGES}
SELECT f.scope, f.id, f.ord, k.source
FROM doc_first f JOIN doc_kept k ON k.scope = f.scope AND k.ord = f.ord"""

ORACLE["retry_pending"] = f"""
WITH {DOC_MESSAGES}
SELECT scope, id, ord FROM doc_first WHERE ord % 13 = 0 OR ord % 11 = 0"""

ORACLE["label_match"] = f"""
SELECT doc_id, 0 AS pos, {label_a('doc_id')} AS label, {abusive(label_a('doc_id'))} AS is_abusive
FROM documents
UNION ALL
SELECT doc_id, 1 AS pos, 'non-abusive' AS label, false AS is_abusive FROM documents"""

ORACLE["decide"] = f"""
SELECT doc_id, {flagged('doc_id')} AS is_toxic, {max_score('doc_id')} AS max_score,
       {severity('doc_id')} AS severity
FROM documents"""

ORACLE["categories"] = f"""
SELECT doc_id, CASE WHEN {flagged('doc_id')} THEN 1 ELSE 0 END AS n_categories,
       CASE WHEN {flagged('doc_id')} THEN '{S.CATEGORY_NAME}' END AS category,
       CASE WHEN {flagged('doc_id')} THEN {score('doc_id')} END AS category_score,
       {severity('doc_id')} AS category_severity, 2 AS n_all_scores
FROM documents"""

ORACLE["abusive_sum"] = f"""
SELECT doc_id, CASE WHEN {abusive(label_a('doc_id'))} THEN {score('doc_id')} ELSE 0.0 END AS abusive_sum
FROM documents"""

ORACLE["evidence_id"] = "SELECT doc_id, sha256(text) AS id FROM documents"

ORACLE["build_evidence"] = f"""
WITH {EVIDENCE}
SELECT id, seq, source, severity, max_score, max_score AS score, '{S.CATEGORY_NAME}' AS label,
       ts_ms AS timestamp_ms, ts_ms AS timestamp_epoch_ms, 1 AS n_custody,
       'CREATED' AS custody_action, 'SYSTEM' AS custody_actor, ts_ms AS custody_ms,
       true AS no_screenshot, 1 AS n_categories, 2 AS n_all_scores, revision
FROM ev"""

ORACLE["stamp_evidence"] = f"""
WITH {EVIDENCE}
SELECT seq, CAST({NOW_MS} AS BIGINT) AS saved_at_ms, '1.0' AS version, false AS encrypted FROM ev"""

_IDS = "ids AS (SELECT DISTINCT sha256(text) AS id FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations))"

ORACLE["lookup_id"] = f"""
WITH {EVIDENCE}, {_IDS},
  firsts AS (SELECT id, min(seq) AS seq, arg_min(severity, seq) AS severity FROM ev GROUP BY id)
SELECT ids.id, firsts.seq IS NOT NULL AS found, coalesce(firsts.seq, -1) AS seq, firsts.severity
FROM ids LEFT JOIN firsts ON ids.id = firsts.id"""

ORACLE["delete_ids"] = f"""
WITH {EVIDENCE}, ids AS (SELECT sha256(text) AS id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT id, seq FROM ev WHERE id NOT IN (SELECT id FROM ids)"""

_ATT = f"""
  att AS (
    SELECT doc_id AS att_ord, sha256(text) AS id,
           'data:image/png;base64,' || to_base64(encode(text)) AS shot
    FROM documents
  ),
  firsts AS (SELECT id, min(seq) AS seq FROM ev GROUP BY id),
  numbered AS (
    SELECT att.*, row_number() OVER (PARTITION BY att.id ORDER BY att_ord) AS j, firsts.seq
    FROM att LEFT JOIN firsts ON att.id = firsts.id
  )"""

ORACLE["merge_attachments"] = f"""
WITH {EVIDENCE}, {_ATT}
SELECT att_ord, id, coalesce(seq, -1) AS seq, seq IS NOT NULL AS matched,
       CASE WHEN seq IS NOT NULL THEN CAST(j AS INTEGER) ELSE -1 END AS revision,
       CASE WHEN seq IS NOT NULL THEN CAST(1 + j AS INTEGER) ELSE -1 END AS n_custody,
       CASE WHEN seq IS NOT NULL THEN shot END AS screenshot
FROM numbered"""

ORACLE["custody_events"] = f"""
WITH {EVIDENCE}, {_ATT}
SELECT id, seq, CAST(j AS INTEGER) AS revision, 'SCREENSHOT_ADDED' AS action,
       CAST({NOW_MS} AS BIGINT) AS timestamp_ms, 'SYSTEM' AS actor
FROM numbered WHERE seq IS NOT NULL"""

ORACLE["current_evidence"] = f"""
WITH {EVIDENCE}, {_ATT},
  store AS (
    SELECT id, seq, 0 AS revision, 1 AS n_custody, CAST(NULL AS VARCHAR) AS screenshot FROM ev
    UNION ALL
    SELECT id, seq, CAST(j AS INTEGER), CAST(1 + j AS INTEGER), shot FROM numbered WHERE seq IS NOT NULL
  ),
  ranked AS (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY revision DESC, seq DESC) AS rn FROM store
  )
SELECT id, seq, revision, n_custody, screenshot FROM ranked WHERE rn = 1"""

_JSON_LEN = utf16_len("to_json({'id': id, 'source': source, 'text': text, 'severity': severity, "
                      f"'label': '{S.CATEGORY_NAME}', 'version': '1.0'}})")

ORACLE["store_stats"] = f"""
WITH {EVIDENCE},
  agg AS (
    SELECT count(*) AS total, sum({_JSON_LEN}) AS chars,
           count(*) FILTER (WHERE severity = 'HIGH') AS high,
           count(*) FILTER (WHERE severity = 'MEDIUM') AS medium,
           count(*) FILTER (WHERE severity = 'LOW') AS low,
           count(*) FILTER (WHERE severity NOT IN ('HIGH','MEDIUM','LOW') OR severity IS NULL) AS unknown,
           arg_min(ts_ms, seq) AS oldest, arg_max(ts_ms, seq) AS newest
    FROM ev
  ),
  sized AS (SELECT *, CAST(CASE WHEN total = 0 THEN 2 ELSE chars + total + 1 END AS BIGINT) AS size FROM agg)
SELECT total, size, floor(size / 1048576.0 * 100.0 + 0.5) / 100.0 AS size_mb,
       CAST({round(S.MAX_STORE_BYTES / 1048576)} AS BIGINT) AS max_mb,
       floor(size / {float(S.MAX_STORE_BYTES)} * 1000.0 + 0.5) / 10.0 AS usage_pct,
       high, medium, low, unknown, oldest, newest
FROM sized"""

ORACLE["quota_check"] = f"""
WITH {EVIDENCE},
  agg AS (SELECT count(*) AS total, sum({_JSON_LEN}) AS chars FROM ev),
  sized AS (SELECT total, CAST(CASE WHEN total = 0 THEN 2 ELSE chars + total + 1 END AS BIGINT) AS size FROM agg)
SELECT total, size, CAST({S.MAX_STORE_BYTES} AS BIGINT) AS max_bytes, size > {S.MAX_STORE_BYTES} AS over_quota
FROM sized"""

ORACLE["newest_first"] = f"""
WITH {EVIDENCE}
SELECT seq, row_number() OVER (ORDER BY ts_ms DESC, revision, seq) - 1 AS pos FROM ev"""

ORACLE["latest_log"] = f"""
WITH {EVIDENCE}
SELECT seq, row_number() OVER (ORDER BY revision DESC, seq DESC) - 1 AS pos FROM ev"""

__all__ = ["ORACLE", "WS"]

# ---------------------------------------------------------------------------
# Corpus
# ---------------------------------------------------------------------------
_LAB = "lab AS (SELECT d.doc_id, d.text, d.lang, l.toxic, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
_STR_LABEL = ("CASE doc_id % 5 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN 'x' "
              "WHEN 3 THEN '1.9' ELSE NULL END")
_SPLIT_NAME = ("CASE doc_id % 10 WHEN 0 THEN 'hindi_test' WHEN 1 THEN 'hindi_val' "
               "ELSE 'hindi_train' END")
_SPLIT = ("CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END")
_EXAMPLES = f"""
  {_LAB},
  hindi AS (SELECT text, CAST(1 - toxic AS INTEGER) AS label, 'hindi' AS corpus, {_SPLIT} AS split,
                   doc_id AS ord FROM lab WHERE lang = 'fr'),
  extra AS (
    SELECT text, CAST(CASE WHEN toxic = 0 THEN 1 WHEN doc_id % 2 IN (0, 1) THEN 0 ELSE 1 END AS INTEGER) AS label,
           'english' AS corpus, doc_id AS ord FROM lab WHERE lang = 'en'
    UNION ALL
    SELECT text, CAST(CASE WHEN toxic = 0 THEN 1 ELSE 0 END AS INTEGER), 'hinglish', doc_id
    FROM lab WHERE lang IN ('es', 'de')
  ),
  extra_split AS (
    SELECT *, CASE WHEN row_number() OVER (PARTITION BY corpus ORDER BY ord) - 1
                        < CAST(floor(CAST(0.9 AS DOUBLE) * count(*) OVER (PARTITION BY corpus)) AS BIGINT)
                   THEN 'train' ELSE 'test' END AS split
    FROM extra
  ),
  examples AS (SELECT text, label, corpus, split, ord FROM hindi
               UNION ALL SELECT text, label, corpus, split, ord FROM extra_split)"""

ORACLE["csv_scan"] = f"""
SELECT doc_id AS ord, text AS comment_text, {_STR_LABEL} AS label FROM documents"""

ORACLE["alias_columns"] = f"""
WITH {_LAB}
SELECT 'hindi' AS corpus, doc_id AS ord, sha256(text) AS id, CAST(1 - toxic AS INTEGER) AS label
FROM lab WHERE lang = 'fr'
UNION ALL
SELECT 'english', doc_id, sha256(text), CAST(CASE WHEN toxic = 0 THEN 2 ELSE doc_id % 2 END AS INTEGER)
FROM lab WHERE lang = 'en'
UNION ALL
SELECT 'hinglish', doc_id, sha256(text), CAST(toxic AS INTEGER) FROM lab WHERE lang IN ('es', 'de')"""

ORACLE["positional_columns"] = f"""
WITH {_LAB}
SELECT doc_id AS ord, sha256(text) AS id, CAST(1 - toxic AS INTEGER) AS label FROM lab"""

ORACLE["split_route"] = f"""
WITH {_LAB}
SELECT doc_id AS ord, {_SPLIT_NAME} AS source_name, {_SPLIT} AS split FROM lab"""

ORACLE["load_report"] = f"""
WITH {_LAB},
  names AS (SELECT * FROM (VALUES ('hindi_train'), ('hindi_val'), ('hindi_test'), ('hindi_extra')) t(source_name)),
  counts AS (SELECT {_SPLIT_NAME} AS source_name, {_SPLIT} AS split, count(*) AS rows
             FROM lab GROUP BY 1, 2)
SELECT n.source_name, c.split, CASE WHEN n.source_name = 'hindi_extra' THEN 'failed' ELSE 'loaded' END AS status,
       CAST(coalesce(c.rows, 0) AS BIGINT) AS rows
FROM names n LEFT JOIN counts c ON n.source_name = c.source_name"""

ORACLE["clean_examples"] = f"""
SELECT doc_id AS ord, sha256(text) AS id, {_STR_LABEL} AS label_raw
FROM documents WHERE {_STR_LABEL} IS NOT NULL"""

ORACLE["lenient_label"] = f"""
SELECT doc_id AS ord, {_STR_LABEL} AS label_raw,
       CAST(CASE doc_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 1 END AS INTEGER) AS label
FROM documents WHERE {_STR_LABEL} IS NOT NULL"""

ORACLE["collapse_classes"] = f"""
WITH {_LAB},
  e AS (SELECT doc_id, CAST(CASE WHEN toxic = 0 THEN 2 ELSE doc_id % 2 END AS INTEGER) AS class FROM lab)
SELECT doc_id AS ord, class, CAST(CASE WHEN class IN (0, 1) THEN 0 ELSE 1 END AS INTEGER) AS label FROM e"""

ORACLE["invert_label"] = f"""
WITH {_LAB}
SELECT doc_id AS ord, CAST(toxic AS INTEGER) AS label_raw, CAST(CASE WHEN toxic = 0 THEN 1 ELSE 0 END AS INTEGER) AS label
FROM lab"""

ORACLE["concat_corpora"] = f"""
WITH {_EXAMPLES}
SELECT corpus, ord, sha256(text) AS id, label, split FROM hindi
UNION ALL SELECT corpus, ord, sha256(text), label, CAST(NULL AS VARCHAR) FROM extra"""

_BY_LANG = f"""
  {_LAB},
  by_lang AS (
    SELECT lang AS corpus, doc_id AS ord, CAST(1 - toxic AS INTEGER) AS label,
           CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1
                     < CAST(floor(CAST(0.9 AS DOUBLE) * count(*) OVER (PARTITION BY lang)) AS BIGINT)
                THEN 'train' ELSE 'test' END AS split
    FROM lab
  )"""

ORACLE["positional_split"] = f"""
WITH {_BY_LANG}
SELECT corpus, ord, split FROM by_lang"""

ORACLE["seeded_shuffle"] = f"""
WITH {_EXAMPLES}
SELECT corpus, ord, row_number() OVER (ORDER BY md5('42:' || CAST(ord AS VARCHAR)), ord) - 1 AS pos
FROM examples WHERE split = 'train'"""

ORACLE["ensure_validation"] = f"""
WITH {_BY_LANG},
  ranked AS (SELECT corpus, ord, split,
                    row_number() OVER (ORDER BY md5('42:' || CAST(ord AS VARCHAR)), ord) - 1 AS p,
                    count(*) OVER () AS n
             FROM by_lang WHERE split = 'train')
SELECT corpus, ord, CASE WHEN p < ceil(CAST(0.1 AS DOUBLE) * n) THEN 'validation' ELSE 'train' END AS split FROM ranked
UNION ALL SELECT corpus, ord, split FROM by_lang WHERE split <> 'train'"""

ORACLE["head_n"] = f"""
WITH {_BY_LANG}
SELECT corpus, ord, label FROM by_lang ORDER BY ord LIMIT 10"""

ORACLE["split_sizes"] = f"""
WITH {_EXAMPLES}
SELECT split, corpus, label, count(*) AS n FROM examples GROUP BY split, corpus, label"""

ORACLE["isolation_check"] = f"""
WITH {_EXAMPLES},
  train_ids AS (SELECT DISTINCT sha256(text) AS id FROM examples WHERE split = 'train')
SELECT corpus, count(*) AS n_test,
       count(*) FILTER (WHERE sha256(text) IN (SELECT id FROM train_ids)) AS n_leaked
FROM examples WHERE split = 'test' GROUP BY corpus"""

# ---------------------------------------------------------------------------
# Metrics
# ---------------------------------------------------------------------------
_PRED = f"""
  {_LAB},
  pr AS (SELECT doc_id, CAST(CASE WHEN toxic = 0 AND quality = 0 THEN 2 ELSE 1 - toxic END AS INTEGER) AS label,
                CAST(CASE WHEN {score('doc_id')} >= 1 - {score('doc_id')} THEN 0 ELSE 1 END AS INTEGER) AS pred,
                CAST(CASE WHEN {score('doc_id')} - 0.05 >= 1 - {score('doc_id')} THEN 0 ELSE 1 END AS INTEGER) AS pred_b
         FROM lab)"""


def _f1_sql(pred: str) -> str:
    return f"""(SELECT round(sum(f1) / count(*), 12) FROM (
        SELECT c, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1
        FROM (SELECT c,
                     count(*) FILTER (WHERE label = c AND {pred} = c) AS tp,
                     count(*) FILTER (WHERE label <> c AND {pred} = c) AS fp,
                     count(*) FILTER (WHERE label = c AND {pred} <> c) AS fn
              FROM pr, (SELECT DISTINCT label AS c FROM pr UNION SELECT DISTINCT {pred} FROM pr) cls
              GROUP BY c)))"""


ORACLE["argmax"] = f"WITH {_PRED} SELECT doc_id, pred, pred_b FROM pr"

ORACLE["id2label"] = f"""WITH {_PRED}
SELECT doc_id, pred, CASE pred WHEN 0 THEN 'abusive' WHEN 1 THEN 'non-abusive' END AS pred_label,
       pred AS pred_back FROM pr"""

ORACLE["confusion"] = f"""WITH {_PRED},
  grid AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(label, pred) UNION SELECT label, pred FROM pr)
SELECT CAST(g.label AS INTEGER) AS label, CAST(g.pred AS INTEGER) AS pred, count(pr.doc_id) AS n
FROM grid g LEFT JOIN pr ON pr.label = g.label AND pr.pred = g.pred GROUP BY g.label, g.pred"""

ORACLE["accuracy"] = f"""WITH {_PRED}
SELECT count(*) AS n, avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM pr"""

ORACLE["macro_f1"] = f"WITH {_PRED} SELECT {_f1_sql('pred')} AS macro_f1"

ORACLE["compare_models"] = f"""WITH {_PRED},
  a AS (SELECT avg(CASE WHEN label = pred THEN 1.0 ELSE 0.0 END) AS acc_a,
               avg(CASE WHEN label = pred_b THEN 1.0 ELSE 0.0 END) AS acc_b FROM pr)
SELECT acc_a AS accuracy_a, {_f1_sql('pred')} AS macro_f1_a, acc_b AS accuracy_b,
       {_f1_sql('pred_b')} AS macro_f1_b, acc_b - acc_a AS accuracy_delta FROM a"""

ORACLE["fix_length"] = f"""
WITH t AS (SELECT doc_id, lower({js_trim('text')}) AS t FROM documents),
  k AS (SELECT doc_id, CASE WHEN t = '' THEN [] ELSE string_split_regex(t, '[ \\t\\n\\r]+') END AS toks FROM t)
SELECT doc_id, 128 AS size, CAST(least(len(toks), 128) AS INTEGER) AS n_real,
       CASE WHEN len(toks) >= 1 THEN toks[1] ELSE '[PAD]' END AS first_token,
       CASE WHEN len(toks) >= 128 THEN toks[128] ELSE '[PAD]' END AS last_token
FROM k"""

ORACLE["map_batches"] = "SELECT doc_id, length(text) AS n_chars_py FROM documents"

# ---------------------------------------------------------------------------
# Reports, codecs, exports, store
# ---------------------------------------------------------------------------


def _base36(n: int) -> str:
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"
    out = ""
    while n:
        n, r = divmod(n, 36)
        out = digits[r] + out
    return out or "0"


_LOCAL = ("(strftime(epoch_ms({x}) + INTERVAL 330 MINUTE, '%-d %b %Y, %-I:%M:%S ') || "
          "lower(strftime(epoch_ms({x}) + INTERVAL 330 MINUTE, '%p')))")
_PCT1 = "floor(max_score * 1000.0 + 0.5) / 10.0"
_CATS = f"'ABUSIVE (HINGLISH MACD) (' || CAST(CAST(floor(max_score * 100.0 + 0.5) AS BIGINT) AS VARCHAR) || '%)'"

ORACLE["format_report"] = f"""
WITH {EVIDENCE}
SELECT seq, CASE severity WHEN 'HIGH' THEN 'CRITICAL THREAT' WHEN 'LOW' THEN 'POTENTIALLY TOXIC'
                          ELSE 'HARMFUL CONTENT' END AS banner_label,
       {_CATS} AS banner_categories, severity AS severity_badge, {_PCT1} AS score_pct,
       printf('%.1f%%', {_PCT1}) AS score_text, {_LOCAL.format(x='ts_ms')} AS time_display,
       strftime(epoch_ms(ts_ms) + INTERVAL 330 MINUTE, '%-d/%-m/%y, %-I:%M ') ||
       lower(strftime(epoch_ms(ts_ms) + INTERVAL 330 MINUTE, '%p')) AS time_short, source AS source_display
FROM ev"""

ORACLE["number_incidents"] = f"""
WITH {EVIDENCE}
SELECT seq, row_number() OVER (ORDER BY revision, seq) AS incident_no FROM ev"""

ORACLE["report_details"] = f"""
WITH {EVIDENCE}
SELECT row_number() OVER (ORDER BY revision, seq) AS incident_no, id AS evidence_id,
       {_LOCAL.format(x='ts_ms')} AS time_display, source AS source_display, {_PCT1} AS score_pct,
       printf('%.1f%%', {_PCT1}) AS score_text, {_CATS} AS categories_display,
       severity AS severity_badge, text AS text_display
FROM ev"""

ORACLE["report_summary"] = f"""
WITH {EVIDENCE},
  c AS (SELECT severity, count(*) AS n FROM ev GROUP BY severity)
SELECT severity, CAST(CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 3 END AS INTEGER) AS level,
       n, severity || ' Severity: ' || CAST(n AS VARCHAR) || ' incident(s)' AS line
FROM c WHERE n > 0"""

ORACLE["report_id"] = f"""
WITH {EVIDENCE}, t AS (SELECT count(*) AS total FROM ev)
SELECT '{S.REPORT_TITLE}' AS title, {_LOCAL.format(x=str(NOW_MS))} AS generated_at, total,
       upper('SR-{_base36(NOW_MS)}-') AS id_start, true AS id_tail
FROM t"""

ORACLE["decode_attachment"] = """
SELECT doc_id AS ord, 'image/png' AS mime, CAST(octet_length(encode(text)) AS INTEGER) AS n_bytes,
       text AS decoded
FROM documents"""

ORACLE["encrypt_roundtrip"] = f"""
WITH {EVIDENCE}
SELECT seq, id, text, source, true AS encrypted, true AS cipher_differs FROM ev"""

ORACLE["export_json"] = f"""
WITH {EVIDENCE}
SELECT id, severity, max_score, strftime(epoch_ms(ts_ms), '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp,
       ts_ms AS timestamp_ms
FROM ev"""

ORACLE["export_csv"] = f"""
WITH {EVIDENCE}
SELECT id AS "ID", strftime(epoch_ms(ts_ms), '%Y-%m-%dT%H:%M:%S.%gZ') AS "Timestamp", severity AS "Severity",
       CAST(max_score AS VARCHAR) AS "Max Score", '{S.CATEGORY_NAME}' AS "Categories", source AS "Source",
       text AS "Text"
FROM ev"""

ORACLE["append_evidence"] = f"WITH {EVIDENCE} SELECT id, seq, severity FROM ev"
ORACLE["evidence_scan"] = f"WITH {EVIDENCE} SELECT id, seq, severity FROM ev"
ORACLE["clear_store"] = f"WITH {EVIDENCE} SELECT count(*) AS before, CAST(0 AS BIGINT) AS after FROM ev"

# ---------------------------------------------------------------------------
# Streaming (batch twins)
# ---------------------------------------------------------------------------
ORACLE["stream_source"] = """
SELECT CAST(conv_id AS VARCHAR) AS scope, role AS source, turn AS ord, text FROM conversations"""

ORACLE["stream_dedup"] = f"WITH {DOC_MESSAGES} SELECT DISTINCT scope, sha256(text) AS id FROM doc_kept"

ORACLE["stream_retry"] = f"""
WITH {DOC_MESSAGES},
  p1 AS (SELECT scope, sha256(text) AS id, min(ord) AS ord FROM doc_kept WHERE ord % 2 = 0 GROUP BY 1, 2),
  p2 AS (SELECT scope, sha256(text) AS id, min(ord) AS ord FROM doc_kept WHERE ord % 2 = 1 GROUP BY 1, 2),
  a1 AS (SELECT *, CASE WHEN ord % 11 = 0 THEN 'error' ELSE 'ok' END AS status, 1 AS attempt FROM p1),
  waits AS (SELECT scope, id, ord FROM a1 WHERE status = 'error'),
  offered AS (SELECT scope, id, min(ord) AS ord, CAST(1 + max(again) AS INTEGER) AS attempt
              FROM (SELECT *, 0 AS again FROM p2 UNION ALL SELECT *, 1 FROM waits) GROUP BY scope, id),
  a2 AS (SELECT scope, id, ord, CASE WHEN ord % 11 = 0 AND attempt = 1 THEN 'error' ELSE 'ok' END AS status, attempt
         FROM offered o
         WHERE NOT EXISTS (SELECT 1 FROM a1 WHERE a1.scope = o.scope AND a1.id = o.id AND a1.status = 'ok'))
SELECT * FROM a1 UNION ALL SELECT * FROM a2"""

ORACLE["stream_timed_retry"] = f"""
WITH {DOC_MESSAGES},
  firsts AS (SELECT DISTINCT scope, sha256(text) AS id FROM doc_kept),
  tries AS (SELECT *, CAST('0x' || substr(id, 1, 2) AS INTEGER) % 11 = 0 AS fails FROM firsts)
SELECT scope, id, CASE WHEN fails THEN 'error' ELSE 'ok' END AS status, 1 AS attempt FROM tries
UNION ALL SELECT scope, id, 'ok', 2 FROM tries WHERE fails"""

_STREAM_EV = f"""{DOC_MESSAGES},
  sev AS (SELECT sha256(text) AS id, ord AS seq, {severity('ord')} AS severity FROM doc_kept WHERE {flagged('ord')})"""

ORACLE["stream_incidents"] = f"""
WITH {_STREAM_EV}
SELECT 'incident_logs' AS "table", id, seq, severity FROM sev
UNION ALL SELECT 'evidence', id, seq, severity FROM sev"""

ORACLE["stream_stats"] = f"WITH {_STREAM_EV} SELECT severity, count(*) AS n FROM sev GROUP BY severity"

# ---------------------------------------------------------------------------
# Model and extraction keys: the parts of their results that SQL can state
# ---------------------------------------------------------------------------
ORACLE["score_messages"] = f"WITH {DOC_MESSAGES} SELECT scope, id, ord, true AS scored FROM doc_first"
ORACLE["scorer_roundtrip"] = "SELECT doc_id, true AS same FROM documents"
ORACLE["evaluate_scorer"] = f"WITH {_EXAMPLES} SELECT count(*) AS n, true AS sane FROM examples WHERE split = 'test'"
ORACLE["fit_scorer"] = ("SELECT CAST(r AS DOUBLE) AS reg_param, CAST(1 AS BIGINT) AS n_chosen "
                        "FROM (VALUES (0.0), (0.01), (0.1)) t(r)")
ORACLE["extract_counts"] = """
SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS source,
       CAST(len(regexp_extract_all(html, '<article[ >]')) AS BIGINT) AS n
FROM pages WHERE regexp_matches(html, '<article[ >]')"""

ORACLE["extract_lateral"] = ORACLE["extract_counts"]
ORACLE["stream_store_stats"] = ORACLE["store_stats"]
ORACLE["delete_stored"] = f"""
WITH {EVIDENCE}, ids AS (SELECT sha256(text) AS id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT state, id, seq FROM ev, (VALUES ('tombstones'), ('folded')) s(state) WHERE id NOT IN (SELECT id FROM ids)"""
ORACLE["find_stored"] = f"""
WITH {EVIDENCE}, asked AS (SELECT severity, min(id) AS id FROM ev GROUP BY severity)
SELECT id, min(seq) AS seq, arg_min(severity, seq) AS severity FROM ev WHERE id IN (SELECT id FROM asked) GROUP BY id"""

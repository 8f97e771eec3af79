"""Schemas and fixed values.

Everything a result depends on lives here once, so the batch jobs, the stream
jobs and the tests read the same numbers.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour (thresholds, label
# sets, class names, display tables, formats). Kept together and in natural
# order on purpose.
# ---------------------------------------------------------------------------
FLAG_THRESHOLD = 0.65          # an abusive score >= this flags the message
HIGH_THRESHOLD = 0.85          # max flagging score > this is HIGH, else MEDIUM
MIN_MESSAGE_UNITS = 5          # messages shorter than 5 UTF-16 units are ignored
TOKEN_LENGTH = 128             # tokens are truncated / padded to exactly 128
MAX_STORE_BYTES = 50 * 1024 * 1024  # evidence store warning limit (50 MiB)
SCAN_PERIOD_MS = 1200          # change bursts coalesce to one scan per 1200 ms
SHUFFLE_SEED = 42              # seed of the corpus shuffle
TRAIN_FRACTION = 0.9           # positional train share of the extra corpora
VALIDATION_FRACTION = 0.1      # validation carve-out share of train
EVIDENCE_VERSION = "1.0"
CATEGORY_NAME = "Abusive (Hinglish MACD)"
CREATED_ACTION = "CREATED"
SCREENSHOT_ACTION = "SCREENSHOT_ADDED"
SYSTEM_ACTOR = "SYSTEM"
UNKNOWN_LABEL = "unknown"
REPORT_TITLE = "Evidence Report"
REPORT_TIMEZONE = "Asia/Kolkata"
SHORT_TIME_PATTERN = "d/M/yy, h:mm a"           # en-IN short date + short time
REPORT_TIME_PATTERN = "d MMM yyyy, h:mm:ss a"   # en-IN medium date + medium time (am/pm lower case)
EXPORT_EMPTY_MESSAGE = "No evidence to export"
CSV_HEADER = ["ID", "Timestamp", "Severity", "Max Score", "Categories", "Source", "Text"]

# Label sets as the scorer's decision step has them; a label flags only when it
# is in the abusive set and not in the safe set (so label_0 / label_1 never do).
ABUSIVE_LABELS = ("abusive", "label_1", "label_0")
SAFE_LABELS = ("non-abusive", "label_0", "label_1")

# Class ids of the binary classifier: 0 = abusive, 1 = non-abusive.
ID2LABEL = {0: "abusive", 1: "non-abusive"}
LABEL2ID = {"abusive": 0, "non-abusive": 1}

# Severity levels in counting order, with the in-page display label and the
# report colour (r, g, b). Unknown severities show as MEDIUM in the banner and
# as UNKNOWN in the report.
SEVERITIES = ("HIGH", "MEDIUM", "LOW", "UNKNOWN")
SEVERITY_DISPLAY = {
    "HIGH": ("CRITICAL THREAT", (211, 47, 47)),
    "MEDIUM": ("HARMFUL CONTENT", (245, 124, 0)),
    "LOW": ("POTENTIALLY TOXIC", (251, 192, 45)),
    "UNKNOWN": (None, (158, 158, 158)),
}

# Null tokens recognised by pandas' CSV reader (default na_values).
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null")

# Characters removed by JavaScript's String.prototype.trim (WhiteSpace and
# LineTerminator): TAB, LF, VT, FF, CR, SPACE, NBSP, OGHAM SPACE MARK,
# EN QUAD .. HAIR SPACE, LINE SEPARATOR, PARAGRAPH SEPARATOR, NARROW NBSP,
# MEDIUM MATHEMATICAL SPACE, IDEOGRAPHIC SPACE, BYTE ORDER MARK.
JS_WHITESPACE = ("\t\n\u000b\f\r\u0020\u00a0\u1680"
                 + "".join(chr(c) for c in range(0x2000, 0x200B))
                 + "\u2028\u2029\u202f\u205f\u3000\ufeff")

# Split-name routing: prefix stripped from source names, and names that mean
# validation; "train" means train, anything else is test.
SPLIT_PREFIX = "hindi_"
VALIDATION_NAMES = ("val", "validation")

# Column aliases, in precedence order (first present wins per target).
TEXT_ALIASES = ("comment_text", "tweet")
LABEL_ALIASES = ("class",)

PAD_TOKEN = "[PAD]"

# ---------------------------------------------------------------------------
# Struct types
# ---------------------------------------------------------------------------
SCORE = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("score", T.DoubleType()),
])
SCORES = T.ArrayType(SCORE)

CATEGORY = T.StructType([
    T.StructField("category", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("severity", T.StringType()),
])
CATEGORIES = T.ArrayType(CATEGORY)

CUSTODY_EVENT = T.StructType([
    T.StructField("action", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("actor", T.StringType()),
])
CUSTODY = T.ArrayType(CUSTODY_EVENT)

EXAMPLE = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("corpus", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("ord", T.LongType()),
])

MESSAGE = T.StructType([
    T.StructField("scope", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("ord", T.LongType()),
    T.StructField("event_ts", T.TimestampType()),
])

EVIDENCE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("timestamp_ms", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("max_score", T.DoubleType()),
    T.StructField("categories", CATEGORIES),
    T.StructField("all_scores", SCORES),
    T.StructField("screenshot", T.StringType()),
    T.StructField("chain_of_custody", CUSTODY),
    T.StructField("score", T.DoubleType()),
    T.StructField("label", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("revision", T.IntegerType()),
    T.StructField("saved_at", T.TimestampType()),
    T.StructField("version", T.StringType()),
    T.StructField("encrypted", T.BooleanType()),
])

# JSON field names of a stored record, in the order the reference serialises
# them; used for size accounting and exports.
EVIDENCE_JSON_FIELDS = (
    ("id", "id"), ("timestamp", "timestamp"), ("timestamp_ms", "timestampMs"),
    ("source", "source"), ("text", "text"), ("severity", "severity"),
    ("max_score", "maxScore"), ("categories", "categories"), ("all_scores", "allScores"),
    ("screenshot", "screenshot"), ("chain_of_custody", "chainOfCustody"),
    ("score", "score"), ("label", "label"), ("saved_at", "savedAt"),
    ("version", "version"), ("encrypted", "encrypted"),
)

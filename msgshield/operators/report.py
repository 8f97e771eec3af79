"""Report formatting (P13), incident numbering (O6) and report tables (K3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import schemas as S
from ..functions.codec import report_id
from ..functions.text import percent0, percent1
from ..functions.timeutil import ts_lit
from .index import attach, positions
from .stats import normalized_severity


def local_time(col, tz: str = S.REPORT_TIMEZONE, pattern: str = S.REPORT_TIME_PATTERN):
    """en-IN medium date and time in the report zone, e.g. ``5 Feb 2024, 6:31:00 am``
    (the browser's en-IN locale writes the day period in lower case); null → 'N/A'."""
    c = F.col(col) if isinstance(col, str) else col
    s = F.date_format(F.from_utc_timestamp(c, tz), pattern)
    s = F.regexp_replace(F.regexp_replace(s, " AM$", " am"), " PM$", " pm")
    return F.coalesce(s, F.lit("N/A"))


def short_time(col, tz: str = S.REPORT_TIMEZONE):
    """en-IN short date and time of the dashboard list, e.g. ``5/2/24, 6:31 am``; null → 'N/A'."""
    return local_time(col, tz, S.SHORT_TIME_PATTERN)


def _category_text(cats, banner: bool):
    def one(c):
        name = c["category"]
        if banner:   # the banner replaces only the first underscore
            name = F.regexp_replace(name, "^([^_]*)_", "$1 ")
        return F.concat(F.upper(name), F.lit(" ("), percent0(c["score"]).cast("string"), F.lit("%)"))
    return F.concat_ws(", ", F.transform(F.coalesce(cats, F.array().cast(S.CATEGORIES)), one))


def severity_dimension(spark) -> DataFrame:
    rows = [(s, i, lbl) for i, (s, (lbl, _)) in enumerate(S.SEVERITY_DISPLAY.items())]
    return spark.createDataFrame(rows, "severity string, level int, display string")


def format_report(df: DataFrame) -> DataFrame:
    """Display columns of the reference's banner, dashboard and report.

    Severity labels come from a fixed four-row dimension (broadcast left
    join); unknown severities show as MEDIUM's label in the banner and as
    UNKNOWN on the report badge.
    """
    spark = df.sparkSession
    dim = severity_dimension(spark).select(F.col("severity").alias("_sev"), F.col("display").alias("_disp"))
    medium_label = S.SEVERITY_DISPLAY["MEDIUM"][0]
    pct = percent1(F.coalesce(F.col("max_score"), F.lit(0.0)))
    out = df.join(F.broadcast(dim), F.col("severity") == F.col("_sev"), "left")
    return out.withColumns({
        "evidence_id": F.coalesce(F.col("id"), F.lit("N/A")),
        "time_display": local_time("timestamp"),
        "time_short": short_time("timestamp"),
        "source_display": F.coalesce(F.when(F.col("source") != "", F.col("source")), F.lit("Unknown")),
        "score_pct": pct,
        "score_text": F.format_string("%.1f%%", pct),
        "categories_display": _category_text(F.col("categories"), banner=False),
        "banner_categories": _category_text(F.col("categories"), banner=True),
        "severity_badge": F.coalesce(F.when(F.col("severity") != "", F.col("severity")),
                                     F.lit("UNKNOWN")),
        "banner_label": F.coalesce(F.col("_disp"), F.lit(medium_label)),
        "text_display": F.coalesce(F.when(F.col("text") != "", F.col("text")), F.lit("No content")),
    }).drop("_sev", "_disp")


def number_incidents(df: DataFrame, col: str = "incident_no") -> DataFrame:
    """1..n in stored (insertion) order, distributed."""
    keys = ["revision", "seq"]
    return attach(df, positions(df, keys, keep=keys, index_col="_i"), keys, ["_i"]) \
        .withColumn(col, F.col("_i") + 1).drop("_i")


def report_details(df: DataFrame) -> DataFrame:
    return format_report(number_incidents(df))


def report_summary(df: DataFrame) -> DataFrame:
    """Severity, count — only levels with incidents, in level order."""
    spark = df.sparkSession
    counts = df.groupBy(normalized_severity("severity").alias("severity")).agg(
        F.count(F.lit(1)).alias("n"))
    dim = severity_dimension(spark).select("severity", "level")
    return (F.broadcast(dim).join(counts, "severity")
            .where(F.col("n") > 0)
            .withColumn("line", F.format_string("%s Severity: %d incident(s)", F.col("severity"),
                                                F.col("n"))))


def report_header(df: DataFrame, now, title: str = S.REPORT_TITLE) -> DataFrame:
    """One row: title, generation time (report zone), total, report id."""
    # The salt follows the store's content: crc32 of every record's id and place, summed.
    record = F.concat_ws(":", F.coalesce("id", F.lit("")), F.col("seq"), F.col("revision"))
    total = df.agg(F.count(F.lit(1)).alias("total"),
                   F.coalesce(F.sum(F.crc32(record.cast("binary"))), F.lit(0)).alias("_content"))
    return total.select(
        F.lit(title).alias("title"),
        local_time(ts_lit(now)).alias("generated_at"),
        "total",
        report_id(now, F.concat_ws(":", F.lit("report"), F.col("total").cast("string"),
                                   F.col("_content").cast("string"))).alias("report_id"))


def write_report(df: DataFrame, root: str, now, name: str = "evidence_report",
                 fmt: str = "parquet") -> str:
    """Write the three report tables under ``<root>/<name>_<yyyy-MM-dd>/``
    (K3 + K6): ``header`` (one row), ``summary`` and ``details`` (in stored
    order, numbered). Returns the folder."""
    from ..sinks.export import dated

    out = f"{root}/{dated(name, now)}"
    report_header(df, now).write.mode("overwrite").format(fmt).save(f"{out}/header")
    report_summary(df).write.mode("overwrite").format(fmt).save(f"{out}/summary")
    report_details(df).write.mode("overwrite").format(fmt).save(f"{out}/details")
    return out

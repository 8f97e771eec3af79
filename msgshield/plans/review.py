"""Review and export of the evidence store as one call.

The store is read once and persisted for the several outputs built on it
(the reference read it twice per dashboard load).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import SparkSession

from ..operators import evidence as ev_ops
from ..operators import report as rep
from ..operators.stats import store_stats
from ..sinks.export import export_json
from ..sources.evidence import read_evidence


def review_store(spark: SparkSession, store_path: str, out_root: str, now) -> dict:
    """Dashboard statistics, newest-first listing, report tables and JSON
    export of one store. Returns ``{stats, listing, report, export}`` (two
    DataFrames and two written folders). The persisted store is released
    after the writes; the returned DataFrames recompute from the store if used
    later."""
    store = read_evidence(spark, store_path).drop("saved_date", "batch_id").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        report_dir = rep.write_report(store, out_root, now)
        export_dir = export_json(store, out_root, now)
        stats = store_stats(store)
        listing = ev_ops.newest_first(store)
    finally:
        store.unpersist()
    return {"stats": stats, "listing": listing, "report": report_dir, "export": export_dir}

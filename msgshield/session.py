"""Session construction and shared-folder helpers.

Nothing here hard-codes a cluster location: the checkpoint folder comes from
``spark.checkpoint.dir`` when the cluster sets it; only a local-mode session
without that setting (tests, bench) gets a fresh folder under the system temp
directory.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

from . import schemas


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "msgshield", extra: dict | None = None) -> SparkSession:
    """Session tuned for the engine: AQE with skew handling, UTC, Arrow, no UI."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # One Arrow batch per 10k rows keeps Python-side memory bounded for
        # long documents while amortising the JVM<->Python hop.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
        # ...and never more than 64 MiB per batch: raw HTML pages and long
        # documents would otherwise make 10k-row batches gigabytes large.
        "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
        # Index checkpoints are per query; drop their files once unreferenced.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # Streaming dedup state is exact and unbounded by design; RocksDB keeps
        # it off the JVM heap and checkpoints it incrementally.
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only where unset.

    Order: the context's current checkpoint dir, then ``spark.checkpoint.dir``
    from the session conf, then (local mode only) a fresh temp folder. On a
    cluster without the setting this raises instead of guessing a
    machine-local path.
    """
    try:
        sc = spark.sparkContext
        current = sc._jsc.sc().getCheckpointDir()
    except Exception:  # noqa: BLE001 — Connect: the server owns spark.checkpoint.dir
        return spark.conf.get("spark.checkpoint.dir", "")
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not _is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="msgshield-ckpt-")
    sc.setCheckpointDir(configured)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint location.

    Used for stream inputs/outputs, checkpoints and written intermediate
    tables, so every executor sees the same path.
    """
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root, "msgshield-scratch", f"{name}-{uuid.uuid4().hex[:12]}")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, partitions: int | None = None):
    """One of the given tables. ``partitions`` deals a table of few large row groups out
    to that many tasks: a caller's choice, never made from the table's size."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.repartition(partitions) if partitions else df


__all__ = ["build_session", "ensure_checkpoint_dir", "scratch_path", "read_table", "table_path",
           "schemas"]

"""Deletes and lookups on the store, the bucketed ledger, live statistics, extraction in SQL."""

import datetime as dt
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from msgshield.operators import stats
from msgshield.plans import catalog as C, fixtures as fx
from msgshield.session import read_table
from msgshield.sinks import export as sink, upkeep
from msgshield.sources import html as html_src
from msgshield.sources.evidence import STORED, read_evidence
from msgshield.streaming import stream as st

from conftest import SF_SMALL

DAY = [dt.datetime(2024, 5, d, 12) for d in range(1, 6)]


def some_evidence(spark, days=4, batches=2):
    """Records over several save dates; the batches to append, in order."""
    ev = fx.evidence(spark, SF_SMALL).cache()
    return [ev.where((F.col("seq") % days == d) & (F.floor(F.col("seq") / days) % batches == b))
              .withColumn("saved_at", F.lit(DAY[d])) for d in range(days) for b in range(batches)]


def files(path):
    out = {}
    for root, _, names in os.walk(path):
        for n in names:
            if n.endswith(".parquet"):
                p = os.path.join(root, n)
                out[os.path.relpath(p, path)] = hashlib.md5(open(p, "rb").read()).hexdigest()
    return out


def seqs(df):
    return sorted((r.id, r.seq) for r in df.select("id", "seq").collect())


def test_delete_is_seen_at_once_and_folded_later(spark, tmp_dir):
    path = os.path.join(tmp_dir, "store")
    for part in some_evidence(spark):
        booked = sink.append_evidence(part, path)
    before = files(path)
    day_one = read_evidence(spark, path).where(F.to_date("saved_at") == "2024-05-02")
    ids = [r.id for r in day_one.groupBy("id").agg(F.count("*").alias("n")).orderBy("id").limit(3).collect()]
    asked = spark.createDataFrame([(i,) for i in ids + [ids[0], None, "no such id"]], "id string")
    want = [r for r in seqs(read_evidence(spark, path)) if r[0] not in ids]
    gone = len(seqs(read_evidence(spark, path))) - len(want)
    for _ in range(2):                                      # a repeated request changes nothing
        upkeep.delete_stored(spark, path, asked, DAY[4], "r1")
        assert seqs(read_evidence(spark, path)) == want and files(path) == before
    touched = {os.path.dirname(f) for f in before} - {
        os.path.dirname(f) for f in before if spark.read.parquet(os.path.join(path, f)).where(F.col("id").isin(ids)).count() == 0}
    got = upkeep.fold_deletes(spark, path)
    assert got == {"folders": len(touched), "removed": gone} and gone >= 3 and len(touched) < len(before)
    after = files(path)
    assert {f: h for f, h in before.items() if os.path.dirname(f) not in touched} == {
        f: h for f, h in after.items() if os.path.dirname(f) not in touched}
    assert spark.read.parquet(path).where(F.col("id").isin(ids)).count() == 0 and seqs(read_evidence(spark, path)) == want
    size = sink.read_or_empty(spark, sink.SIZES, sink._size_path(path)).first()
    assert size["rows"] == len(want) and size["rows"] + size["chars"] + 1 == stats.store_stats(
        read_evidence(spark, path).drop("saved_date", "batch_id")).first()["size"] < booked["size"]
    assert upkeep.fold_deletes(spark, path) == {"folders": 0, "removed": 0} and files(path) == after


def test_records_saved_after_a_deletion_stay(spark, tmp_dir):
    path = os.path.join(tmp_dir, "store")
    first, *_ = some_evidence(spark)
    sink.append_evidence(first, path)
    ids = first.select("id")
    upkeep.delete_stored(spark, path, ids, DAY[1], "r1")
    assert read_evidence(spark, path).count() == 0
    again = first.withColumn("saved_at", F.lit(DAY[2])).withColumn("seq", F.col("seq") + 10_000_000)
    sink.append_evidence(again, path)
    want = seqs(again)
    assert seqs(read_evidence(spark, path)) == want
    upkeep.fold_deletes(spark, path)                        # the first batch's folder goes altogether
    assert seqs(read_evidence(spark, path)) == want and seqs(spark.read.parquet(path)) == want
    upkeep.delete_stored(spark, path, ids, DAY[3], "r2")
    sink.clear_store(spark, path)
    sink.append_evidence(again, path)
    assert seqs(read_evidence(spark, path)) == want         # a cleared store has no tombstones
    with pytest.raises(ValueError):
        upkeep.delete_stored(spark, path, ids, DAY[3], "a/b")


@pytest.mark.parametrize("step", ["store_writer", "_remove_folder"])
def test_a_fold_cut_short_is_finished_by_the_next(spark, tmp_dir, monkeypatch, step):
    path = os.path.join(tmp_dir, "store")
    parts = some_evidence(spark, days=2, batches=2)
    for part in parts:
        sink.append_evidence(part, path)
    everything = seqs(read_evidence(spark, path))
    ids = parts[0].select("id").unionByName(parts[1].select("id").orderBy("id").limit(1))
    listed = {r.id for r in ids.collect()}
    upkeep.delete_stored(spark, path, ids, DAY[4], "r1")
    want = [r for r in everything if r[0] not in listed]
    real, calls = getattr(upkeep, step), []

    def failing(*args):
        calls.append(args)
        if step == "_remove_folder" or len(calls) == 2:     # the second write puts the staged rows in place
            raise OSError("lost")
        return real(*args)
    monkeypatch.setattr(upkeep, step, failing)
    with pytest.raises(OSError):
        upkeep.fold_deletes(spark, path)
    monkeypatch.setattr(upkeep, step, real)
    assert seqs(read_evidence(spark, path)) == want
    upkeep.fold_deletes(spark, path)
    assert seqs(read_evidence(spark, path)) == want and seqs(spark.read.parquet(path)) == want
    assert sink.read_or_empty(spark, sink.SIZES, sink._size_path(path)).first()["rows"] == len(want)


def scanned_rows(df):
    """Rows that the Parquet scans of a finished query put out."""
    rows, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(node.plan())
            continue
        if name.startswith("Scan parquet"):
            rows += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return rows


def test_a_lookup_skips_files_without_its_id(spark, tmp_dir):
    """Ids are hashes, so the files' ranges overlap; only their Bloom filters tell which can hold one."""
    path = os.path.join(tmp_dir, "store")
    for part in some_evidence(spark, days=4, batches=3):
        sink.append_evidence(part.coalesce(1), path)
    total = read_evidence(spark, path).count()
    ids = sorted(r.id for r in read_evidence(spark, path).select("id").collect())
    one, middle = ids[0], ids[len(ids) // 2]
    for i in (one, middle):
        found = upkeep.find_stored(spark, path, [i])
        rows = found.collect()
        assert [r.id for r in rows] == [i] and rows[0].seq == read_evidence(spark, path).where(F.col("id") == i).agg(
            F.min("seq")).first()[0]
    absent = hashlib.sha256(b"absent").hexdigest()
    asked = read_evidence(spark, path).where(F.col("id").isin([absent]))
    assert asked.collect() == [] and scanned_rows(asked) < total / 4
    assert upkeep.find_stored(spark, path, [absent, None]).count() == 0
    assert upkeep.find_stored(spark, path, []).count() == 0
    with pytest.raises(ValueError):
        upkeep.find_stored(spark, path, [str(i) for i in range(11)])


def test_a_batch_reads_only_its_own_buckets_of_the_ledger(spark, tmp_dir):
    keys = spark.range(20_000).select(F.lit("s").alias("scope"), F.sha2(F.col("id").cast("string"), 256).alias("id"))
    path = os.path.join(tmp_dir, "attempts")
    st._write_ok_snapshot(keys, path, 9)
    folders = [n for n in os.listdir(st._snapshot_path(path, 9)) if n.startswith("bucket=")]
    assert len(folders) == st.OK_BUCKETS
    some = keys.limit(5)
    buckets = [r[0] for r in some.select(st._bucket()).distinct().collect()]
    read = st._read_ok_snapshot(spark, path, 9, buckets)
    assert "PartitionFilters: [(bucket" in read._jdf.queryExecution().toString().replace("isnotnull", "")
    assert read.join(some, ["scope", "id"], "left_semi").count() == 5
    assert read.count() < 20_000 * (len(buckets) + 2) / st.OK_BUCKETS
    assert st._read_ok_snapshot(spark, path, 9).count() == 20_000 and st._read_ok_snapshot(spark, path, 9, []).count() == 0


def test_live_statistics_equal_those_of_the_finished_store(spark, tmp_dir):
    path = os.path.join(tmp_dir, "store")
    parts = some_evidence(spark)
    for part in parts:
        sink.append_evidence(part, path)
    sink.append_evidence(parts[0], path)                    # a replayed batch, with the numbers it had
    whole = stats.store_stats(read_evidence(spark, path).drop("saved_date", "batch_id").dropDuplicates(["revision", "seq"])).first()
    seen = []
    live = st.stream_store_stats(spark.readStream.schema(STORED).option("maxFilesPerTrigger", 3).parquet(path), repeats=True)
    st.run_to_completion(live.writeStream.outputMode("update").foreachBatch(lambda b, i: seen.extend(b.collect()))
                         .option("checkpointLocation", os.path.join(tmp_dir, "ck")))
    assert len(seen) >= 3 and seen[-1] == whole and seen[0].total < whole.total


def test_extraction_as_a_table_function(spark):
    html_src.register_udtf(spark, "found_in", C.FIXTURE_RULES)
    pages = read_table(spark, SF_SMALL, "pages").select("page_id", "url", "html").union(
        spark.createDataFrame([(-1, "http://x/", None), (-2, None, "")], "page_id long, url string, html string"))
    pages.createOrReplaceTempView("pages_here")
    got = spark.sql("SELECT p.page_id, m.* FROM pages_here p, LATERAL found_in(p.html) m")
    want = html_src.extract_messages(pages, C.FIXTURE_RULES).drop("source")
    rows = sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, got.collect())) == rows and len(rows) > 0

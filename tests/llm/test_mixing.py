import pytest
from pyspark.sql import functions as F

from msgshield.llm import mixing
from .helpers import clashing, edge_docs, empty_docs, rows, words


def plain_water_fill(sizes, weights, epochs=3):
    total, clamped = sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in clamped]
        left = total - sum(epochs * sizes[s] for s in clamped)
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > epochs * sizes[s]}
        if not over:
            return {s: epochs * sizes[s] if s in clamped else level * weights[s] for s in sizes}
        clamped |= over


def test_targets_are_clamped_and_reshared(spark):
    sizes = {"a": 10, "b": 1000, "c": 5000, "d": 1, "e": 40}
    frame = spark.createDataFrame([(s, "s" + s, n, w) for (s, n), w in zip(sizes.items(), (5, 2, 1, 5, 2))],
                                  "source string, skey string, source_size long, weight int")
    got = {r.source: r.target for r in mixing.water_fill(frame).collect()}
    want = plain_water_fill(sizes, dict(zip(sizes, (5, 2, 1, 5, 2))))
    assert got == pytest.approx(want) and got["a"] == 30 and got["d"] == 3
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_taken_comes_near_the_target_and_reruns_agree(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i * 7 % 23), "en", f"s{i % 3}" if i % 9 else None, 0)
                                  for i in range(400)], "doc_id long, text string, lang string, source string, n_chars int")
    first = mixing.mix_report(docs)
    got = first.groupBy("source_size", "target").agg(F.sum("taken").alias("t"), F.max(F.col("taken") - 3 * F.col("size")).alias("over"))
    for r in got.collect():
        assert abs(r.t - r.target) <= 0.01 * r.target and r.over <= 0
    assert rows(first) == rows(mixing.mix_report(docs))


def test_edges(spark):
    report = mixing.mix_report(edge_docs(spark))
    assert rows(report, "doc_id", "size", "target", "taken") == rows(
        mixing.mix_report(clashing(edge_docs(spark))), "doc_id", "size", "target", "taken")
    got = {r.doc_id: r for r in report.collect()}
    assert got[2].size == 0 and got[3].size == 0 and got[4].size == 0 and got[6].size == 3000
    assert report.where("doc_id = 1").select("taken").distinct().count() == 1
    assert rows(mixing.mix_report(empty_docs(spark))) == []


def test_mix_repeats_documents_as_planned(spark):
    docs = edge_docs(spark)
    plan = {(r.doc_id, r.size): r.copies for r in mixing.mix_report(docs).collect()}
    got = {}
    for r in mixing.mix(docs).collect():
        key = (r.doc_id, len(words(r.text)))
        got[key] = got.get(key, 0) + 1
    twice = {1: 2}
    assert got == {k: c * twice.get(k[0], 1) for k, c in plan.items() if c}
    assert mixing.mix(empty_docs(spark)).count() == 0


def test_documents_without_words_keep_the_cap(spark):
    """A source at its cap has no room: its empty documents come no more often than the others."""
    rows = [(i, "w " * 10, "en", "a", 20) for i in range(3)] + [(10 + i, "", "en", "a", 0) for i in range(4)]
    rows += [(100 + i, "w " * 10, "en", "b", 20) for i in range(300)] + [(900, "", "en", "c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    copies = {r.doc_id: r.copies for r in mixing.mix_report(docs).collect()}
    assert {copies[i] for i in (0, 1, 2, 10, 11, 12, 13)} == {3} and max(copies.values()) == 3 and copies[900] == 0
    assert mixing.mix(docs).where("doc_id < 100").groupBy("doc_id").count().where("count <> 3").count() == 0

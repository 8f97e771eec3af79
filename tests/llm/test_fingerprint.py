import hashlib

import pytest

from msgshield.llm import fingerprint
from .helpers import clashing, edge_docs, empty_docs, small_docs, words


def plain_sketch(text):
    w = words(text)
    shingles = [" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    hashes = {hashlib.md5(s.encode()).hexdigest() for s in shingles}
    kept = {h for h in hashes if h < "4"} or ({min(hashes)} if hashes else set())
    return sorted(h[:15] for h in kept)


def plain_alike(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


def test_report_matches_brute_force_over_small_ranges(spark, monkeypatch):
    docs = small_docs()
    docs = [(i * 3 - 50, t) for i, t in docs][::-1]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    order = sorted(docs)
    after = {d: order[(n + 1) % len(order)][1] for n, (d, _) in enumerate(order)}
    real = fingerprint.with_next
    monkeypatch.setattr(fingerprint, "with_next", lambda d: real(d, range_docs=17))
    for r in fingerprint.fingerprint_report(frame).collect():
        text, nxt = dict(docs)[r.doc_id], after[r.doc_id]
        half = len(text) // 2
        edited = text[:len(text) - half] + nxt[:half]
        a, b, c = plain_sketch(text), plain_sketch(edited), plain_sketch(nxt)
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == "".join(a) and r.edited_fingerprint == "".join(b)
        assert r.near_edited == pytest.approx(plain_alike(a, b)) and r.near_next == pytest.approx(plain_alike(a, c))


def test_edges(spark):
    got = {r.doc_id: r for r in fingerprint.fingerprint_report(clashing(edge_docs(spark))).collect()}
    assert len(got) == 11 and got[2].n_chars == 0 and got[2].fingerprint == "" and got[2].near_edited == 1.0
    assert got[8].fingerprint == got[1].fingerprint != "" and got[None].near_next == 0.0
    assert got[10].n_chars == 3                                  # its next is the first again
    assert fingerprint.fingerprint_report(empty_docs(spark)).count() == 0
    one = spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")
    assert fingerprint.fingerprint_report(one).first().near_next == 1.0


def test_sketches_merge_and_estimate_containment(spark):
    long = " ".join(f"w{i}" for i in range(4000))
    part = " ".join(f"w{i}" for i in range(1000, 1400))
    rest = " ".join(f"w{i}" for i in range(3996, 4600))
    df = spark.createDataFrame([(long, part, rest, long + " " + " ".join(f"w{i}" for i in range(4000, 4600)))],
                               "a string, b string, c string, whole string")
    for c in ("a", "b", "c", "whole"):
        df = fingerprint.with_sketch(df, c, f"s_{c}")
    r = df.select(fingerprint.containment("s_b", "s_a"), fingerprint.containment("s_a", "s_b"),
                  fingerprint.merge("s_a", "s_c"), "s_whole").first()
    assert r[0] == 1.0 and r[1] == pytest.approx(0.1, abs=0.04) and r[2] == r[3]


def test_merge_with_a_text_that_keeps_only_its_least_hash(spark):
    """One-word texts have one hash, mostly above the threshold; with others it goes as in the union's sketch."""
    from pyspark.sql import functions as F
    from pyspark.sql import Row
    few = [Row(a=f"only{i}", b=f"other{i}") for i in range(40)]
    df = fingerprint.with_sketch(fingerprint.with_sketch(spark.createDataFrame(few), "a", "sa"), "b", "sb")
    rows = df.select("sa", "sb", fingerprint.merge("sa", "sb").alias("m")).collect()
    limit = fingerprint.RETAIN << 4 * (fingerprint.DIGITS - 1)
    for r in rows:
        both = sorted(set(r.sa) | set(r.sb))
        assert list(r.m) == ([x for x in both if x < limit] or both[:1])
    assert any(len(r.m) == 1 for r in rows) and spark.range(1).select(
        F.size(fingerprint.merge(F.array().cast("array<long>"), F.array().cast("array<long>")))).first()[0] == 0

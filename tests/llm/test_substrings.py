import hashlib

import numpy as np
from hypothesis import given, settings, strategies as st

from msgshield.llm import substrings
from msgshield.llm.queries import QUERIES
from .helpers import SMALL, clashing, edge_docs, empty_docs, small_docs, words


def plain_report(docs, window=20):
    first = {}
    for i, t in docs:
        w = words(t)
        for s in range(len(w) - window + 1):
            k = tuple(w[s:s + window])
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = {}
    for i, t in docs:
        w, gone = words(t), set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < (i, s):
                gone.update(range(s, s + window))
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def report(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.substring_report(df).collect()}


def test_query_matches_brute_force(spark):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256)
           for r in QUERIES["op5_substring_dedup"](spark, SMALL).collect()}
    want = plain_report(small_docs())
    assert got == want and sum(v[1] for v in want.values()) > 0


def test_shared_passages_short_common_lines_and_repeats_in_one_text(spark, monkeypatch):
    rng = np.random.default_rng(5)

    def noise(n):
        return [f"n{v}" for v in rng.integers(0, 10 ** 9, n)]
    passage, line = noise(60), noise(12)
    docs = []
    for d in range(120):
        w = noise(30) + line + noise(25)
        if d % 3 == 0:
            a = int(rng.integers(0, 30))
            w += passage[a:a + 30] + noise(3)
        if d % 10 == 0:
            w += w[5:40]
        docs.append((d, " \n\t".join(w) if d % 2 else " ".join(w)))
    docs.append((120, "same word " * 200))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = plain_report(docs)
    assert report(frame) == want
    monkeypatch.setattr(substrings, "HOT_RUNS", 3)        # the routing of hot anchors changes no result
    assert report(frame) == want
    monkeypatch.setattr(substrings, "MAX_COMMON", 0)
    assert report(frame) == want


def test_edges(spark):
    got = report(edge_docs(spark))
    assert got == report(clashing(edge_docs(spark)))
    assert got[2][:2] == (0, 0) and got[3][:2] == (0, 0) and got[6][:2] == (3000, 0) and got[7][:2] == (3001, 3000)
    assert got[8][1] == 0 and got[1][1] == 0 and got[None][:2] == (6, 0)
    assert substrings.substring_report(empty_docs(spark)).count() == 0
    text = " ".join(f"t{i}" for i in range(25))
    twice = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in substrings.substring_report(twice).collect()) == [(0, 25), (1, 0), (1, 0)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=14), max_size=8))
def test_automata_locate_every_occurrence(rows):
    texts = [" ".join(map(str, r)) for r in rows if len(r) >= 3]
    found = substrings.locate(list(range(len(texts))), [0] * len(texts), texts, window=3)
    got = {(row, i) for row, s, e in found for i in range(s, e)}
    first, want = {}, set()
    for d, t in enumerate(texts):
        w = t.split(" ")
        for s in range(len(w) - 2):
            if first.setdefault(tuple(w[s:s + 3]), (d, s)) != (d, s):
                want.update((d, i) for i in range(s, s + 3))
    assert got == want


def test_words_beyond_one_character_each(monkeypatch):
    texts = ["a b c d e", "x b c d y", "b c d"]
    want = substrings.locate([0, 1, 2], [0, 5, 9], texts, window=3)
    monkeypatch.setattr(substrings, "_LETTERS", 2)
    assert substrings.locate([0, 1, 2], [0, 5, 9], texts, window=3) == want == [(1, 6, 9), (2, 9, 12)]


def test_many_texts_without_an_id(spark):
    """Texts of rows without an id are told apart, however many there are; each keeps its own words."""
    texts = [" ".join(f"u{i}x{j}" for j in range(2 + i % 29)) for i in range(30_000)]
    shared = " ".join(f"s{j}" for j in range(22))
    rows = [(1, shared)] + [(None, t + (" " + shared if i % 1000 == 0 else "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = substrings.substring_report(df).where("doc_id is null")
    sums = got.selectExpr("count(*)", "sum(n_words)", "sum(n_removed)", "count(distinct kept_sha256)").first()
    n = sum(2 + i % 29 for i in range(30_000))
    assert tuple(sums) == (30_000, n + 30 * 22, 30 * 22, 30_000)

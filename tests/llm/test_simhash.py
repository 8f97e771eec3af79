import numpy as np
from pyspark.sql import functions as F

from msgshield.llm import simhash
from msgshield.llm.components import connected_components
from .helpers import (DOCS, SMALL, clashing, components, edge_docs, empty_docs, majority_bits, rows, small_docs, words, xxh)


def plain_fingerprint(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return majority_bits([xxh(" ".join(w[i:i + 3])) for i in range(max(1, len(w) - 2))]) if w else 0


def plain_groups(fps):
    ids = sorted(fps)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (fps[a] ^ fps[b]).bit_count() <= 2]
    return components(ids, links)


def test_query_matches_brute_force(spark):
    from msgshield.llm.queries import QUERIES

    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id)
           for r in QUERIES["op2_simhash_dedup"](spark, SMALL).collect()}
    fps = {i: plain_fingerprint(t) for i, t in small_docs()}
    groups = plain_groups(fps)
    assert got == {i: (fps[i], groups[i]) for i in fps}
    assert any(groups[i] != i for i in fps)


def test_links_in_a_crowded_posting_match_all_pairs():
    rng = np.random.default_rng(3)
    base = np.uint64(0x0123456789ABCDEF)
    members = np.unique(base ^ (rng.integers(0, 1 << 16, 300).astype(np.uint64) << np.uint64(8)))
    a, b = simhash.star_links(members, simhash._flips(0xFFFF00, 2))
    want = components(members.tolist(), [(x, y) for x in members.tolist() for y in members.tolist()
                                         if x > y and (x ^ y).bit_count() <= 2])
    assert components(members.tolist(), zip(a.tolist(), b.tolist())) == want


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (1, 0)]
    got = rows(connected_components(spark.createDataFrame(edges, "a long, b long")))
    assert got == rows(spark.createDataFrame([(i, 0) for i in range(51)] + [(i, 100) for i in range(100, 160)], "n long, c long"))
    assert rows(connected_components(spark.createDataFrame([], "a long, b long"))) == []


def test_edges(spark):
    groups = simhash.simhash_groups(clashing(edge_docs(spark)))
    got = {r.doc_id: (r.fp, r.component_id) for r in groups.collect()}
    assert got[2] == (0, 2) and got[3] == (0, 2) and got[4] == (0, 2) and got[8][1] == 1
    assert groups.where("doc_id = 1").count() == 2 and got[None][1] is None
    kept = simhash.drop_near_duplicates(edge_docs(spark))
    assert [r[0] for r in rows(kept, "doc_id")].count(1) == 1 and kept.where("doc_id = 8").count() == 0
    assert kept.where("doc_id is null").count() == 1 and kept.where("doc_id in (3, 4)").count() == 0
    assert simhash.simhash_groups(empty_docs(spark)).count() == 0
    assert simhash.drop_near_duplicates(empty_docs(spark)).count() == 0


def test_hex_is_unsigned(spark):
    row = spark.range(1).select(simhash.hex_fingerprint(F.lit(-2)).alias("h"), simhash.hex_fingerprint(F.lit(10)).alias("z")).first()
    assert row == ("fffffffffffffffe", "000000000000000a")


def test_rows_without_an_id_or_that_share_one_keep_their_own_group(spark):
    texts = [f"words of text {n} that no other row has, {n * n} in all" for n in range(6)]
    docs = [(None, t, "en", "s", 9) for t in texts[:3]] + [(7, t, "en", "s", 9) for t in texts[3:]]
    docs += [(None, texts[0], None, "s", 9), (None, texts[1], "en", "s", 9), (9, texts[3], "en", "s", 9), (8, texts[2], "en", "s", 9)]
    got = simhash.drop_near_duplicates(spark.createDataFrame(docs, DOCS)).collect()
    assert sorted((r.text, r.doc_id or 0) for r in got) == sorted(zip(texts, (0, 0, 8, 7, 7, 7)))

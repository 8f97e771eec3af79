import math
import zlib

import numpy as np
import pytest

from msgshield.llm import toxicity
from msgshield.llm.queries import QUERIES
from .helpers import clashing, edge_docs, empty_docs

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in QUERIES["op10_toxicity"](spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == 10_000
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    test = [(got[i].predicted, y) for i, y in labels.items() if got[i].held_out]
    assert sum(p == y for p, y in test) >= 0.97 * len(test)
    assert sum(p for p, y in test if y) >= 0.85 * sum(y for _, y in test)
    assert sum(p for p, y in test if not y) <= 0.01 * len(test)


def test_swaps_stay_in_their_group():
    import random
    words = {"the", "women", "jewish", "idiot"}
    out = toxicity.swapped(words, random.Random(1))
    assert out > {"the", "idiot"} and not out & {"women", "jewish"} and len(out) == 4
    assert toxicity.swapped({"the", "idiot"}, random.Random(1)) is None


def test_penalty_stops_an_identity_term_from_carrying_the_score():
    rng = np.random.default_rng(0)
    # feature 0: insult, 1: an identity term that goes with toxic texts by chance, 2: its swap
    own, other, y = [], [], []
    for _ in range(400):
        toxic = int(rng.random() < 0.5)
        f = [0] if toxic and rng.random() < 0.9 else []
        named = rng.random() < (0.8 if toxic else 0.1)
        own.append(f + [1] if named else f)
        other.append(f + [2] if named else None)
        y.append(toxic)
    _, free = toxicity.fit_weights(own, y, other, 3, swap_penalty=0.0)
    bias, held = toxicity.fit_weights(own, y, other, 3, swap_penalty=10.0)
    assert free[1] - free[2] > 1.5 and abs(held[1] - held[2]) < 0.3 * (free[1] - free[2])
    assert held[0] > 2


def test_edges(spark):
    labels = spark.createDataFrame([(1, 1), (6, 0), (7, None), (None, 1), (77, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity_report(clashing(edge_docs(spark)), labels).collect()
    assert len(got) == 12 and all(0 < r.score < 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [True]
    by_id = {r.doc_id: r.score for r in got}
    assert by_id[2] == by_id[3]
    none = toxicity.toxicity_report(edge_docs(spark), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert toxicity.toxicity_report(empty_docs(spark), labels).count() == 0
    kept = toxicity.drop_toxic(edge_docs(spark), labels)
    assert kept.columns == edge_docs(spark).columns


def test_score_is_the_logistic_of_present_features():
    m = toxicity.ToxicityModel(-1.0, {"idiot": 3.0, "idio*": 0.5, "loser": 2.0})
    assert m.score("An IDIOT!! idiot,") == pytest.approx(1 / (1 + math.exp(-2.5)))
    assert m.score(None) == m.score("") == pytest.approx(1 / (1 + math.e))


def test_a_term_of_several_groups_is_swapped_in_each(spark):
    import random
    drawn = {next(iter(toxicity.swapped({"hindus"}, random.Random(i)))) for i in range(200)}
    assert {"christians", "christen"} <= drawn and "hindus" not in drawn
    drawn = {next(iter(toxicity.swapped({"mädchen"}, random.Random(i)))) for i in range(200)}
    assert {"frau", "frauen"} <= drawn

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from msgshield.llm import packing
from msgshield.llm.queries import QUERIES, tokenizer_path
from .helpers import EDGE_ROWS, SMALL, clashing, edge_docs, empty_docs, small_docs

tokenizers = pytest.importorskip("tokenizers")
TOKENIZER = tokenizers.Tokenizer.from_file(tokenizer_path())


def plain_ids(text):
    return np.array(TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def check(pieces, texts):
    """Every id in exactly one piece, sequences gapless; returns (tokens, padding)."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == set(texts)
    for i, ps in by_doc.items():
        ids, at = plain_ids(texts[i]), 0
        for p in sorted(ps, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    used = pad = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 1024
        used, pad = used + at, pad + (1024 - at if at & (at - 1) else 0)
    return used, pad


def test_round_trip_and_little_padding(spark):
    used, pad = check(QUERIES["op4_pack_sequences"](spark, SMALL).collect(), dict(small_docs()))
    assert pad < 0.01 * used


def test_edges(spark):
    once = [r for i, r in enumerate(EDGE_ROWS) if i != 1]
    docs = spark.createDataFrame(once, edge_docs(spark).schema)
    check(packing.pack(clashing(docs), tokenizer_path()).collect(), {r[0]: r[1] for r in once})
    twice = packing.pack(edge_docs(spark), tokenizer_path()).where("doc_id = 1").collect()
    assert sum(p.length for p in twice) == 2 * twice[0].doc_tokens
    assert packing.pack(empty_docs(spark), tokenizer_path()).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 1023), max_size=60))
def test_pack_rests_places_every_token_once(lengths):
    bins = packing.pack_rests(lengths)
    seen = defaultdict(list)
    for b in bins:
        assert 0 < sum(p[2] for p in b) <= 1024
        for item, start, length in b:
            seen[item].append((start, length))
    for i, n in enumerate(lengths):
        at = 0
        for start, length in sorted(seen.get(i, [])):
            assert start == at and length > 0
            at += length
        assert at == n
    loads = [sum(p[2] for p in b) for b in bins]
    assert all(x > 1024 - packing.MIN_FRAGMENT or x & (x - 1) == 0 for x in loads)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 1024), min_size=1, max_size=50))
def test_tree_is_first_fit(lengths):
    tree, rooms = packing.RoomTree(len(lengths), 1024), [1024] * len(lengths)
    for n in lengths:
        want = next(i for i, r in enumerate(rooms) if r >= n)
        rooms[want] -= n
        assert tree.first_fit(n) == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\t\r\x0b\x0c\x1c\x1f\x85\u00a0\u1680\u2028\u3000\u200bab'sLLt.1\u00b2\u00e9\u4e2d\U0001f600<|>", max_size=40))
def test_encoder_equals_the_tokenizer(text):
    encoder = packing.Encoder.of(tokenizer_path())
    for t in (text, text + "<|endoftext|>" + text, "a  b", "end \n ", "\n \n z"):
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == TOKENIZER.encode(t, add_special_tokens=False).ids

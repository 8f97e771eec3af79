import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings, strategies as st

from msgshield.llm import variants
from .helpers import clashing, edge_docs, edit_distance, empty_docs, rows


def plain_words(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def plain_groups(n):
    near = {w: [v for v in n if v != w and abs(len(v) - len(w)) < 2 and edit_distance(w, v) == 1] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def docs_of(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def some_docs():
    rng = random.Random(5)
    base = ["aaaaa", "aaaaaa", "banana", "bananas", "bandana", "straße", "strasse", "élève", "élèves", "Éleve", "tallest", "smallest", "a×b÷c"]
    base += ["".join(rng.choice("abß") for _ in range(rng.randint(5, 9))) for _ in range(120)]
    return [(i if i % 9 else None, " ".join(rng.choices(base, weights=[1 + 2000 // (k + 1) for k in range(len(base))], k=200)).title()
             if i % 4 == 0 else " ".join(rng.choices(base, k=200))) for i in range(40)] + [(1, None), (2, "")]


def test_groups_match_brute_force(spark):
    docs = some_docs()
    want = plain_groups(plain_words(docs))
    got = sorted(tuple(r) for r in variants.variant_groups(docs_of(spark, docs)).collect())
    assert got == want and sum(w[1] is not None for w in want) > 10


def test_pairs_match_with_many_and_no_long_grams(spark):
    words = sorted(plain_words(some_docs()))
    want = {tuple(sorted((a, b), key=lambda w: (len(w), w))) for a in words for b in words if a < b and edit_distance(a, b) == 1}
    table = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    for share in (1, 20, 10 ** 9):
        got = {(r.a, r.b) for r in variants.near_pairs(table, share).collect()}
        assert got == want, share


letters = st.text("abcß", min_size=5, max_size=9)


@settings(max_examples=300, deadline=None)
@given(letters, st.integers(0, 8), st.sampled_from("abcdß"), st.integers(0, 2), st.sets(st.text("^$abcß", min_size=2, max_size=3)))
def test_one_edit_always_shares_a_short_list(word, at, char, kind, frequent):
    at = at % len(word)
    other = (word[:at] + char + word[at + 1:], word[:at] + char + word[at:], word[:at] + word[at + 1:])[kind]
    if len(other) < 5 or other == word:
        return
    counts = {g: 9 for g in frequent}
    a, b = sorted((word, other), key=len)
    lists = set(variants.short_lists(b, counts))
    assert any((g, p) in lists or (len(a) < len(b) and (g, p + 1) in lists) for g, p in variants.short_lists(a, counts))


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i:03d}", f"w{i + 1:03d}") for i in range(40)]
    got = dict(tuple(r) for r in variants._followed(spark.createDataFrame(chain, "word string, form string")).collect())
    assert got == {w: "w040" for w, _ in chain}


def test_edges(spark):
    assert variants.variant_groups(empty_docs(spark)).count() == 0
    odd = clashing(edge_docs(spark)).withColumnRenamed("doc", "word").withColumnRenamed("tie", "n")
    assert rows(variants.variant_groups(odd, least=1)) == rows(variants.variant_groups(edge_docs(spark), least=1))

import re
from collections import Counter

from pyspark.sql import functions as F

from msgshield.llm import collocations
from .helpers import clashing, edge_docs, empty_docs, rows


def plain(texts, max_words=3, least=10, share=50):
    """``{(lang, phrase): (a, l, r, n, score)}`` by direct counting."""
    f, n = Counter(), Counter()
    for text, lang in texts:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in cand.items():
        inside = [b for (other, q), b in cand.items() if other == lang and len(q) > len(p)
                  and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * b >= share * a for b in inside):
            continue
        cuts = [(1000000 * a * a // (f[lang, p[:c]] * f[lang, p[c:]]), c) for c in range(1, len(p))]
        score, c = min(cuts)
        out[lang, " ".join(p)] = (a, f[lang, p[:c]], f[lang, p[c:]], n[lang], score)
    return out


TEXTS = ([("New York city is big. New York is far, new york!", "en")] * 4 + [("der alte Mann\tund der alte Hund; der alte Mann", "de")] * 5
         + [("ha ha ha ha ha ha ha ha ha ha ha ha", None), ("of the\nof the of the of the", "en"), ("x", "en"), (None, "en"), ("", None)]
         + [("a b c d a b c d a b c d", "xx")] * 4)


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, l, "s", 0) for i, (t, l) in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars int")


def found(df):
    return {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def test_against_direct_counts(spark):
    for words in (2, 3, 4):
        assert found(collocations.collocations(docs_of(spark, TEXTS), max_words=words)) == plain(TEXTS, words)
    assert ("und", "ha ha ha") in plain(TEXTS)


def test_joins_beyond_the_broadcast_bound_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BROADCAST_ROWS", 0)
    assert found(collocations.collocations(docs_of(spark, TEXTS))) == plain(TEXTS)


def test_ranks_and_ties(spark):
    got = collocations.collocations(docs_of(spark, TEXTS), top=2).orderBy("lang", "rank").collect()
    want = sorted(((l, -v[4], -v[0], p) for (l, p), v in plain(TEXTS).items()))
    for lang in {r.lang for r in got}:
        assert [(r.rank, r.phrase) for r in got if r.lang == lang] == [
            (i + 1, w[3]) for i, w in enumerate([w for w in want if w[0] == lang][:2])]


def test_products_beyond_64_bits_are_exact(spark):
    a, l = 10 ** 12 + 1, 10 ** 12 + 7
    row = spark.sql(f"select (cast({a} as decimal(19,0)) * cast({a} as decimal(19,0)) * cast(1000000 as decimal(7,0))) "
                    f"div (cast({l} as decimal(19,0)) * cast({l} as decimal(19,0)))").first()
    assert row[0] == 1000000 * a * a // (l * l)


def test_edges(spark):
    assert collocations.collocations(empty_docs(spark)).count() == 0
    odd = clashing(edge_docs(spark)).withColumnRenamed("doc", "piece").withColumnRenamed("tie", "g")
    assert rows(collocations.collocations(odd, least=2)) == rows(collocations.collocations(edge_docs(spark), least=2))
    long = docs_of(spark, [(" ".join(f"w{i % 50}" for i in range(5000)), "en")])
    assert found(collocations.collocations(long, max_words=2)) == plain([(" ".join(f"w{i % 50}" for i in range(5000)), "en")], 2)


def test_occurrences_are_not_shuffled_to_be_looked_up_in_a_large_table(spark, monkeypatch):
    """However many phrases are frequent, theirs and few other occurrences are written, by a bitmap; one with hardly a
    bit free lets more through and changes no result."""
    table = spark.range(0, 3000, 3).select(F.col("id").alias("g1"), (F.col("id") * 7).alias("g2"))
    grown = spark.range(3000).select(F.lit(1).alias("piece"), F.col("id").cast("int").alias("pos"), F.col("id").alias("g1"), (F.col("id") * 7).alias("g2"))
    monkeypatch.setattr(collocations, "BROADCAST_ROWS", 0)
    kept = collocations._may_be_in(grown, table, ["g1", "g2"])
    assert kept.columns == grown.columns and "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
    pos = {r.pos for r in kept.collect()}
    assert set(range(0, 3000, 3)) <= pos and len(pos) < 1010
    monkeypatch.setattr(collocations, "BITMAP_BITS", 64)
    monkeypatch.setattr(collocations, "ROW_BITS", 64)
    assert collocations._may_be_in(grown, table, ["g1", "g2"]).count() > 2900
    assert found(collocations.collocations(docs_of(spark, TEXTS), max_words=4)) == plain(TEXTS, 4)


def test_words_are_counted_over_batches(spark, monkeypatch):
    docs = docs_of(spark, TEXTS * 3).select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    want = rows(collocations.word_counts(docs))
    monkeypatch.setattr(collocations, "_OUT_ROWS", 1)
    assert rows(collocations.word_counts(docs)) == want and sum(r[2] for r in want) == 3 * collocations.word_counts(
        docs_of(spark, TEXTS).select(F.coalesce("text", F.lit("")).alias("text"), "lang")).agg(F.sum("n")).first()[0]

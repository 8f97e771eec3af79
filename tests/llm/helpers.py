"""Small tables and plain-Python versions the operators are held against."""

from __future__ import annotations

import re

import duckdb
import numpy as np
import xxhash

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

LONG = " ".join(f"w{i}" for i in range(3000))
EDGE_ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away", "en", "b", 61),
    (1, "the quick brown fox jumps over the lazy dog and runs far away", "en", "b", 61),   # repeated row
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \t\n ", "en", "a", 4),
    (None, "no id here but some words", None, "a", 25),
    (5, "één twee\ndrie één\n\npassword = hunter2secret", "fr", None, 40),
    (6, LONG, "en", "a", len(LONG)),
    (7, LONG + " tail", "en", "b", len(LONG) + 5),
    (8, "the quick brown fox jumps over the lazy dog and runs far away", "en", "c", 61),
    (9, "a", "en", "c", 1),
    (10, "x y", "en", "Ä", 3),
]


def edge_docs(spark):
    return spark.createDataFrame(EDGE_ROWS, DOCS)


def clashing(df):
    """The same rows with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ["size", "fp", "bucket", "h", "words", "sketch", "blob", "spans", "doc", "tie", "line", "score", "grp", "path"]
    return df.select("*", *[F.lit(f"x{n}").alias(n) for n in names])


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def small_docs():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()


def words(text):
    return WORD.findall(text or "")


def components(nodes, links):
    """Smallest reachable node of every node."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def majority_bits(hashes):
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return sum(1 << b for b in range(64) if 2 * int(bits[:, b].sum()) > len(hashes))


def xxh(text):
    return xxhash.xxh64_intdigest(text.encode(), 42)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def rows(df, *keys):
    return sorted((tuple(r) for r in (df.select(*keys) if keys else df).collect()), key=repr)

"""SimHash near-duplicates through a byte-position inverted index.

A fingerprint has eight bytes; two fingerprints that differ in at most ``d`` bits
differ in at most ``d`` bytes, so they share at least ``8 - d`` positional bytes:
the guaranteed minimum of matches. The postings of single bytes are merged before
anything is paired: each posting is one choice of ``8 - d`` byte positions with the
bytes there, so a pair under one posting has its minimum tally by construction, and
pairs below it never meet. A posting holds fingerprints that differ in ``d`` bytes only,
at most ``256 ** d`` of them (65,536 for two bits), which bounds every group.

Inside a posting the remaining bits are verified: a member's neighbours are the
fingerprints with up to ``d`` of the free bits flipped, looked up in the sorted
members, so a group of n costs n times the number of flips and never all pairs. Links
come back as one star per connected part of a posting. Exact fingerprint copies are one
class from the start.

Defined results: null and empty texts have fingerprint zero; a null id never
represents a component that has an id; repeated rows share a class; empty
input gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import DOCUMENT_COLUMNS, prepare, written
from .components import connected_components

SHINGLE = 3
MAX_DISTANCE = 2
HASH_SEED = 42
_CHUNK = 1 << 16           # shingles whose bits are counted at once


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text (ASCII lower-cased)."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, HASH_SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    hashes = np.fromiter((digest(joined[a:b], HASH_SEED) for a, b in
                          zip(starts[:n].tolist(), ends[shingle - 1:].tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        part = np.ascontiguousarray(hashes[i:i + _CHUNK]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, also: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a signed long, and the columns ``also``."""
    def batches(it):
        for batch in it:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t or b"", shingle) for t in texts], np.uint64).view(np.int64)
            rest = [batch.column(i) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), *rest], ["doc_id", "fp", *also])

    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", *also)}
    return docs.select("doc_id", "text", *also).mapInArrow(
        batches, ", ".join([f"doc_id {kinds['doc_id']}", "fp long", *[f"{c} {kinds[c]}" for c in also]]))


def _masks(max_distance: int) -> list[int]:
    """One mask per choice of byte positions that must agree."""
    keep = 8 - max_distance
    return [sum(0xFF << (8 * p) for p in chosen) for chosen in combinations(range(8), keep)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _flips(free: int, max_distance: int) -> np.ndarray:
    bits = [1 << i for i in range(64) if free >> i & 1]
    return np.array([sum(c) for k in range(1, max_distance + 1) for c in combinations(bits, k)], np.uint64)


def star_links(members: np.ndarray, flips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members that reach another by flips, each with the smallest member of its part."""
    values = np.unique(members)
    parent = np.arange(len(values))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for flip in flips:
        other = values ^ flip
        at = np.minimum(np.searchsorted(values, other), len(values) - 1)
        for i in np.flatnonzero((values[at] == other) & (other < values)):
            a, b = root(i), root(at[i])
            parent[max(a, b)] = min(a, b)
    roots = np.array([root(i) for i in range(len(values))])
    linked = np.flatnonzero(roots != np.arange(len(values)))
    return values[linked], values[roots[linked]]


def links(classes: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Star links ``(a, b)`` between distinct fingerprints within ``max_distance`` bits."""
    masks = _masks(max_distance)
    flips = [_flips(~m & (1 << 64) - 1, max_distance) for m in masks]
    postings = (classes.select("fp", F.posexplode(F.array(*[F.lit(_signed(m)) for m in masks])))
                       .withColumn("shared", F.col("fp").bitwiseAND(F.col("col")))
                       .groupBy("pos", "shared").agg(F.collect_list("fp").alias("members"))
                       .where(F.size("members") > 1))

    @F.pandas_udf("array<struct<a:long,b:long>>")
    def verified(pos: pd.Series, members: pd.Series) -> pd.Series:
        out = []
        for p, m in zip(pos, members):
            a, b = star_links(np.asarray(m, np.int64).view(np.uint64), flips[p])
            out.append([{"a": x, "b": y} for x, y in zip(a.view(np.int64).tolist(), b.view(np.int64).tolist())])
        return pd.Series(out)

    return postings.select(F.explode(verified("pos", "members")).alias("e")).select("e.a", "e.b").distinct()


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE,
                   also: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, fp, component_id, group_fp)`` and the columns ``also`` for every row of ``docs``.

    ``component_id`` is the smallest id in the connected group (null only if the
    group has no id), ``group_fp`` a fingerprint that names the group.
    """
    prepare(docs.sparkSession)
    fps = written(fingerprints(docs, shingle, also), "simhash")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-classes")
    comp = connected_components(links(classes, max_distance))
    grouped = classes.join(comp, classes["fp"] == comp["node"], "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("group_fp"))
    lows = grouped.groupBy("group_fp").agg(F.min("low").alias("component_id"))
    members = grouped.join(lows, "group_fp").select("fp", "group_fp", "component_id")
    return fps.join(members, "fp").select("doc_id", "fp", "component_id", "group_fp", *also)


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Documents with one row of each group left: the one with the smallest id (a row without
    an id comes last), and of several such rows the one with the smallest hash."""
    values = DOCUMENT_COLUMNS[1:]
    # Rows that repeat an id (or have none) are told apart by their values; the second hash tells nulls apart.
    rows = (docs.select(*DOCUMENT_COLUMNS)
                .withColumn("_h", F.xxhash64(*values))
                .withColumn("_g", F.xxhash64(*[F.col(c).isNull() for c in values], *reversed(values))))
    groups = simhash_groups(rows, shingle, max_distance, ("_h", "_g"))
    first = (groups.groupBy("group_fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_h", "_g")).alias("at"))
                   .select(F.col("at.doc_id").alias("_id"), F.col("at._h").alias("_ah"), F.col("at._g").alias("_ag")))
    order = Window.partitionBy("doc_id", "_h", "_g").orderBy("_h")      # rows equal in every column
    return (rows.join(first, rows["doc_id"].eqNullSafe(first["_id"]) & (F.col("_h") == F.col("_ah")) & (F.col("_g") == F.col("_ag")))
                .withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*DOCUMENT_COLUMNS))

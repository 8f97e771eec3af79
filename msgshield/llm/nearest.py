"""Approximate nearest neighbours by an inverted multi-index.

Each half of a unit vector is quantised on its own; a cell is a pair of centroids. A
query walks the cells in the order of its summed distance to their two centroids, with a heap over
the two sorted centroid lists (multi-sequence traversal), until the cells hold
``visit`` of all vectors, and its candidates are re-ranked by exact cosine.

Codebooks are fitted on at most ``SAMPLE_ROWS`` vectors drawn by hash, every vector is
indexed. Cell counts (centroids squared, a fixed bound) are the only thing the
driver holds. Cells are laid out into blocks of about ``BLOCK_ROWS`` vectors, a large
cell over several, and a block with many queries is met in several portions, so
a group has a bounded number of rows on either side. Equal vectors are indexed and
searched once, with the smallest ids they have. Where a block keeps its best candidates, those
within ``ROUNDING`` of the last are told apart by the exact cosine and then by id.

Defined results: vectors that are null, empty, zero, of another length than most, or hold
a null or non-finite component take no part; a null id is no candidate and no query;
repeated ids count once per vector; fewer candidates than asked are all returned.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from .common import prepare, written

NEIGHBOURS = 5
SAMPLE_ROWS = 20_000
CENTROIDS = 32             # per half
VISIT = 0.6                # share of all vectors a query's cells hold
BLOCK_ROWS = 4096
PORTION_QUERIES = 4096
ROUNDS = 15
SEED = 5
ROUNDING = 1e-9            # more than a product of unit vectors is off


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v)`` of vectors that take part, as doubles."""
    big = F.lit(float("inf"))
    ok = (F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
          & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
          & F.exists("embedding", lambda x: x != 0))
    rows = vectors.select("vec_id", "embedding").where(ok).select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    most = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    return rows.where(F.size("v") == most["n"]) if most else rows


def _unit(rows) -> np.ndarray:
    x = np.array(list(rows), np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None], 0)


def fit_codebook(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = _distances(x, centres).argmin(1)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, need: int) -> list[tuple[int, int]]:
    """Cells in ascending summed distance until they hold ``need`` vectors."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, cells, held = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < need:
        _, i, j = heapq.heappop(heap)
        n = counts[a[i], b[j]]
        if n:
            cells.append((int(a[i]), int(b[j])))
            held += n
        for i2, j2 in ((i + 1, j), (i, j + 1)):
            if i2 < len(a) and j2 < len(b) and (i2, j2) not in seen:
                seen.add((i2, j2))
                heapq.heappush(heap, (first[a[i2]] + second[b[j2]], i2, j2))
    return cells


def _blocks(counts: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of every cell, cells laid out in order."""
    first, many = np.zeros(counts.size, np.int64), np.ones(counts.size, np.int64)
    block = held = 0
    for cell, n in enumerate(counts.ravel()):
        if held and held + n > block_rows:
            block, held = block + 1, 0
        first[cell], many[cell] = block, max(1, math.ceil(n / block_rows))
        held += n
        if many[cell] > 1:
            block, held = block + many[cell], 0
    return first, many


def search(vectors: DataFrame, queries, neighbours: int = NEIGHBOURS, centroids: int = CENTROIDS,
           visit: float = VISIT, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS,
           portion: int = PORTION_QUERIES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``; ``queries`` is a condition on ``vec_id``."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = usable(vectors).withColumn("same", F.md5(F.to_json("v").cast("binary")))
    members = written(rows.select("vec_id", "same").distinct(), "ann-members")
    few = Window.partitionBy("same").orderBy("vec_id")
    kept = (members.withColumn("n", F.row_number().over(few)).where(F.col("n") <= neighbours + 1))
    # ``rep`` names a vector, ``least`` is its smallest id; an id with several vectors is in several classes.
    kept = written(kept.groupBy("same").agg(F.min("vec_id").alias("least"),
                                            F.array_sort(F.collect_list("vec_id")).alias("ids"))
                       .withColumn("rep", F.monotonically_increasing_id()), "ann-classes")
    distinct = written(rows.join(kept, (rows["vec_id"] == kept["least"]) & (rows["same"] == kept["same"]))
                           .groupBy("rep", "least").agg(F.first("v").alias("v")), "ann-vectors")
    wanted = written(members.where(queries).join(kept.select("same", "rep"), "same").select(
        F.col("vec_id").alias("query_id"), "rep"), "ann-queries")
    out = "query_id long, rank int, vec_id long, score double"
    drawn = distinct.orderBy(F.xxhash64("v", F.lit(SEED)), "least").limit(sample_rows).select("v").collect()
    if not drawn:
        return spark.createDataFrame([], out)
    x = _unit(r["v"] for r in drawn)
    half = (x.shape[1] + 1) // 2
    books = spark.sparkContext.broadcast([fit_codebook(x[:, :half], centroids), fit_codebook(x[:, half:], centroids)])
    shape = tuple(len(b) for b in books.value)

    @F.pandas_udf("int")
    def cell_of(v: pd.Series) -> pd.Series:
        one, two = books.value
        u = _unit(v)
        return pd.Series(_distances(u[:, :half], one).argmin(1) * len(two) + _distances(u[:, half:], two).argmin(1))

    index = written(distinct.withColumn("cell", cell_of("v")), "ann-index")
    counts = np.zeros(shape[0] * shape[1], np.int64)
    for r in index.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    counts = counts.reshape(shape)
    first, many = _blocks(counts, block_rows)
    layout = spark.sparkContext.broadcast((counts, first, many, max(neighbours + 1, math.ceil(visit * counts.sum()))))

    def probes(it):
        for frame in it:
            cells, first, many, need = layout.value
            one, two = books.value
            u = _unit(frame["v"])
            da, db = _distances(u[:, :half], one), _distances(u[:, half:], two)
            found = []
            for i, rep in enumerate(frame["rep"]):
                by_block: dict[int, list] = {}
                for a, b in walk(da[i], db[i], cells, need):
                    cell = a * len(two) + b
                    for block in range(first[cell], first[cell] + many[cell]):
                        by_block.setdefault(block, []).append(cell)
                found += [(rep, frame["v"].iloc[i], block, cs) for block, cs in by_block.items()]
            yield pd.DataFrame(found, columns=["rep", "v", "block", "cells"])

    asked = (distinct.join(wanted.select("rep").distinct(), "rep")
                     .mapInPandas(probes, "rep long, v array<double>, block long, cells array<int>"))
    asked = written(asked, "ann-probes")
    portions = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / portion).cast("long").alias("portions"))

    @F.pandas_udf("long")
    def block_of(cell: pd.Series, rep: pd.Series) -> pd.Series:
        _, first, many, _ = layout.value
        return pd.Series(first[cell] + rep.to_numpy() % many[cell])

    there = (index.withColumn("block", block_of("cell", F.abs(F.xxhash64("rep")) % 1_000_003)).join(portions, "block")
                  .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("portions") - 1)))
                  .drop("portions"))
    asked = (asked.join(portions, "block")
                  .withColumn("part", F.pmod(F.xxhash64("rep"), F.col("portions"))).drop("portions"))
    take = neighbours + 3

    def rank(key, have: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if have.empty or ask.empty:
            return pd.DataFrame({"q": [], "c": []})
        whole, asked = (np.array(list(side["v"]), np.float64) for side in (have, ask))
        u, to, reps, least, cell = _unit(whole), _unit(asked), *(have[c].to_numpy() for c in ("rep", "least", "cell"))
        at = pd.Series(range(len(cell))).groupby(cell).indices
        qs, cs = [], []
        for i, (q, cells) in enumerate(zip(ask["rep"], ask["cells"])):
            rows = np.concatenate([at[c] for c in cells if c in at] or [np.zeros(0, np.int64)])
            if len(rows):
                best = rows
                if len(rows) > take:
                    near = u[rows] @ to[i]
                    some = rows[near >= np.partition(near, -take)[-take] - ROUNDING]
                    best = some[np.lexsort((least[some], -_exact(asked[i], whole[some])))[:take]] if len(some) > take else some
                qs.append(np.full(len(best), q))
                cs.append(reps[best])
        if not qs:
            return pd.DataFrame({"q": [], "c": []})
        return pd.DataFrame({"q": np.concatenate(qs), "c": np.concatenate(cs)})

    pairs = there.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(rank, "q long, c long")
    score = _cosine("qv", "cv")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "least")
    ranked = (pairs.join(distinct.select(F.col("rep").alias("q"), F.col("v").alias("qv")), "q")
                   .join(distinct.select(F.col("rep").alias("c"), "least", F.col("v").alias("cv")), "c")
                   .withColumn("score", score).select("q", "c", "least", "score"))
    classes = ranked.withColumn("n", F.row_number().over(best)).where(F.col("n") <= take).drop("n", "least")
    classes = written(classes.join(kept.select(F.col("rep").alias("c"), "ids"), "c"), "ann-found")
    each = (wanted.join(classes, wanted["rep"] == classes["q"])
                  .select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id"))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (each.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= neighbours)
                .select("query_id", "rank", "vec_id", "score"))


def _exact(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """:func:`_cosine` of ``q`` and every row, summed in the same order."""
    def total(x):
        return np.cumsum(x, axis=-1)[..., -1]
    return total(rows * q) / (np.sqrt(total(q * q)) * np.sqrt(total(rows * rows)))


def _cosine(a: str, b: str):
    """Cosine in double precision, summed in the order of the components."""
    def total(x):
        return F.aggregate(x, F.lit(0.0), lambda s, t: s + t)

    def dot(x, y):
        return total(F.zip_with(x, y, lambda s, t: s * t))
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))

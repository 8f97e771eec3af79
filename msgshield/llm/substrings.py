"""Substring dedup with sharded repeated-phrase automata.

A window is ``WINDOW`` consecutive words of one document; every word covered by a window that
also starts earlier is removed. The order of windows is (id, start).

1. *Recurring passages.* Each window has an anchor: the smallest hash among the ``GRAM``-word
   grams inside it. Equal windows have equal anchors at equal places, so they meet under
   their anchor. Consecutive windows with one anchor are a run (at most ``WINDOW - GRAM +
   1`` windows), about one run for seven words. Runs are grouped by anchor: an anchor seen once
   is dropped; a run equal to an earlier run is removed whole; what is left are anchors with
   different runs, which may share some windows.
2. *Automata.* Those runs' words are routed to shards by anchor. A shard confirms the
   windows that recur, word for word, compiles them into an Aho-Corasick automaton
   (one character per distinct word) that knows each window's first place, and streams
   all its runs through it to locate every occurrence.
3. Spans are gathered per document and applied to whole texts.

Every document passes steps 1 and 3; routing by anchor instead of streaming every document
through every shard keeps the work in proportion to the input.

Skew: equal runs of one batch travel once. Anchors that a sample of documents shows to be
common (a short line that many documents share) are not grouped as such, their windows
travel one by one under their own hash; the sample steers routing only. An anchor
with more than ``HOT_RUNS`` runs is routed window by window as well.

Defined results: null text has no words; texts shorter than a window lose nothing; rows
without an id come after all others; rows that share an id count as one document, so
they do not remove each other's equal windows at the same start; no rows give no rows.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import prepare, written

WINDOW = 20
GRAM = 6
HOT_RUNS = 256
SHARD_RUNS = 20_000
SAMPLE_DOCS = 10_000       # steers routing of common anchors only
COMMON_SHARE = 200         # an anchor in over 1 of so many sampled documents is common
MAX_COMMON = 10_000
_LAST = (1 << 63) - 1
_CACHE = 700_000
_NWIN_BITS = 4
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), 0xC2B2AE3D27D4EB4F
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class _WordHashes(dict):
    def __missing__(self, word):
        value = xxhash.xxh64_intdigest(word)
        if len(self) < _CACHE:
            self[word] = value
        return value


_HASHES = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int):
    """Powers of the prefix hash's base, and of its inverse, for n words."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_P2, pow(_P2, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def runs_of(words: list, common: np.ndarray | None = None):
    """``(start, windows, anchor, run hash)`` arrays of a document's runs, or None if too short."""
    n = len(words)
    if n < WINDOW:
        return None
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    grams = np.zeros(n - GRAM + 1, np.uint64)
    for t in range(GRAM):
        grams = grams * _P1 + h[t:t + len(grams)]
    grams = _mix(grams)
    inside = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - GRAM + 1)
    place = inside.argmin(axis=1) + np.arange(len(inside))
    start = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
    windows = np.diff(np.append(start, len(place)))
    anchor = grams[place[start]]
    powers, inverse = _powers(n)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers)))
    if common is not None and len(common):
        hot = np.isin(anchor, common)
        if hot.any():
            each = np.repeat(np.arange(len(start)), np.where(hot, windows, 1))
            within = np.arange(len(each)) - np.searchsorted(each, each)
            single = hot[each]
            start, windows, anchor = start[each] + np.where(single, within, 0), np.where(single, 1, windows[each]), anchor[each]
            run = _mix((prefix[start + windows + WINDOW - 1] - prefix[start]) * inverse[start])
            return start, windows, np.where(single, _mix(anchor ^ run), anchor), run
    run = _mix((prefix[start + windows + WINDOW - 1] - prefix[start]) * inverse[start])
    return start, windows, anchor, run


def _base(docs: DataFrame) -> DataFrame:
    """``doc`` orders documents (null last); ``doc, tie`` name a text."""
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"),
                       tie.alias("tie"), "text")


def _words(column) -> list:
    return [(t or b"").split() for t in column.cast(pa.binary()).to_pylist()]


def _common_anchors(base: DataFrame, count: int) -> np.ndarray:
    """Anchors of many sampled documents, at most ``MAX_COMMON``."""
    def anchors(it):
        for batch in it:
            found = [np.unique(r[2]) for r in map(runs_of, _words(batch.column(0))) if r]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(found or [np.zeros(0, np.uint64)]).view(np.int64))], ["anchor"])

    of = max(1, count // SAMPLE_DOCS)
    sample = base.where(F.pmod(F.xxhash64("doc", "tie"), F.lit(of)) == 0).select("text")
    least = max(8, min(count, SAMPLE_DOCS) // COMMON_SHARE)
    rows = (sample.mapInArrow(anchors, "anchor long").groupBy("anchor").count().where(F.col("count") > least)
                  .orderBy(F.desc("count"), "anchor").limit(MAX_COMMON).select("anchor").collect())
    return np.sort(np.array([r[0] for r in rows], np.int64).view(np.uint64))


def _runs(base: DataFrame, common: np.ndarray) -> DataFrame:
    """``(anchor, run, doc, tie, pos)``; ``pos`` packs start, a mark for runs that repeat in
    the batch (they travel under a random anchor) and number of windows."""
    shared = base.sparkSession.sparkContext.broadcast(common)

    def batches(it):
        for batch in it:
            found = [runs_of(w, shared.value) for w in _words(batch.column(2))]
            which = [i for i, r in enumerate(found) if r]
            if not which:
                continue
            sizes = [len(found[i][0]) for i in which]
            start, windows, anchor, run = (np.concatenate([found[i][c] for i in which]) for c in range(4))
            doc = np.repeat(batch.column(0).to_numpy(zero_copy_only=False)[which], sizes)
            tie = np.repeat(batch.column(1).to_numpy(zero_copy_only=False)[which], sizes)
            order = np.lexsort((start, doc, run, anchor))
            a, r, d, s = anchor[order], run[order], doc[order], start[order]
            new = np.append(True, (a[1:] != a[:-1]) | (r[1:] != r[:-1]))
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            again = np.empty(len(order), bool)
            again[order] = (d != d[first]) | (s != s[first])
            anchor = np.where(again, _mix(anchor + doc.astype(np.uint64) * _P1 + start.astype(np.uint64)), anchor)
            pos = (start.astype(np.int64) << 32) | (again.astype(np.int64) << 31) | windows
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(run.view(np.int64)), pa.array(doc), pa.array(tie), pa.array(pos)],
                ["anchor", "run", "doc", "tie", "pos"])

    return base.select("doc", "tie", "text").mapInArrow(batches, "anchor long, run long, doc long, tie long, pos long")


def _recurring(runs: DataFrame) -> DataFrame:
    """Runs to remove whole (``later``), and first runs of anchors with several runs."""
    same_anchor, same_run = Window.partitionBy("anchor"), Window.partitionBy("anchor", "run").orderBy("doc", "pos")
    start = F.shiftright("pos", 32)
    marked = F.shiftright("pos", 31).bitwiseAND(1) == 1
    placed = (runs.withColumn("first_doc", F.first("doc").over(same_run))
                  .withColumn("first_start", F.shiftright(F.first("pos").over(same_run), 32))
                  .withColumn("several", F.min("run").over(same_anchor) != F.max("run").over(same_anchor))
                  .withColumn("hot", F.count(F.lit(1)).over(same_anchor) > HOT_RUNS))
    later = marked | (F.col("doc") != F.col("first_doc")) | (start != F.col("first_start"))
    return placed.withColumn("later", later).where("later or several").select(
        "doc", "tie", start.cast("int").alias("start"), F.col("pos").bitwiseAND((1 << _NWIN_BITS) - 1).cast("int").alias("windows"),
        "anchor", "hot", "later")


def _routed(base: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(key, doc, tie, start, words)``: the words of the runs to compare, by shard key."""
    lists = candidates.groupBy("doc", "tie").agg(
        F.collect_list(F.struct("start", "windows", "anchor", "hot")).alias("runs"))

    def batches(it):
        for batch in it:
            rows = []
            for doc, tie, text, runs in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
                if runs is None:
                    continue
                words = text.encode().split()
                for r in runs:
                    s, n = r["start"], r["windows"]
                    if not r["hot"]:
                        rows.append((r["anchor"], doc, tie, s, b" ".join(words[s:s + n + WINDOW - 1])))
                        continue
                    for i in range(s, s + n):
                        one = b" ".join(words[i:i + WINDOW])
                        rows.append((xxhash.xxh64_intdigest(one) >> 1, doc, tie, i, one))
            for i in range(0, len(rows), 10_000):
                cols = list(zip(*rows[i:i + 10_000]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                     pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.binary()).cast(pa.string())],
                    ["key", "doc", "tie", "start", "words"])

    return base.join(lists, ["doc", "tie"], "left").select("doc_id", "doc", "tie", "text", "runs").mapInArrow(
        batches, "key long, doc long, tie long, start int, words string")


def _letter(number: int) -> str:
    """One character per word number, the surrogate range left out."""
    return chr(number + 1 if number + 1 < 0xD800 else number + 1 + 0x800)


_LETTERS = 0x110000 - 0x801


def locate(docs, starts, texts, window: int = WINDOW) -> list:
    """``(row, start, stop)`` of words covered by windows with an earlier occurrence.

    Windows that recur among the rows are compiled into an automaton that holds each
    window's first (document, start); all rows are streamed through it.
    """
    rows = [t.split(" ") for t in texts]
    numbers: dict[str, int] = {}
    for row in rows:
        for word in row:
            numbers.setdefault(word, len(numbers))
    # A shard with more words than there are characters writes each word as two.
    wide = len(numbers) > _LETTERS
    if wide:
        letters = {w: _letter(n // 1_000_000) + _letter(n % 1_000_000) for w, n in numbers.items()}
    else:
        letters = {w: _letter(n) for w, n in numbers.items()}
    width = 2 if wide else 1
    step = window * width
    coded = ["".join(map(letters.__getitem__, row)) for row in rows]
    first: dict[str, tuple] = {}
    confirmed = set()
    for doc, start, code in zip(docs, starts, coded):
        for i in range(0, len(code) - step + 1, width):
            phrase, place = code[i:i + step], (doc, start + i // width)
            known = first.get(phrase)
            if known is None:
                first[phrase] = place
            elif known != place:
                confirmed.add(phrase)
                if place < known:
                    first[phrase] = place
    if not confirmed:
        return []
    automaton = ahocorasick.Automaton()
    for phrase in confirmed:
        automaton.add_word(phrase, first[phrase])
    del first
    automaton.make_automaton()
    out = []
    for at, (doc, start, code) in enumerate(zip(docs, starts, coded)):
        low = high = -1
        for end, place in automaton.iter(code):
            if (end + 1) % width:
                continue
            here = start + (end + 1 - step) // width
            if place == (doc, here):
                continue
            if here > high:
                if low >= 0:
                    out.append((at, low, high))
                low = here
            high = here + window
        if low >= 0:
            out.append((at, low, high))
    return out


def _located(routed: DataFrame, shards: int) -> DataFrame:
    def one_shard(frame: pd.DataFrame) -> pd.DataFrame:
        found = locate(frame["doc"].tolist(), frame["start"].tolist(), frame["words"].tolist())
        rows = np.array([f[0] for f in found], np.int64)
        return pd.DataFrame({"doc": frame["doc"].to_numpy()[rows], "tie": frame["tie"].to_numpy()[rows],
                             "s": np.array([f[1] for f in found], np.int32),
                             "e": np.array([f[2] for f in found], np.int32)})

    return routed.groupBy(F.pmod("key", F.lit(shards)).alias("shard")).applyInPandas(
        one_shard, "doc long, tie long, s int, e int")


def with_spans(docs: DataFrame) -> DataFrame:
    """``(doc_id, doc, tie, text, spans)``: the words to remove as spans (null: none)."""
    prepare(docs.sparkSession)
    base = _base(docs)
    found = written(_recurring(_runs(base, _common_anchors(base, base.count()))), "runs")
    candidates = found.where("not later")
    shards = max(1, -(-candidates.count() // SHARD_RUNS))
    whole = found.where("later").select("doc", "tie", F.col("start").alias("s"),
                                        (F.col("start") + F.col("windows") + (WINDOW - 1)).alias("e"))
    spans = whole.unionByName(_located(_routed(base, candidates), shards))
    lists = spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return base.join(lists, ["doc", "tie"], "left").select("doc_id", "doc", "tie", "text", "spans")


def kept_words(words: list, spans) -> list:
    if not spans:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, [s["s"] for s in spans], 1)
    np.add.at(edge, [s["e"] for s in spans], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def substring_report(docs: DataFrame) -> DataFrame:
    """Per document: words, words removed, and the SHA-256 of the words kept."""
    def batches(it):
        for batch in it:
            texts, spans = _words(batch.column(3)), batch.column(4).to_pylist()
            kept = [kept_words(w, s) for w, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(w) for w in texts], pa.int64()),
                 pa.array([len(w) - len(k) for w, k in zip(texts, kept)], pa.int64()),
                 pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for k in kept])],
                ["doc_id", "n_words", "n_removed", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_spans(docs).mapInArrow(
        batches, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")

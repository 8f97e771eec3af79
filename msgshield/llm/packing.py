"""Packing token sequences by first-fit decreasing in randomised groups of documents.

Each document becomes token ids and an end id. Whole sequences are cut off its front;
the rest (shorter than a sequence) is packed in its group by first-fit decreasing,
where a tournament tree over the bins' free room finds the first bin that fits in
log time. Bins left emptier than ``min_fragment`` tokens of room allow are then taken
apart to fill the gaps of the others, and a group's one last partial bin is cut into
power-of-two sequences, which need no padding.

Groups are drawn by a hash of the row's place, never of a key, so a group has about
``group_docs`` documents whatever the ids are. Only the rests travel (their ids) and the
checksums of whole sequences, so a group's memory is bounded.

Ids are those of the ``tokenizers`` library for the file; see :class:`Encoder`.

Defined results: a null text is empty and has the end id alone; repeated rows are
packed one by one; no rows give no sequences. Ids of the null document id stay null.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import prepare

SEQUENCE = 1024
GROUP_DOCS = 1024
MIN_FRAGMENT = 16
END_ID = 0
SEED = 17
_IDS = np.dtype("<u4")
_SPECIAL = "<|endoftext|>"

_ENCODERS: dict = {}       # one per worker process and file


def byte_ranks(model: dict) -> dict[bytes, int]:
    """Byte strings and ranks of a byte-level BPE file; ids follow the order of merges."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    return {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token != _SPECIAL}


class Encoder:
    """Little-endian ids of texts: the file's ranks run by tiktoken's encoder, many times as
    fast as the file's own library; a text that spells a special token goes to the latter."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            ranks = byte_ranks(json.load(f)["model"])
        self.plain = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                       special_tokens={})
        self.exact = Tokenizer.from_file(path)

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def encode(self, text: str) -> bytes:
        ids = (self.exact.encode(text, add_special_tokens=False).ids if _SPECIAL in text
               else self.plain.encode_ordinary(text))
        return np.fromiter(ids, _IDS, len(ids)).tobytes()


def tokenise(docs: DataFrame, path: str, groups: int, sequence: int = SEQUENCE, seed: int = SEED) -> DataFrame:
    """``(grp, doc_id, tokens, crcs, rest)``: whole sequences as checksums, the rest as ids."""
    end = np.array([END_ID], _IDS).tobytes()
    step = sequence * _IDS.itemsize

    def batches(it):
        encode = Encoder.of(path).encode
        for batch in it:
            tokens, crcs, rests = [], [], []
            for text in batch.column(2):
                ids = encode(text.as_py() or "") + end
                whole = len(ids) // step * step
                view = memoryview(ids)
                tokens.append(len(ids) // _IDS.itemsize)
                crcs.append([zlib.crc32(view[i:i + step]) for i in range(0, whole, step)])
                rests.append(ids[whole:])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(tokens, pa.int64()),
                 pa.array(crcs, pa.list_(pa.int64())), pa.array(rests, pa.binary())],
                ["grp", "doc_id", "tokens", "crcs", "rest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    grp = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups))
    return docs.select(grp.alias("grp"), "doc_id", "text").mapInArrow(
        batches, f"grp long, doc_id {kind}, tokens long, crcs array<long>, rest binary")


class RoomTree:
    """Tournament tree of the bins' free room; the winner of a match has more room."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def first_fit(self, length: int) -> int:
        """Put ``length`` into the first bin with room for it; the bin's number."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < length:
                node += 1
        room[node] -= length
        leaf = node - self.leaves
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return leaf


def pack_rests(lengths, capacity: int = SEQUENCE, min_fragment: int = MIN_FRAGMENT) -> list:
    """Sequences as lists of ``(item, start, length)``; every token in exactly one."""
    order = [i for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)) if lengths[i]]
    tree = RoomTree(max(1, len(order)), capacity)
    bins: dict[int, list] = {}
    for i in order:
        bins.setdefault(tree.first_fit(lengths[i]), []).append((i, 0, lengths[i]))
    filled = sorted(bins.values(), key=lambda b: -sum(p[2] for p in b))
    loads = [sum(p[2] for p in b) for b in filled]
    lo, hi = 0, len(filled) - 1
    while lo < hi:
        gap = capacity - loads[lo]
        if gap < min_fragment:
            lo += 1
            continue
        item, start, length = filled[hi].pop()
        take = min(gap, length)
        filled[lo].append((item, start, take))
        if take < length:
            filled[hi].append((item, start + take, length - take))
        loads[lo] += take
        loads[hi] -= take
        if not loads[hi]:
            hi -= 1
    out = [b for b, load in zip(filled, loads) if load]
    if out and capacity - sum(p[2] for p in out[-1]) >= min_fragment:
        out[-1:] = power_of_two_cuts(out[-1])
    return out


def power_of_two_cuts(pieces: list) -> list:
    """Cut a partial sequence into sequences whose lengths are powers of two."""
    total, queue, out = sum(p[2] for p in pieces), list(reversed(pieces)), []
    for bit in reversed(range(total.bit_length())):
        need = total & 1 << bit
        part = []
        while need:
            item, start, length = queue.pop()
            take = min(need, length)
            part.append((item, start, take))
            if take < length:
                queue.append((item, start + take, length - take))
            need -= take
        if part:
            out.append(part)
    return out


def pack(docs: DataFrame, path: str, sequence: int = SEQUENCE, group_docs: int = GROUP_DOCS,
         min_fragment: int = MIN_FRAGMENT, seed: int = SEED) -> DataFrame:
    """One row per piece: where its ids come from and where they go."""
    prepare(docs.sparkSession)
    groups = max(1, -(-docs.count() // group_docs))

    def one_group(key, frame: pd.DataFrame) -> pd.DataFrame:
        base = key[0] << 32
        rows, seq = [], 0
        ids, tokens = frame["doc_id"].tolist(), frame["tokens"].tolist()
        for i, crcs in enumerate(frame["crcs"]):
            for k, crc in enumerate(crcs):
                rows.append((i, k * sequence, sequence, crc, base + seq, 0))
                seq += 1
        rests = frame["rest"].tolist()
        lengths = [len(r) // _IDS.itemsize for r in rests]
        for pieces in pack_rests(lengths, sequence, min_fragment):
            offset = 0
            for i, start, length in pieces:
                part = memoryview(rests[i])[start * _IDS.itemsize:(start + length) * _IDS.itemsize]
                rows.append((i, tokens[i] - lengths[i] + start, length, zlib.crc32(part), base + seq, offset))
                offset += length
            seq += 1
        at = [r[0] for r in rows]
        out = pd.DataFrame([r[1:] for r in rows],
                           columns=["start", "length", "ids_crc32", "sequence_id", "offset"])
        out.insert(0, "doc_id", frame["doc_id"].iloc[at].to_numpy())
        out.insert(4, "doc_tokens", [tokens[i] for i in at])
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (tokenise(docs, path, groups, sequence, seed).groupBy("grp").applyInPandas(
        one_group, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
                   "sequence_id long, offset long"))

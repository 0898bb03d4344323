"""Packing of documents into sequences of a fixed window, in document order.

The ids of all documents of a range of ids form one stream.  A dynamic program chooses where to cut it: the price of a
sequence is its padding plus a penalty for where it ends (nothing at the end of a document, little at the end of a
sentence, more elsewhere, where a cut is possible only if a whole window has neither) and a constant that keeps
sequences few.  Repeated rows are documents of their own.  Padding is linear in the length, so the best start of a window is the minimum of a sliding window, kept in a monotone queue: constant time per possible cut.  A sequence whose
length is a power of two needs no padding and is a transition of its own.

A partition is a contiguous range of document ids and streams through a task: the program runs over a chunk of the stream
and hands the ids after its last cut to the next chunk, so memory does not grow with the partition.  Null text counts as
empty and is one end id; rows with a null id come first; equal ids are ordered by text; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobwright.llm.tokens import encoder

#: Ids of a chunk of the stream that is planned at once.
CHUNK = 1 << 19

#: Documents encoded together.
SLICE = 512

#: Prices, in ids of padding: of a sequence, of a cut after a sentence, and of a cut inside one.
SEQUENCE, SENTENCE, INSIDE = 16, 4, 32

#: Where no document or sentence ends within a whole window, a cut inside is possible at every such step.
STEP = 32

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def sentence_ends(vocabulary: str) -> np.ndarray:
    """Ids of the tokens that are a full stop, an exclamation or a question mark, with marks around them."""
    tokens = encoder(vocabulary).library.get_vocab()
    return np.array(sorted(i for t, i in tokens.items() if re.fullmatch(r"\W*[.!?]\W*(</w>)?", t)), dtype=np.uint32)


def possible_cuts(ids: np.ndarray, doc_ends: np.ndarray, enders: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending positions after which the stream can be cut, the end included, and the price of each."""
    price = np.zeros(len(ids) + 1, dtype=np.int32)
    price[1:][np.isin(ids, enders)] = SENTENCE + 1
    price[doc_ends] = 1
    kept = np.flatnonzero(price)
    gaps = np.diff(kept, prepend=0)
    wide = np.flatnonzero(gaps > window)
    inside = [np.arange(kept[k] - gaps[k] + STEP, kept[k], STEP) for k in wide]
    if inside:
        price[np.concatenate(inside)] = INSIDE + 1
        kept = np.flatnonzero(price)
    return kept, price[kept] - 1


def best_cuts(positions: np.ndarray, prices: np.ndarray, window: int, last: bool) -> list[int]:
    """Positions at which to cut; the last one is the stream's end if ``last``, else any in the last window."""
    p = [0, *positions.tolist()]
    q = [0, *prices.tolist()]
    whole = np.asarray(p)
    short: dict[int, list[int]] = {}
    power = 1 << (window.bit_length() - 1)
    power = power // 2 if power == window else power
    while power >= STEP:
        at = np.searchsorted(whole, whole - power)
        for j in np.flatnonzero((whole >= power) & (whole[at] == whole - power)).tolist():
            short.setdefault(j, []).append(int(at[j]))
        power //= 2
    cost, back = [0] * len(p), [0] * len(p)
    queue: deque[int] = deque()
    for j in range(1, len(p)):
        # cost[i] + p[i] of the starts in the queue rises from left to right.
        value = cost[j - 1] + p[j - 1]
        while queue and cost[queue[-1]] + p[queue[-1]] >= value:
            queue.pop()
        queue.append(j - 1)
        while p[queue[0]] < p[j] - window:
            queue.popleft()
        i = queue[0]
        best = cost[i] + window - p[j] + p[i]
        for k in short.get(j, ()):
            if cost[k] < best:
                best, i = cost[k], k
        cost[j], back[j] = best + q[j] + SEQUENCE, i
    j = len(p) - 1
    if not last:
        j = min((k for k in range(1, len(p)) if p[k] > p[-1] - window), key=lambda k: (cost[k] + (p[-1] - p[k]) * SEQUENCE / window, k))
    cuts = []
    while j:
        cuts.append(p[j])
        j = back[j]
    return cuts[::-1]


def _pack(vocabulary: str, end_id: int, window: int, with_ids: bool):
    def emit(docs: list[list], raw: bytes, cuts: list[int], sequence: int) -> tuple[pa.RecordBatch, list[list]]:
        """The pieces before the last cut, and what is left of the documents after it.  A document: id, ids, start, left."""
        rows, left, at, k = [], [], 0, 0
        for doc, total, start, rest in docs:
            while rest and k < len(cuts):
                size = min(rest, cuts[k] - at)
                opened = cuts[k - 1] if k else 0
                rows.append((doc, start, size, zlib.crc32(raw[4 * at : 4 * (at + size)]), total, sequence + k, at - opened, at))
                at, start, rest = at + size, start + size, rest - size
                k += at == cuts[k]
            if rest:
                left.append([doc, total, start, rest])
        columns = [pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:7]] if rows else [pa.array([], pa.int64())] * 7
        names = [c.split()[0] for c in PIECE.split(", ")]
        if with_ids:
            values = pa.array(np.frombuffer(raw, dtype="<i4")[: cuts[-1] if cuts else 0])
            columns.append(pa.ListArray.from_arrays(pa.array([r[7] for r in rows] + [cuts[-1] if cuts else 0], pa.int32()), values))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names=names), left

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, enders, end = encoder(vocabulary).encode, sentence_ends(vocabulary), np.uint32(end_id).astype("<u4").tobytes()
        docs: list[list] = []
        parts: list[bytes] = []
        held = sequence = 0

        def plan(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal docs, parts, held, sequence
            raw = b"".join(parts)
            ends = np.cumsum([d[3] for d in docs])
            cuts = best_cuts(*possible_cuts(np.frombuffer(raw, dtype="<u4"), ends, enders, window), window, last)
            batch, docs = emit(docs, raw, cuts, sequence)
            sequence += len(cuts)
            parts = [raw[4 * cuts[-1] :]]
            held = len(parts[0]) // 4
            yield batch

        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                if not sequence:
                    sequence = batch.column("part")[0].as_py() << 33
                for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                    size = len(ids) // 4 + 1
                    docs.append([doc, size, 0, size])
                    parts += [ids, end]
                    held += size
                    if held >= CHUNK:
                        yield from plan(False)
        if docs:
            yield from plan(True)

    return run


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, window: int = 2048, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document of ``docs`` (doc_id, text), in sequences of at most ``window`` ids.

    ``start`` counts the document's ids before the piece, ``offset`` the sequence's; with ``with_ids`` the ids come along.
    Only the last sequence of a partition can be short for want of ids.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    placed = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return placed.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(
        _pack(vocabulary, end_id, window, with_ids), PIECE + ", ids array<int>" * with_ids)

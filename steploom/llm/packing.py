"""Packing by Karmarkar-Karp multiway differencing.

Token streams are cut into full windows first; what is left of each document waits, whole, in a
pool. A pool that fills a group of windows is partitioned into near-equal sums: every piece starts as
a partition of its own, and the two partitions with the largest spreads are merged with opposing
imbalances (the fullest window of one onto the emptiest of the other) until one is left. If a window
exceeds the capacity, the group gets one window more and is differenced again; where cutting is
allowed, such a window hands its excess to windows with room instead. Partitions are kept as sums
alone; which piece went where is read from the merges, last to first.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import encoder

CAPACITY, GROUP = 2048, 128
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def differencing(lengths: list[int], k: int) -> list[list[int]]:
    """The indexes of ``lengths`` in ``k`` windows of near-equal sums."""
    if k == 1:
        return [list(range(len(lengths)))]
    heap = []
    for i, n in enumerate(lengths):
        sums = np.zeros(k, np.int64)
        sums[0] = n
        heap.append((-n, i, sums))
    heapify(heap)
    merged = []
    while len(heap) > 1:
        _, a, first = heappop(heap)
        _, b, second = heappop(heap)
        # Both are sorted, fullest first: the fullest of one meets the emptiest of the other.
        sums = first + second[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        heappush(heap, (int(sums[-1] - sums[0]), len(lengths) + len(merged), sums - sums[-1]))
        merged.append((a, b, order))
    # From the last merge back: which window each place of a partition has become.
    windows_of = {len(lengths) + len(merged) - 1: np.arange(k)} if merged else {0: np.arange(k)}
    for at in range(len(merged) - 1, -1, -1):
        a, b, order = merged[at]
        own = np.empty(k, np.int64)
        own[order] = windows_of.pop(len(lengths) + at)
        windows_of[a], windows_of[b] = own, own[::-1]
    found: list[list[int]] = [[] for _ in range(k)]
    for i in range(len(lengths)):
        found[windows_of[i][0]].append(i)
    return found


def windows(lengths: list[int], capacity: int = CAPACITY, cut: bool = True) -> list[list[tuple[int, int, int]]]:
    """Near-equal windows of at most ``capacity``, each a list of (index, from, to) pieces.

    With ``cut``, a window over the capacity hands its excess, cut from its last piece, to the
    windows that have room. Where that is not allowed or there is no room, the window count rises
    and all is differenced again.
    """
    k = max(1, -(-sum(lengths) // capacity))
    while True:
        found = [[(i, 0, lengths[i]) for i in w] for w in differencing(lengths, k)]
        room = [capacity - sum(e - s for _, s, e in w) for w in found]
        if min(room) >= 0 or cut and sum(room) >= 0:
            break
        k += 1
    excess = []
    for w, over in zip(found, room):
        while over < 0:
            i, s, e = w.pop()
            at = max(s, e + over)
            excess.append((i, at, e))
            over += e - at
            if at > s:
                w.append((i, s, at))
    for w, free in zip(found, room):
        while free > 0 and excess:
            i, s, e = excess.pop()
            w.append((i, s, min(e, s + free)))
            if e > s + free:
                excess.append((i, s + free, e))
            free -= min(e - s, free)
    return [w for w in found if w]


class _Packer:
    """Pieces of one partition; a piece is (doc_id, start, ids, tokens of its document)."""

    def __init__(self, first: int, capacity: int, group: int, cut: bool):
        self.next, self.capacity, self.room, self.cut = first, capacity, group * capacity, cut
        self.pool, self.held = [], 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, cap = len(ids), self.capacity
        for start in range(0, n - n % cap, cap):
            self.put([(doc_id, start, ids[start:start + cap], n)])
        if n % cap:
            self.wait((doc_id, n - n % cap, ids[n - n % cap:], n))

    def wait(self, piece: tuple) -> None:
        """Into the pool, whole; a pool that has no room for it is packed first."""
        if self.held + len(piece[2]) > self.room:
            self.flush()
        self.pool.append(piece)
        self.held += len(piece[2])

    def flush(self) -> None:
        for w in windows([len(p[2]) for p in self.pool], self.capacity, self.cut) if self.pool else []:
            own = ((self.pool[i], s, e) for i, s, e in w)
            self.put([(doc_id, start + s, ids[s:e], n) for (doc_id, start, ids, n), s, e in own])
        self.pool, self.held = [], 0

    def put(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, n in pieces:
            raw = ids.tobytes()
            self.rows.append((doc_id, start, len(ids), crc32(raw), n, self.next, at, raw))
            at += len(ids)
        self.next += 1

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.binary()]
        cols = list(zip(*self.rows)) or [()] * 8
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, group: int = GROUP,
         id_col: str = "doc_id", text_col: str = "text", cut: bool = False) -> DataFrame:
    """A row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    A document's ids are its whole text's and ``end_id``; a null or empty text is ``end_id`` alone.
    Each id lies in exactly one piece. Rows that repeat are packed each for itself. Sequences
    never cross partitions (their ids start at the partition's number times 2^40), so packing
    moves no data; at most one group a partition is not full. Groups whose windows exceed the
    capacity rise in windows, or with ``cut`` in cuts. ``ids`` holds little-endian unsigned 32-bit ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        end = np.array([end_id], "<u4")
        packer = _Packer(TaskContext.get().partitionId() << 40, capacity, group, cut)
        for b in batches:
            for doc_id, own in zip(b.column(0), enc.encode(b.column(1))):
                packer.add(doc_id.as_py(), np.concatenate((own, end)))
                if len(packer.rows) >= 2000:
                    yield packer.batch()
        packer.flush()
        yield packer.batch()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
    return out.drop("ids")

"""Packing of tokenized documents into fixed windows by multiway number differencing."""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.llm.tokenizers_io import byte_bpe, default_path

WINDOW = 2048
#: Rests of documents are cut to this length at most before they are partitioned: several
#: pieces a window let the differencing come near equal sums.
PIECE = 512
#: A group is closed when its rests would fill so many windows.
GROUP_WINDOWS = 512
EOS = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Partition item indices into ``k`` sets of near-equal sums (Karmarkar-Karp, multiway).

    Each partial solution has up to ``k`` sums, the rest being 0. The two partials of
    widest spread merge: the largest sums of one go with the smallest of the other.
    """
    if k == 1:
        return [list(range(len(sizes)))]
    members: list[list[int]] = [[i] for i in range(len(sizes))]
    heap = [(-s, i, np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = itertools.count(len(sizes))
    while len(heap) > 1:
        _, _, a, pa = heapq.heappop(heap)
        _, _, b, pb = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over > 0:  # the `over` smallest of each meet, in opposite orders
            tail, head = slice(len(a) - over, None), slice(len(b) - over, None)
            sums = a[tail] + b[head][::-1]
            for x, y in zip(pa[tail].tolist(), pb[head][::-1].tolist(), strict=True):
                members[x] += members[y]
            a, pa, b, pb = np.concatenate((a[: len(a) - over], sums)), pa, b[: len(b) - over], pb[: len(b) - over]
        s, p = np.concatenate((a, b)), np.concatenate((pa, pb))
        order = np.argsort(-s, kind="stable")
        s, p = s[order], p[order]
        low = int(s[-1]) if len(s) == k else 0
        heapq.heappush(heap, (low - int(s[0]), next(tick), s, p))
    return [members[p] for p in heap[0][3].tolist()] if heap else []


def partition(sizes: list[int], window: int) -> list[list[int]]:
    """The first window count, from the least possible on, at which no set exceeds ``window``."""
    if not sizes:
        return []
    k = -(-sum(sizes) // window)
    while True:
        sets = differencing(sizes, k)
        most = max(sum(sizes[i] for i in s) for s in sets)
        if most <= window:
            return [s for s in sets if s]
        k += 1


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class _Packer:
    """Collects pieces of one task; gives rows whenever a group is full."""

    def __init__(self, task: int, window: int, piece: int, group_tokens: int):
        self.next_id, self.window, self.piece, self.group_tokens = task << 32, window, piece, group_tokens
        self.held: list[tuple] = []
        self.tokens = 0

    def _sequence(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def add(self, doc_id, ids: np.ndarray) -> list[tuple]:
        """Full windows of the document come out at once; its rest waits for its group."""
        n, whole, rows = len(ids), len(ids) - len(ids) % self.window, []
        for at in range(0, whole, self.window):
            rows.append((doc_id, at, self.window, _crc(ids[at : at + self.window]), n, self._sequence(), 0))
        rest = n - whole
        if rest:
            parts = -(-rest // self.piece)
            cuts = [whole + rest * i // parts for i in range(parts + 1)]
            self.held += [(doc_id, s, e - s, _crc(ids[s:e]), n) for s, e in itertools.pairwise(cuts)]
            self.tokens += rest
        return rows + (self.flush() if self.tokens >= self.group_tokens else [])

    def flush(self) -> list[tuple]:
        rows = []
        for members in partition([p[2] for p in self.held], self.window):
            seq, at = self._sequence(), 0
            for i in members:
                rows.append((*self.held[i], seq, at))
                at += self.held[i][2]
        self.held, self.tokens = [], 0
        return rows


def pack(docs: DataFrame, tokenizer: str | None = None, *, window: int = WINDOW, piece: int = PIECE, group_windows: int = GROUP_WINDOWS, eos: int = EOS) -> DataFrame:
    """Token windows of all documents, one row per piece.

    Each task reads its rows once and packs them by itself, without a shuffle; a group
    of rests is bounded, and so is a task's memory. A document longer than a window is
    cut to full windows and a rest. Sequence ids are unique: the task's number in the
    upper bits, a counter in the lower ones. Null text counts as empty (its only id is
    ``eos``); equal ids and equal rows are packed like any others; an empty table gives
    no rows; other columns are not read. A null ``doc_id`` stays null.
    """
    path = tokenizer or default_path("byte_bpe_50k.json")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        enc = byte_bpe(path)
        packer = _Packer(TaskContext.get().partitionId(), window, piece, group_windows * window)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def table(rows: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode_to_numpy(text.as_py() or "", allowed_special="all") if text.is_valid else np.empty(0, np.uint32)
                rows += packer.add(doc_id, np.append(ids, np.uint32(eos)))
            if rows:
                yield table(rows)
        if rows := packer.flush():
            yield table(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)

"""Hierarchical packing of token sequences into windows of several context sizes, balanced over training steps.

Documents longer than the longest window are cut into such windows; what is left is routed to the shortest tier that holds it.
Tiers are packed from the longest to the shortest. A tier's documents, more than half a window each, open one window each, and
the gaps are filled from what is left of the shorter tiers: the longest that fits, again and again, and where none fits the
shortest is cut. When filling would run out, fewer windows are opened and the other documents of the tier fill too. So
every window is full, and the last tokens of all, fewer than a window, take windows of falling powers of two: nothing is padded.

All this is planned on the histogram of lengths, on runs of equal lengths and equal gaps: the plan has runs of (length, first
rank, count, place in the piece, tokens, window, first sequence, offset), and its size follows from the longest window, not from the
number of documents. Executors look their pieces up by rank. A step takes a fixed number of tokens in windows of one size; a
tier's windows are dealt to its steps in turn, so steps differ by one window at most and mix all shapes alike.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candela.llm.common import small_batches, stored
from candela.llm.packing import ranked, ranks_of
from candela.llm.tokens import gathered, token_pieces, unpacked

TIERS, STEP_WINDOWS = (256, 512, 1024, 2048), 8


class Stock:
    """Unpacked pieces by length: runs of (length of the whole piece, first rank, count, place in the piece)."""

    def __init__(self, histogram: dict[int, int]):
        self.runs: dict[int, list[tuple[int, int, int, int]]] = {}
        self.keys: list[int] = []
        self.tokens = 0
        for x, n in histogram.items():
            if n:
                self.put(x, (x, 0, n, 0))

    def put(self, length: int, run: tuple[int, int, int, int]) -> None:
        if length not in self.runs:
            self.runs[length] = []
            insort(self.keys, length)
        self.runs[length].append(run)
        self.tokens += length * run[2]

    def take(self, length: int, most: int) -> tuple[int, int, int, int]:
        """A run of at most ``most`` pieces of this length."""
        whole, first, count, start = self.runs[length].pop()
        n = min(count, most)
        self.tokens -= length * count
        if count > n:
            self.put(length, (whole, first + n, count - n, start))
        elif not self.runs[length]:
            del self.runs[length]
            self.keys.pop(bisect_left(self.keys, length))
        return whole, first, n, start

    def fitting(self, gap: int) -> int | None:
        i = bisect_right(self.keys, gap)
        return self.keys[i - 1] if i else None


def plan(histogram: dict[int, int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, int, int, int, int, int, int, int]]:
    """Runs (length, first rank, count, place in the piece, tokens, window, first sequence of that window, offset): the i-th piece
    of a run has these tokens in the window's sequence first + i. Lengths are at most the longest tier; tiers are powers of two."""
    stock, out, opened = Stock(histogram), [], defaultdict(int)

    def fill(window: int, first: int, n: int, offset: int) -> None:
        """Fill the windows first to first + n - 1, all filled up to ``offset``; the stock suffices."""
        todo = [(first, n, offset)]
        while todo:
            first, n, offset = todo.pop()
            if not n or offset == window:
                continue
            gap = window - offset
            x = stock.fitting(gap) or stock.keys[0]
            whole, rank, some, start = stock.take(x, n)
            size = min(x, gap)
            out.append((whole, rank, some, start, size, window, first, offset))
            if size < x:
                stock.put(x - size, (whole, rank, some, start + size))
            todo += [(first + some, n - some, offset), (first, some, offset + size)]

    for window, lower in zip(sorted(tiers, reverse=True), [*sorted(tiers, reverse=True)[1:], 0], strict=True):
        if stock.tokens < window:
            break
        while stock.tokens >= window and (stock.fitting(window) or 0) > lower:
            x = stock.fitting(window)
            whole, rank, n, start = stock.take(x, 1 << 62)
            some = min(n, (stock.tokens + n * x) // window)  # as many windows as the stock and the rest of this run can fill
            if some < n:
                stock.put(x, (whole, rank + some, n - some, start))
            out.append((whole, rank, some, start, x, window, opened[window], 0))
            opened[window] += some
            fill(window, opened[window] - some, some, x)
    while stock.tokens:
        window = 1 << (stock.tokens.bit_length() - 1)
        opened[window] += 1
        fill(window, opened[window] - 1, 1, 0)
    return out


def numbered(runs: list[tuple], step_tokens: int) -> tuple[np.ndarray, dict[int, tuple[int, int, int]]]:
    """The runs sorted by length and rank, and for each window its first sequence_id, first step and number of steps."""
    opened: dict[int, int] = defaultdict(int)
    for _, _, n, _, _, window, first, _ in runs:
        opened[window] = max(opened[window], first + n)
    bases, sequence, step = {}, 0, 0
    for window in sorted(opened, reverse=True):
        steps = -(-opened[window] // max(1, step_tokens // window))
        bases[window] = (sequence, step, steps)
        sequence, step = sequence + opened[window], step + steps
    return np.array(sorted(runs), np.int64).reshape(-1, 8), bases


def parts_of(length: np.ndarray, ranks: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, run) for every part of every piece, rows in order."""
    rows, which = [], []
    for x in np.unique(length).tolist():
        mine = np.flatnonzero(length == x)
        mine = mine[np.argsort(ranks[mine], kind="stable")]
        lo, hi = np.searchsorted(runs[:, 0], (x, x + 1))
        a = np.searchsorted(ranks[mine], runs[lo:hi, 1])
        b = np.searchsorted(ranks[mine], runs[lo:hi, 1] + runs[lo:hi, 2])
        rows.append(mine[gathered(np.arange(len(mine)), a, b - a)])
        which.append(np.repeat(np.arange(lo, hi), b - a))
    row, run = np.concatenate(rows), np.concatenate(which)
    order = np.lexsort((runs[run, 3], row))
    return row[order], run[order]


def pack_documents(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS, step_tokens: int | None = None, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """A row a piece: doc_id, start (the document's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset, window (the
    sequence's size), step (of training; all its sequences have one size) and, unless declined, ids.

    ``tiers`` are powers of two; ``step_tokens`` (STEP_WINDOWS of the longest) go into a step. Null and empty texts are a document of the end token alone; very long ones
    are cut, all pieces kept; null ids, repeated rows and ties in length are packed each: ranges are cut at unique places, so one
    length or one id spreads over tasks. No rows, no rows. Only the id and the text are read, so other columns may have any name.
    """
    spark, longest = docs.sparkSession, max(tiers)
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cut = token_pieces(named, vocabulary, capacity=longest, end_id=end_id, keep=["doc_id"], with_ids=True, with_total=True, packed=True).drop("piece", "ids_crc32")
    rows, part, rank, base, histogram = ranked(stored(cut, "pieces"), "ranked")
    table = spark.sparkContext.broadcast((base, *numbered(plan(histogram, tiers), step_tokens or STEP_WINDOWS * longest)))
    result = T.StructType([docs.select(F.col(id_col).alias("doc_id")).schema[0], *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step")), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def place(batches):
        base, runs, bases = table.value
        for b in batches:
            if not b.num_rows:
                continue
            length, ranks = np.asarray(b.column("length")), ranks_of(b, part, rank, base)
            row, run = parts_of(length, ranks, runs)
            chosen = runs[run]
            within, size, window = chosen[:, 3], chosen[:, 4], chosen[:, 5]
            index = chosen[:, 6] + ranks[row] - chosen[:, 1]
            first, step, steps = (np.array([bases[w][i] for w in window.tolist()], np.int64) for i in range(3))
            packed, starts = unpacked(b.column("ids"), length)
            ids = gathered(packed, starts[row] + within, size).astype("<u4")
            raw, ends = memoryview(ids).cast("B"), np.cumsum(size)
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
            made = [np.asarray(b.column("start"))[row] + within, size, crc, np.asarray(b.column("doc_tokens"))[row], first + index, chosen[:, 7], window, step + index % steps]
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids.view("<i4")))] if with_ids else []
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), *(pa.array(x, pa.int64()) for x in made), *lists], names=result.names)

    small_batches(spark)
    return rows.mapInArrow(place, result)

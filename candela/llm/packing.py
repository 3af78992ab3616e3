"""Best-fit packing of token sequences, planned on the length histogram by non-negative least squares.

The histogram has at most ``capacity`` lengths however many documents there are. Patterns of few documents that fill a
sequence are enumerated on a coarse grid of lengths, their repeat counts are fitted to the histogram by non-negative
least squares and rounded down; what the patterns leave over, in documents and in gaps, is packed best fit decreasing,
by runs of equal lengths and equal gaps. The plan is a list of runs (length, first rank, count, first sequence, offset);
its size depends on the capacity and the grid, not on the input. Executors look their documents up in it by rank; token ids
travel with their pieces, two bytes each where the vocabulary allows.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candela.llm.common import fresh, stored
from candela.llm.tokens import token_pieces, unpacked

GRID, PATTERN_DOCS = 32, 6


def patterns(grid: int = GRID, most: int = PATTERN_DOCS) -> list[tuple[int, ...]]:
    """Falling sequences of at most ``most`` grid lengths that add up to ``grid``."""
    out: list[tuple[int, ...]] = []

    def grow(rest, top, chosen):
        if rest == 0:
            out.append(tuple(chosen))
        elif len(chosen) < most:
            for x in range(min(rest, top), 0, -1):
                grow(rest - x, x, [*chosen, x])

    grow(grid, grid, [])
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """min |a x - b| over x >= 0, by the active-set method of Lawson and Hanson (1974)."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        slope = np.where(active, -np.inf, a.T @ (b - a @ x))
        j = int(slope.argmax())
        if slope[j] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        active[j] = True
        while True:
            s = np.zeros_like(x)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            bad = active & (s <= 0)
            if not bad.any():
                break
            t = float(np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300)))
            x = x + t * (s - x)
            active &= x > 1e-12
            x[~active] = 0
        x = s
    return x


#: Least lengths, as shares of the capacity, that patterns may use: what is shorter is kept to fill their gaps.
FLOORS = (1 / 16, 1 / 8, 3 / 16, 1 / 4, 3 / 8, 1 / 2)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """The runs of ``fitted`` with the fewest sequences over the lengths that patterns may use."""
    plans = [fitted(histogram, capacity, math.ceil(capacity * f)) for f in FLOORS]
    return min(plans, key=lambda runs: max((first + n for _, _, n, first, _ in runs), default=0))


def fitted(histogram: dict[int, int], capacity: int, floor: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset): the i-th of a run goes to sequence first + i at offset.

    Patterns are fitted to lengths of at least ``floor``; coarse lengths are rounded up, so a pattern never overflows,
    and the shorter lengths then go into the gaps.
    """
    left, used = dict(histogram), defaultdict(int)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first sequence, count)
    sequences = 0

    def emit(length, n, first, offset):
        runs.append((length, used[length], n, first, offset))
        used[length] += n
        left[length] -= n

    grid = min(GRID, capacity)
    bin_of = {x: -(-x * grid // capacity) for x in left}
    stock = defaultdict(list)
    for x in sorted(left):
        if x >= floor:
            stock[bin_of[x]].append(x)  # the longest is last
    want = np.zeros(grid)
    for x, n in left.items():
        want[bin_of[x] - 1] += n * (x >= floor)
    ways = patterns(grid)
    a = np.zeros((grid, len(ways)))
    for j, w in enumerate(ways):
        for x in w:
            a[x - 1, j] += 1
    for j, repeat in sorted(enumerate(np.floor(nnls(a, want) + 1e-6).astype(int)), key=lambda t: (-t[1], t[0])):
        have = {x: sum(left[y] for y in stock[x]) for x in set(ways[j])}
        repeat = min([int(repeat), *(have[x] // ways[j].count(x) for x in have)])
        if repeat <= 0:
            continue
        slots = []  # for each document of the pattern: runs of lengths over its repeats
        taken: dict[int, int] = defaultdict(int)
        for x in ways[j]:
            need, got = repeat, []
            while need:
                y = stock[x][-1]
                if n := min(need, left[y] - taken[y]):
                    got.append([y, n])
                    taken[y] += n
                    need -= n
                if taken[y] == left[y]:
                    stock[x].pop()
            slots.append(got)
        at = [0] * len(slots)
        done = 0
        while done < repeat:
            n, offset = min(s[i][1] for s, i in zip(slots, at, strict=True)), 0
            for k, s in enumerate(slots):
                emit(s[at[k]][0], n, sequences + done, offset)
                offset += s[at[k]][0]
                s[at[k]][1] -= n
                at[k] += s[at[k]][1] == 0
            if offset < capacity:
                gaps[capacity - offset].append((sequences + done, n))
            done += n
        sequences += repeat

    keys = sorted(gaps)
    for x in sorted(left, reverse=True):
        while n := left[x]:
            i = bisect_left(keys, x)
            if i < len(keys):
                gap = keys[i]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    keys.pop(i)
            else:
                gap, first, count = capacity, sequences, max(1, n // (capacity // x))
                sequences += count
            each = min(n, gap // x)
            some = min(count, n // each)
            for k in range(each):
                emit(x, some, first, capacity - gap + k * x)
            for rest, start, many in ((gap - each * x, first, some), (gap, first + some, count - some)):
                if rest and many:
                    if rest not in gaps:
                        insort(keys, rest)
                    gaps[rest].append((start, many))
    return runs


def counted(batches, names: list[str]):
    """Numbers the pieces of each length within the task, in the order in which they come: their columns, the task and the number."""
    from pyspark import TaskContext

    part, seen = TaskContext.get().partitionId(), defaultdict(int)
    for b in batches:
        length = np.asarray(b.column("length"))
        order = np.argsort(length, kind="stable")
        values, counts = np.unique(length, return_counts=True)
        before = np.array([seen[v] for v in values.tolist()], np.int64)
        ranks = np.empty(len(length), np.int64)
        ranks[order] = np.arange(len(length)) - np.repeat(np.cumsum(counts) - counts - before, counts)
        for v, c in zip(values.tolist(), counts.tolist(), strict=True):
            seen[v] += c
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(ranks)], names=names)


def ranked(pieces: DataFrame, tag: str) -> tuple[DataFrame, str, str, dict[tuple[int, int], int], dict[int, int]]:
    """``pieces`` (length, ...; stored) with the task and the number of each among the task's pieces of its length; the names of these
    columns; for each length and task the pieces of earlier tasks; and the histogram of lengths.

    Tasks come from a range partitioning by length and place, which no two rows share, so a length or an id that most rows have is
    split; a task's part holds neighbouring lengths, so the (part, length) counts are at most tasks + lengths rows."""
    parts = max(1, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    place, part, rank = fresh(pieces, "pack_place"), fresh(pieces, "pack_part"), fresh(pieces, "pack_rank")
    names = [*pieces.columns, part, rank]
    schema = T.StructType([*pieces.schema.fields, T.StructField(part, T.IntegerType()), T.StructField(rank, T.LongType())])
    dealt = pieces.withColumn(place, F.monotonically_increasing_id()).repartitionByRange(parts, "length", place).drop(place)
    out = stored(dealt.mapInArrow(lambda batches: counted(batches, names), schema), tag)
    base, histogram = {}, defaultdict(int)
    for r in sorted(out.groupBy("length", part).count().collect(), key=lambda r: (r["length"], r[part])):
        base[r["length"], r[part]] = histogram[r["length"]]
        histogram[r["length"]] += r["count"]
    return out, part, rank, base, dict(histogram)


def ranks_of(b: pa.RecordBatch, part: str, rank: str, base: dict[tuple[int, int], int]) -> np.ndarray:
    """The ranks of a batch's pieces among all of their lengths."""
    pair, back = np.unique(np.asarray(b.column("length")).astype(np.int64) << 32 | np.asarray(b.column(part)), return_inverse=True)
    return np.asarray(b.column(rank)) + np.array([base[p >> 32, p & 0xFFFFFFFF] for p in pair.tolist()], np.int64)[back]


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` (length, ...; stored) plus sequence_id and offset; packed ids become arrays.

    Null ids and repeated rows are packed like others; no pieces, no rows.
    """
    names = pieces.columns
    rows, part, rank, base, histogram = ranked(pieces, "ranked")
    runs = sorted(plan(histogram, capacity))
    at = {x: i for i, x in reversed(list(enumerate(r[0] for r in runs)))}
    table = pieces.sparkSession.sparkContext.broadcast((base, at, np.array(runs, np.int64).reshape(-1, 5)))
    is_packed = [isinstance(f.dataType, T.BinaryType) and f.name == "ids" for f in pieces.schema]
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())) if p else f for f, p in zip(pieces.schema, is_packed, strict=True)]

    def place(batches):
        base, at, runs = table.value
        for b in batches:
            if not b.num_rows:
                continue
            length, ranks, row = np.asarray(b.column("length")), ranks_of(b, part, rank, base), np.zeros(b.num_rows, np.int64)
            for x in np.unique(length).tolist():
                mine, lo = length == x, at[x]
                hi = int(np.searchsorted(runs[:, 0], x, "right"))
                row[mine] = lo + np.searchsorted(runs[lo:hi, 1], ranks[mine], "right") - 1
            chosen = runs[row]
            columns = [b.column(c) for c in names]
            for i in np.flatnonzero(is_packed).tolist():
                ids, starts = unpacked(columns[i], length)
                columns[i] = pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(chosen[:, 3] + ranks - chosen[:, 1]), pa.array(chosen[:, 4].copy())], names=[*names, "sequence_id", "offset"])

    return rows.mapInArrow(place, T.StructType([*fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack_documents(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut what is longer than ``capacity`` and pack: doc_id, piece, start, length, ids_crc32, on request ids,
    sequence_id and offset.

    Null and empty texts are a document of the end token alone; very long ones are cut, all pieces kept; null ids, repeated
    rows and ties in length are packed each; an empty table gives no rows. Only the id and the text are read, so other
    columns may have any name.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cut = token_pieces(named, vocabulary, capacity=capacity, end_id=end_id, keep=["doc_id"], with_ids=with_ids, packed=True)
    return pack(stored(cut, "pieces"), capacity)

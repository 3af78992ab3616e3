"""Greedy novelty batch: each step takes the best priority, where novelty is measured against what was taken before.

A step is one narrow pass over the candidates: their k-mer sets are compared with the few sequences chosen so far, which
are literals in the plan, and one row comes back. Nothing is carried from step to step but the choices.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions import scoring as C
from candela.functions import sequence as S
from candela.operators.selection.ranking import ranked
from candela.operators.staging import staged

WEIGHTS = (0.55, 0.30, 0.15)


def prepared(candidates: DataFrame) -> DataFrame:
    """(candidate_id, sequence, kmers, score, flags); an existing manufacturability_score or risk_flags column takes part."""
    flags, score = C.flags_and_score(F.col("sequence"), F.col("modality") if "modality" in candidates.columns else None)
    if "risk_flags" in candidates.columns:
        flags = F.array_distinct(F.concat(F.coalesce("risk_flags", F.array().cast("array<string>")), flags))
    if "manufacturability_score" in candidates.columns:
        score = F.coalesce("manufacturability_score", score)
    return candidates.select("candidate_id", "sequence", S.kmers(S.clean(F.col("sequence"))).alias("kmers"), score.alias("score"), flags.alias("flags"))


def scored(d: DataFrame, chosen: list[str], weights: tuple[float, float, float]) -> DataFrame:
    sims: list[Column] = [S.jaccard(F.col("kmers"), S.kmers(S.clean(F.lit(s)))) for s in chosen]
    most = F.lit(None).cast("double") if not sims else sims[0] if len(sims) == 1 else F.greatest(*sims)
    d = d.withColumn("exploration_score", C.novelty(most)).withColumn("uncertainty_score", C.uncertainty(F.col("score"), F.col("flags"))).withColumn("risk_penalty", C.risk_penalty(F.col("flags")))
    return d.withColumn("priority_score", C.priority(F.col("score"), F.col("exploration_score"), F.col("uncertainty_score"), F.col("risk_penalty"), weights))


def select_batch(candidates: DataFrame, batch_size: int = 5, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """Every candidate with its scores, selected, selection_step and rank: selected rows keep the scores they were chosen
    with, the others are scored against the whole batch."""
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    d = staged(prepared(candidates), "novelty")
    picks: list = []
    while len(picks) < batch_size:
        left = d.where(~F.col("candidate_id").isin([p["candidate_id"] for p in picks])) if picks else d
        best = scored(left, [p["sequence"] for p in picks], weights).orderBy(F.desc("priority_score"), "candidate_id").limit(1).collect()
        if not best:
            break
        picks += best
    if not picks:
        raise ValueError("at least one candidate is required")
    ids = [p["candidate_id"] for p in picks]
    rest = scored(d.where(~F.col("candidate_id").isin(ids)), [p["sequence"] for p in picks], weights)
    taken = d.sparkSession.createDataFrame([tuple(p) for p in picks], rest.schema)
    step = F.coalesce(*(F.when(F.col("candidate_id") == i, F.lit(k)) for k, i in enumerate(ids, 1)))
    both = taken.withColumn("selected", F.lit(True)).unionByName(rest.withColumn("selected", F.lit(False))).withColumn("selection_step", step)
    return ranked(both, [F.desc("selected"), F.desc("priority_score"), F.col("candidate_id")]).select("candidate_id", "rank", "selected", "selection_step", "priority_score", F.round("score", 3).alias("manufacturability_score"), "exploration_score", "uncertainty_score", "risk_penalty", F.col("flags").alias("risk_flags"))


def alike(d: DataFrame, least: float, *, id_col: str, kmers_col: str) -> DataFrame:
    """id, other_id, similarity of all pairs with a Jaccard similarity of at least ``least`` (> 0), by prefix filtering: with
    the k-mers of a set in order of their rarity, such pairs share one among the first ``n - ceil(least * n) + 1``."""
    e = d.select(F.col(id_col).alias("id"), F.col(kmers_col).alias("k"), F.explode(kmers_col).alias("kmer"))
    seen = e.groupBy("kmer").agg(F.count("*").alias("n"))
    ranked = e.join(seen, "kmer").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "kmer"))).alias("r"))
    n = F.size("r")
    first = F.slice("r", F.lit(1), (n - F.ceil(F.lit(least) * n - F.lit(1e-9)) + 1).cast("int"))
    heads = staged(ranked.select("id", F.size("r").alias("n"), F.explode(F.transform(first, lambda x: x["kmer"])).alias("kmer")), "heads")
    o = heads.select(F.col("id").alias("other_id"), F.col("n").alias("m"), "kmer")
    near = heads.join(o, "kmer").where((F.col("id") < F.col("other_id")) & (F.least("n", "m") >= least * F.greatest("n", "m") - 1e-9)).select("id", "other_id").distinct()
    k = d.select(F.col(id_col).alias("id"), F.col(kmers_col).alias("a"))
    j = near.join(k, "id").join(k.select(F.col("id").alias("other_id"), F.col("a").alias("b")), "other_id")
    return j.select(F.col("id").alias(id_col), "other_id", S.jaccard(F.col("a"), F.col("b")).alias("similarity")).where(F.col("similarity") >= least - 1e-9)


#: Rows of a block where blocks are few, rows of a block at most, and the number of blocks up to that.
BLOCK_LEAST, BLOCK_MOST, BLOCKS = 4_096, 50_000, 16
#: Similarities to look for, from the top, until there are enough pairs.
STEPS = (0.9, 0.75, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.0)
#: Meetings of two rows that the first look at a block may make, and meetings or k-mers that are held at once.
FIRST_LOOK, AT_ONCE = 2_000_000, 250_000


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition as one row: an Arrow stream of its ids and k-mer sets, the k-mers as indices of a dictionary."""
    full = [b for b in batches if b.num_rows]
    if full:
        t = pa.Table.from_batches(full).combine_chunks()
        lists = t.column("k").combine_chunks()
        ends = np.cumsum(np.asarray(pc.list_value_length(lists)))
        sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pc.list_flatten(lists).dictionary_encode())
        t, sink = pa.table({"id": t.column("id"), "k": sets}), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as out:
            out.write_table(t)
        n = np.diff(ends, prepend=0)
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "lo": pa.array([n.min()], pa.int32()), "hi": pa.array([n.max()], pa.int32()), "pack": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _places(begins: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The places ``begins[i]`` to ``begins[i] + many[i] - 1`` of all i, in a row."""
    return np.repeat(begins - np.cumsum(many) + many, many) + np.arange(many.sum())


class _Sets:
    """The sets of one block or two, each cut into the same parts of the vocabulary, rare k-mers first within a part.

    If two sets have a Jaccard similarity of t, so have their shares of one part at least, since otherwise all parts together would differ
    in more than they may. Shares of n and m k-mers that are t alike have at least t * max(n, m) in common. They meet by a common k-mer where that
    can be 1, and by two common ones among the first ``n - max(t * n, 2) + 2`` (a prefix filter) where it is more. So none is missed, and parts of
    about three k-mers make few other pairs meet. Of these the parities of k-mers by bit tell by how many two sets differ at least."""

    def __init__(self, packs: list[bytes], sides: Sequence[int] = (0, 1)) -> None:
        tables = [pa.ipc.open_stream(p).read_all() for p in packs]
        lists = [t.column("k").combine_chunks() for t in tables]
        codes = np.concatenate([np.asarray(c.indices) for c in pa.chunked_array([x.values for x in lists]).unify_dictionaries().chunks])
        self.ids = np.concatenate([np.asarray(t.column("id")) for t in tables])
        self.first = sum(t.num_rows for t, side in zip(tables, sides, strict=False) if side == 0)
        self.alone = self.first == len(self.ids)
        self.sizes = n = np.concatenate([np.asarray(pc.list_value_length(x)) for x in lists]).astype(np.int64)
        counts = np.bincount(codes)
        self.words, rank = len(counts), np.empty(len(counts), np.int64)
        rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
        parts = max(1, round(float((n * n).sum()) / (3 * n.sum())))
        key = rank[codes]
        key += (np.repeat(np.arange(len(n)) * parts, n) + key % parts) * self.words
        key.sort()
        self.ranks, share = key % self.words, key // self.words
        self.begins = np.cumsum(n) - n
        self.starts = np.flatnonzero(np.diff(share, prepend=-1))
        self.many = np.diff(self.starts, append=len(share))
        self.owners = (share[self.starts] // parts).astype(np.int32)

    def parities(self, least: float) -> list[np.ndarray]:
        """Words of the parities of each set's k-mers by bit: two sets differ in as many k-mers as bits at least. The less alike sets may be, the more bits tell them apart."""
        width = 1 + int(self.sizes.mean() * (1.25 - least)) // 8
        bit = self.ranks % (64 * width)
        flag = np.left_shift(np.uint64(1), (bit & 63).astype(np.uint64))
        return [np.bitwise_xor.reduceat(np.where(bit >> 6 == w, flag, np.uint64(0)), self.begins) for w in range(width)]

    def keys(self, least: float, some: slice) -> tuple[np.ndarray, np.ndarray]:
        """What the shares ``some`` meet by, in order, and their rows."""
        starts, many, owners = self.starts[some], self.many[some], self.owners[some]
        common = np.ceil(least * many - 1e-9)
        one = common <= 1
        single = self.ranks[_places(starts[one], many[one])] + self.words**2
        two = (many >= 2) & (least / (1 + least) * (many + self.many.max()) > 1 + 1e-9)
        later = (many[two] - np.maximum(common[two], 2) + 1).astype(np.int64)  # all but the first of the prefix, each with those before it
        before = _places(np.ones_like(later), later)
        start = np.repeat(starts[two], later)
        pairs = self.ranks[_places(start, before)] * self.words + np.repeat(self.ranks[start + before], before)
        keys = np.concatenate([single, pairs])
        order = np.argsort(keys)
        return keys[order], np.concatenate([np.repeat(owners[one], many[one]), np.repeat(np.repeat(owners[two], later), before)])[order]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many k-mers the sets of the rows ``a`` and ``b`` have in common."""
        out, step = np.empty(len(a), np.int64), max(1, AT_ONCE // int(2 * self.sizes.max()))
        for at in range(0, len(a), step):
            both = [r[at : at + step] for r in (a, b)]
            key = np.concatenate([np.repeat(np.arange(len(r)) * self.words, self.sizes[r]) + self.ranks[_places(self.begins[r], self.sizes[r])] for r in both])
            key.sort()
            out[at : at + step] = np.bincount(key[1:][key[1:] == key[:-1]] // self.words, minlength=len(both[0]))
        return out

    def search(self, k: int, bound: float, most: int | None = None) -> list[tuple[float, int, int, int]] | None:
        """The first ``k`` (-similarity, id, id, place) of the pairs of a similarity of at least ``bound`` with a common k-mer; None if more than ``most`` rows would meet."""
        cut, least = int(np.searchsorted(self.owners, self.first)), max(0.0, bound - 1e-9)
        keys, rows = self.keys(least, slice(0, cut))
        if self.alone:
            others = rows
            begin, end = np.arange(1, len(keys) + 1), np.searchsorted(keys, keys, "right")
        else:
            other_keys, others = self.keys(least, slice(cut, None))
            begin, end = (np.searchsorted(other_keys, keys, s) for s in ("left", "right"))
        many = end - begin
        met = np.cumsum(many)
        if most is not None and len(met) and met[-1] > most:
            return None
        best: list[tuple[float, int, int, int]] = []
        parities = self.parities(least)
        stops = np.unique(np.searchsorted(met, np.arange(AT_ONCE, (met[-1] if len(met) else 0) + AT_ONCE, AT_ONCE), "right"))
        for at, to in zip([0, *stops], [*stops, len(met)], strict=True):
            n = many[at:to]
            a, b = np.repeat(rows[at:to], n), others[_places(begin[at:to], n)]
            differ, limit = np.int64(0), (1 - least) / (1 + least) * (self.sizes[a] + self.sizes[b]) + 1e-6
            for parity in parities:
                differ = differ + np.bitwise_count(parity[a] ^ parity[b]).astype(np.int32)
                keep = np.flatnonzero(differ <= limit)
                a, b, differ, limit = a[keep], b[keep], differ[keep], limit[keep]
            place = np.unique(np.minimum(a, b).astype(np.int64) * len(self.ids) + np.maximum(a, b))
            a, b = place // len(self.ids), place % len(self.ids)
            common = self.common(a, b)
            similarity = common / (self.sizes[a] + self.sizes[b] - common)
            x, y = self.ids[a], self.ids[b]
            keep = (x != y) & (similarity >= bound)
            x, y, similarity, place = np.minimum(x, y)[keep], np.maximum(x, y)[keep], similarity[keep], place[keep]
            if len(similarity) > k:
                near = similarity >= np.partition(similarity, len(similarity) - k)[len(similarity) - k]
                x, y, similarity, place = x[near], y[near], similarity[near], place[near]
            best = sorted({*best, *zip((-similarity).tolist(), x.tolist(), y.tolist(), place.tolist(), strict=True)})[:k]
            if len(best) == k:
                bound = max(bound, -best[-1][0])
                least = max(0.0, bound - 1e-9)
        return best


def most_alike(d: DataFrame, k: int, *, id_col: str, kmers_col: str) -> DataFrame:
    """The ``k`` most similar pairs by Jaccard similarity, then ids, among all pairs with a common k-mer.

    Of equal sets the rows of the first ``k + 1`` ids are enough: ``k`` pairs come before any pair of a later one. Rows are put in blocks of like sizes. A
    first look at each block alone gives a bound, then every two blocks whose sizes can reach it are compared for pairs that reach it. A task holds two
    blocks and hands back ``k`` pairs, so memory is bounded and no pair is a row of the plan."""
    spark = d.sparkSession
    sets = staged(d.select(F.col(id_col).alias("id"), F.sort_array(kmers_col).alias("k")), "sets").where("id IS NOT NULL AND size(k) > 0")
    copy = F.dense_rank().over(Window.partitionBy(F.xxhash64("k"), "k").orderBy("id"))
    rows = staged(sets.withColumn("copy", copy).where(F.col("copy") <= k + 1).select("id", "k", F.size("k").alias("n")), "kmers")
    total = rows.count()
    blocks = max(1, min(BLOCKS, math.ceil(total / BLOCK_LEAST)), math.ceil(total / BLOCK_MOST))
    packs = staged(rows.repartitionByRange(blocks, "n", "id").select("id", "k").mapInArrow(_packed, "part int, lo int, hi int, pack binary"), "blocks")
    parts = sorted(packs.select("part", "lo", "hi").collect())  # a part is a block, or several are, should Spark make more of them
    members: dict[int, list] = {}
    for at, part in enumerate(parts):
        members.setdefault(at * blocks // max(blocks, len(parts)), []).append(part)
    sizes = {b: (min(p["lo"] for p in m), max(p["hi"] for p in m)) for b, m in members.items()}
    kind = d.schema[id_col].dataType.simpleString()
    fields = f"`{id_col}` {kind}, other_id {kind}, similarity double"
    in_order = [F.desc("similarity"), F.col(id_col), F.col("other_id")]

    def compared(pairs: list[tuple[int, int]], bound: float | None) -> DataFrame:
        sides = [(i, j, p["part"], s) for i, j in pairs for s, b in enumerate((i, j) if i != j else (i,)) for p in members[b]]
        met = packs.join(F.broadcast(spark.createDataFrame(sides, "one int, two int, part int, side int")), "part").select("one", "two", "side", "pack")

        def closest(table: pa.Table) -> pa.Table:
            table = table.sort_by("side")
            s = _Sets([p.as_py() for p in table.column("pack")], table.column("side").to_pylist())
            best: list = []
            for step in STEPS if bound is None else ():
                found = s.search(k, step, FIRST_LOOK)
                best = best if found is None else found
                if found is None or len(found) == k:
                    break
            best = best if bound is None else s.search(k, bound)
            of = pa.array(s.ids[:1]).type
            return pa.table({id_col: pa.array([x for _, x, _, _ in best], of), "other_id": pa.array([y for _, _, y, _ in best], of), "similarity": pa.array([-s for s, *_ in best], pa.float64())})

        return staged(met.repartition(min(len(pairs), 2_000), "one", "two").groupBy("one", "two").applyInArrow(closest, fields), "alike").orderBy(*in_order).limit(k)

    def last(found: DataFrame) -> float | None:
        """The similarity of the k-th pair."""
        r = found.agg(F.min("similarity").alias("s"), F.count("*").alias("n")).first()
        return r["s"] if r["n"] == k else None

    if not sizes:
        return spark.createDataFrame([], fields)
    bound = last(compared([(b, b) for b in sizes], None))
    for step in STEPS if bound is None else (bound,):
        reach = [(i, j) for i in sizes for j in sizes if i <= j and min(sizes[i][1], sizes[j][1]) >= step * max(sizes[i][0], sizes[j][0]) - 1e-9]
        found = compared(reach, step)
        if last(found) is not None:
            break
    return found

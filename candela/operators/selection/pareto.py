"""Pareto fronts and crowding distance; all objectives are maximised, a missing one counts 0.

A front is found in falling order of the objectives' sum, in which dominators come first, after every task has dropped what its own rows
dominate. Peeling fronts stops once enough rows are covered. The ranks of all rows are lengths of chains: over a grid of ranges for
two objectives, in n log n and without a collect; in one sweep over blocks for more.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_left, bisect_right
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candela.operators.staging import shared_folder, staged

BLOCK_ROWS = 20_000
#: Distinct points that a cell of the grid should hold, and how many times that the fullest may hold.
CELL_ROWS, FULLEST = 100_000, 5


def _undominated(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    keep = np.ones(len(points), bool)
    for at in range(0, len(others), 256):
        o = others[at : at + 256]
        some = np.flatnonzero(keep)
        p = points[some]
        worse = ((o[None] >= p[:, None]).all(-1) & (o[None] > p[:, None]).any(-1)).any(1)
        keep[some[worse]] = False
    return keep


def _points(batch, objectives) -> np.ndarray:
    return np.stack([np.asarray(batch.column(c), float) for c in objectives], 1) if batch.num_rows else np.zeros((0, len(objectives)))


def _summed(objectives: list[str]) -> list:
    """Falling order in which every dominator comes first: the objectives too, since sums may be equal after rounding."""
    return [F.desc(sum((F.col(c) for c in objectives[1:]), F.col(objectives[0]))), *(F.desc(c) for c in objectives)]


def front(d: DataFrame, objectives: list[str]) -> DataFrame:
    """The rows of ``d`` (objectives without nulls) that no other row dominates.

    Each task first drops what its own rows dominate. Of the rest the BLOCK_ROWS points highest in sum are compared with each other;
    what stays is on the front, since dominators have the higher sum, and it drops what it dominates before the next points are
    taken. So only points of the front are sent to the tasks, and each round's rest is stored."""
    names, flag = d.columns, "front_state"

    def local(batches):
        kept = None
        for b in batches:
            t = pa.Table.from_batches([b] if kept is None else [*kept.to_batches(), b])
            p = _points(t.combine_chunks().to_batches()[0], objectives) if t.num_rows else np.zeros((0, len(objectives)))
            t = t.filter(pa.array(_undominated(p, p)))
            kept = t.combine_chunks()
        if kept is not None:
            yield from kept.to_batches()

    left, done = staged(d.select(*names).mapInArrow(local, d.schema), "front"), []
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema) + f", {flag} boolean"
    while rows := left.select(*objectives).distinct().orderBy(*_summed(objectives)).limit(BLOCK_ROWS).collect():
        top = np.array([tuple(r) for r in rows], float)
        sent = d.sparkSession.sparkContext.broadcast((top[_undominated(top, top)], top))

        def against(batches, sent=sent):
            final, top = sent.value
            row = np.dtype((np.void, 8 * len(objectives)))
            same = lambda p, q: np.isin(np.ascontiguousarray(p + 0.0).view(row).ravel(), np.ascontiguousarray(q + 0.0).view(row).ravel())
            for b in batches:
                p = _points(b, objectives)
                on = same(p, final)
                keep = on | (~same(p, top) & _undominated(p, final))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(on)], names=[*names, flag]).filter(pa.array(keep))

        split = staged(left.mapInArrow(against, schema), "front")
        done.append(split.where(flag).select(*names))
        left = split.where(~F.col(flag)).select(*names)
    return reduce(DataFrame.unionByName, done) if done else left


def fronts(d: DataFrame, id_col: str, objectives: list[str], cover: int | None = None) -> DataFrame:
    """``d`` with pareto_rank from 1. With ``cover`` fronts are peeled until that many rows are ranked; without it all rows are
    ranked, by chains over a grid for two objectives and in an ordered sweep for more."""
    left = staged(d.select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in objectives else F.col(c) for c in d.columns)), "pareto")
    if cover is None:
        return chained(left, objectives) if len(objectives) == 2 else swept(left, objectives)
    out, rank, covered = None, 0, 0
    while covered < cover:
        rank += 1
        top = staged(front(left, objectives), "rank")
        n = top.count()
        if not n:
            break
        one = top.withColumn("pareto_rank", F.lit(rank))
        out, covered = one if out is None else out.unionByName(one), covered + n
        left = staged(left.join(top.select(id_col), id_col, "left_anti").select(*left.columns), "pareto")
    return out if out is not None else left.withColumn("pareto_rank", F.lit(0))


def _stairs(steps: list[tuple[float, int]]) -> list[tuple[float, int]]:
    """Of (value, rank) those that no other beats in both, by falling value and so rising rank."""
    out: list[tuple[float, int]] = []
    for v, r in sorted(steps, key=lambda s: (-s[0], -s[1])):
        if not out or r > out[-1][1]:
            out.append((v, r))
    return out


def _ranked_cell(a: np.ndarray, b: np.ndarray, above: list[tuple[float, int]], beside: list[tuple[float, int]]) -> tuple[list[int], list[tuple[float, int]], list[tuple[float, int]]]:
    """Ranks of a cell's distinct points, in falling order of (a, b), in n log n.

    ``above`` has (b, rank) of the points with higher a in the same range of b, ``beside`` (a, rank) of those with higher b; both as
    stairs. The highest rank over a point is found in the stairs of its own range by bisection and in the others' by a pointer.
    Returned are the ranks and the stairs that the cells below and beside need."""
    negative, ranks = [-v for v, _ in above], [r for _, r in above]  # both rising
    out, at, other = [], 0, 0
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        while at < len(beside) and beside[at][0] >= x:
            other = beside[at][1]
            at += 1
        i = bisect_right(negative, -y)
        r = 1 + max(other, ranks[i - 1] if i else 0)
        out.append(r)
        j = bisect_left(ranks, r)  # stairs of no higher rank and no higher b give way
        if j < len(ranks) and ranks[j] == r:
            j += 1
        lo = bisect_left(negative, -y, 0, j)
        negative[lo:j], ranks[lo:j] = [-y], [r]
    below = [(-v, r) for v, r in zip(negative, ranks, strict=True)]
    base = [(math.inf, above[-1][1])] if above else []
    return out, below, _stairs([*beside, *base, *zip(a.tolist(), out, strict=True)])


def chained(d: DataFrame, objectives: list[str]) -> DataFrame:
    """``d`` (stored, two objectives without nulls) with pareto_rank: the longest chain of dominators that ends in a row.

    The distinct points are cut into a grid of ranges of both objectives. A cell needs the stairs of the cell above it (higher in
    the first objective) and of the one beside it (higher in the second), so the cells of a diagonal are ranked at once, each in
    n log n by one task, and their stairs are stored for the next diagonal. Nothing but the ranges' bounds reaches the driver.

    Diagonals follow each other, so there should be few. Where the objectives are independent, n / CELL_ROWS cells are a grid whose side is
    the root of that; where they run together the points lie in fewer of its cells, and the grid is made finer until none is too full."""
    one, two = objectives
    points = d.select(F.col(one).alias("a"), F.col(two).alias("b")).distinct()
    points = staged(points.select((F.col("a") + 0.0).alias("a"), (F.col("b") + 0.0).alias("b")), "points")
    finest = max(1, math.ceil(points.count() / CELL_ROWS))
    grid = math.isqrt(finest - 1) + 1
    cell = lambda c, cuts: sum(((F.col(c) < v).cast("int") for v in cuts), F.lit(0))
    while True:
        bounds = [[q for q in sorted(set(v), reverse=True)] for v in points.approxQuantile(["a", "b"], [k / grid for k in range(1, grid)], 0.2 / grid)] if grid > 1 else [[], []]
        cells = points.withColumn("i", cell("a", bounds[0])).withColumn("j", cell("b", bounds[1]))
        if grid == finest or cells.groupBy("i", "j").count().agg(F.max("count")).first()[0] <= FULLEST * CELL_ROWS:
            break
        grid = min(2 * grid, finest)
    columns = len(bounds[1]) + 1
    cells = cells.withColumn("turn", F.col("i") + F.col("j")).repartition("turn", "i")  # a cell is one file
    path = f"{shared_folder(d.sparkSession)}/staged-cells-{uuid.uuid4().hex}"
    cells.write.partitionBy("turn").parquet(path)  # a diagonal is a folder
    fields = "i int, j int, kind string, a double, b double, rank long"
    cells = d.sparkSession.read.schema("a double, b double, i int, j int, turn int").parquet(path).select("i", "j", F.lit("point").alias("kind"), "a", "b", F.lit(0).cast("long").alias("rank"), "turn")

    def rank(table):
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        a, b, r = (np.asarray(table.column(c)) for c in ("a", "b", "rank"))
        here = {k: np.flatnonzero(np.asarray(pc.equal(table.column("kind"), k))) for k in ("point", "above", "beside")}
        stairs = {k: sorted(zip(a[here[k]].tolist(), r[here[k]].tolist(), strict=True), key=lambda s: -s[0]) for k in ("above", "beside")}
        mine = here["point"]
        mine = mine[np.lexsort((-b[mine], -a[mine]))]
        ranks, below, beside = _ranked_cell(a[mine], b[mine], stairs["above"], stairs["beside"])
        n, under, over = len(mine), len(below), len(beside)
        columns = {
            "i": pa.array(np.repeat([i, i + 1, i], [n, under, over]), pa.int32()),
            "j": pa.array(np.repeat([j, j, j + 1], [n, under, over]), pa.int32()),
            "kind": pa.array(np.repeat(["done", "above", "beside"], [n, under, over]), pa.string()),
            "a": pa.array(np.concatenate([a[mine], [v for v, _ in below], [v for v, _ in beside]]), pa.float64()),
            "b": pa.array(np.concatenate([b[mine], np.zeros(under + over)]), pa.float64()),
            "rank": pa.array([*ranks, *(k for _, k in below), *(k for _, k in beside)], pa.int64()),
        }
        return pa.table(columns)

    done, stairs = [], None
    for turn in range(len(bounds[0]) + columns):
        here = cells.where(F.col("turn") == turn).drop("turn")
        step = staged((here if stairs is None else here.unionByName(stairs)).groupBy("i", "j").applyInArrow(rank, fields), "diagonal")
        done.append(step.where("kind = 'done'").select("a", "b", "rank"))
        stairs = step.where((F.col("kind") != "done") & (F.col("i") <= len(bounds[0])) & (F.col("j") < columns))
    ranks = reduce(DataFrame.unionByName, done).select(F.col("a").alias("chain_a"), F.col("b").alias("chain_b"), F.col("rank").cast("int").alias("pareto_rank"))
    return d.join(ranks, (F.col(one) + 0.0 == F.col("chain_a")) & (F.col(two) + 0.0 == F.col("chain_b"))).select(*d.columns, "pareto_rank")


def _chained(points: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Ranks of ``points``, dominators first: one more than the highest rank among a point's dominators, here or ``below``."""
    ranks = below + 1
    for i in range(1, len(points)):
        p, o = points[i], points[:i]
        over = (o >= p).all(1) & (o > p).any(1)
        if over.any():
            ranks[i] = max(ranks[i], ranks[:i][over].max() + 1)
    return ranks


def swept(d: DataFrame, objectives: list[str]) -> DataFrame:
    """``d`` (stored, objectives without nulls) with pareto_rank. Rows are put in falling order of the objectives' sum, so that
    dominators come first, and are ranked in blocks of BLOCK_ROWS: a block's points are sent to the tasks that hold the rows
    ranked before, each answers with the highest rank that dominates a point, and the block's own chains are added. The rank
    of a point is the length of the longest chain of dominators that ends in it."""
    spark, names = d.sparkSession, d.columns
    total, place, part = "sweep_total", "sweep_place", "sweep_part"
    keys = [F.desc(total), *(F.desc(c) for c in objectives)]  # the objectives too: sums may be equal after rounding

    def number(batches):
        from pyspark import TaskContext

        me, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(np.full(b.num_rows, me, np.int32)), pa.array(np.arange(at, at + b.num_rows))], names=[*names, part, place])
            at += b.num_rows

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = d.withColumn(total, sum((F.col(c) for c in objectives[1:]), F.col(objectives[0]))).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ordered = staged(ordered.mapInArrow(number, f"{fields}, {part} int, {place} long"), "sweep")
    counts = {r[part]: r["count"] for r in ordered.groupBy(part).count().collect()}  # a row a task
    lift, n = [], 0
    for k in range(max(counts, default=-1) + 1):
        lift.append(n)
        n += counts.get(k, 0)
    if not n:
        return d.withColumn("pareto_rank", F.lit(0))
    lifts = spark.createDataFrame(list(enumerate(lift)), f"{part} int, sweep_lift long")
    ordered = staged(ordered.join(F.broadcast(lifts), part).withColumn(place, F.col(place) + F.col("sweep_lift")).drop("sweep_lift", part), "sweep")
    done = []
    for first in range(0, n, BLOCK_ROWS):
        mine = ordered.where(F.col(place).between(first, first + BLOCK_ROWS - 1)).select(place, *objectives)
        rows = sorted(tuple(r) for r in mine.collect())  # BLOCK_ROWS at most
        points, below = np.array([r[1:] for r in rows], float), np.zeros(len(rows), np.int64)
        if done:
            sent = spark.sparkContext.broadcast(points)

            def highest(batches, sent=sent):
                best = np.zeros(len(sent.value), np.int64)
                for b in batches:
                    o, rank = _points(b, objectives), np.asarray(b.column("pareto_rank"))
                    for at in range(0, len(o), 64):
                        x = o[at : at + 64, None]
                        over = (x >= sent.value[None]).all(-1) & (x > sent.value[None]).any(-1)
                        best = np.maximum(best, (over * rank[at : at + 64, None]).max(0))
                hit = np.flatnonzero(best)
                yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(best[hit])], names=["i", "best"])

            for r in reduce(DataFrame.unionByName, done).mapInArrow(highest, "i long, best long").groupBy("i").agg(F.max("best").alias("best")).collect():
                below[r["i"]] = max(below[r["i"]], r["best"])
        ranks = _chained(points, below)
        made = spark.createDataFrame([(r[0], int(k)) for r, k in zip(rows, ranks, strict=True)], f"{place} long, pareto_rank int")
        new = staged(ordered.join(made, place).select(*names, "pareto_rank"), "ranked")
        done.append(new)
    return reduce(DataFrame.unionByName, done)


def with_crowding(ranked: DataFrame, id_col: str, objectives: list[str]) -> DataFrame:
    """crowding_distance within each front: gaps between neighbours over the front's range, summed over the objectives; the
    ends of each objective, and fronts of one or two rows, are infinite. Equal values are ordered by the objectives before,
    then by the identifier."""
    w = Window.partitionBy("pareto_rank")
    total, ends = F.lit(0.0), F.count("*").over(w) <= 2
    d = ranked
    for k, c in enumerate(objectives):
        order = w.orderBy(c, *reversed(objectives[:k]), id_col)
        d = d.withColumn(f"__next{k}", F.lead(c).over(order)).withColumn(f"__prev{k}", F.lag(c).over(order)).withColumn(f"__span{k}", F.max(c).over(w) - F.min(c).over(w))
        n, p, s = F.col(f"__next{k}"), F.col(f"__prev{k}"), F.col(f"__span{k}")
        ends = ends | n.isNull() | p.isNull()
        total = total + F.coalesce(F.when(s > 0, (n - p) / s), F.lit(0.0))
    d = d.withColumn("__ends", ends).withColumn("crowding_distance", F.when(F.col("__ends"), F.lit(float("inf"))).otherwise(total))
    return d.drop("__ends", *(f"__{n}{k}" for n in ("next", "prev", "span") for k in range(len(objectives))))


def top_k(d: DataFrame, id_col: str, objectives: list[str], k: int) -> DataFrame:
    """The first ``k`` rows by front, then crowding distance, then identifier."""
    return with_crowding(fronts(d, id_col, objectives, cover=k), id_col, objectives).orderBy("pareto_rank", F.desc("crowding_distance"), id_col).limit(k)

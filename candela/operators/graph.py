"""The research graph as node and edge tables: integrity, reachability, acyclicity, upserts.

nodes (id, node_type, payload), edges (source, target, edge_type). Loops write each step to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candela.operators import events as E
from candela.operators.staging import dealt, staged


class CycleFound(ValueError):
    """Raised where a graph must be acyclic and is not."""


def integrity_events(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an id; edges whose source or target is no node. The ends that are no node are found first, each once, and
    stored; only their edges are events."""
    n = max(nodes.count(), 2 * edges.count())
    named = edges.select(F.col("source").alias("id")).union(edges.select("target")).where("id is not null")
    unknown = dealt(named, "id", n).distinct().join(dealt(nodes.select("id").where("id is not null"), "id", n), "id", "left_anti")
    unknown, ends = staged(unknown, "unknown").select(F.col("id").alias("unknown")), []
    for side in ("source", "target"):
        bad = edges.join(unknown, F.col(side) == F.col("unknown"), "left_semi").unionByName(edges.where(F.col(side).isNull()))
        ends.append(bad.select(E.event("error", f"EDGE_{side.upper()}_UNKNOWN", F.concat(F.lit(f"edge {side} is not a node: "), F.coalesce(side, F.lit(""))), row_id=F.col(side)).alias("e")).select("e.*"))
    return E.union(nodes.where("id is null").select(E.event("error", "NODE_ID_MISSING", "node without an id").alias("e")).select("e.*"), *ends)


#: Steps along the edges before paths are doubled.
STEPS = 6


def _doubled(hop: DataFrame) -> DataFrame:
    """(id, next) over paths twice as long as those of ``hop``."""
    return staged(hop.join(hop.select(F.col("id").alias("next"), F.col("next").alias("far")), "next").select("id", F.col("far").alias("next")).distinct(), "hop")


def reachable(edges: DataFrame, starts: DataFrame, *, up: bool = False) -> DataFrame:
    """(start, id): every node reachable from each id of ``starts``, along the edges or (``up``) against them; itself left out.

    A frontier join a step for STEPS steps, in which a node is followed once a start. Where the graph is deeper, paths are doubled: what
    is known within d steps, and what paths of just d lead to from there, is what is known within 2 d, so the rounds grow with the logarithm of the depth.
    """
    near, far = ("target", "source") if up else ("source", "target")
    hop = staged(edges.select(F.col(near).alias("id"), F.col(far).alias("next")).distinct(), "steps")
    seen = front = staged(starts.select(F.col("id").alias("start"), "id").distinct(), "front")
    for _ in range(STEPS):
        front = staged(front.join(hop, "id").select("start", F.col("next").alias("id")).distinct().join(seen, ["start", "id"], "left_anti"), "front")
        if front.isEmpty():
            return seen.where("start <> id")
        seen = seen.unionByName(front)
    seen = staged(seen.distinct(), "seen")
    n = seen.count()
    while True:
        seen = staged(seen.unionByName(seen.join(hop, "id").select("start", F.col("next").alias("id"))).distinct(), "seen")
        m = seen.count()
        if m == n:
            return seen.where("start <> id")
        n, hop = m, _doubled(hop)


def on_cycles(edges: DataFrame) -> DataFrame:
    """The edges on or behind a cycle, empty if there is none: those left after peeling nodes without incoming edges, again and again.

    After STEPS rounds of peeling, paths are doubled instead until they are longer than the nodes are many: an edge is left if
    such a path ends at its source."""
    left = staged(edges.select("source", "target").distinct(), "peel")
    n = left.count()
    for _ in range(STEPS):
        left = staged(left.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi"), "peel")
        m = left.count()
        if m in (0, n):
            return left
        n = m
    hop, length, nodes = left.select(F.col("source").alias("id"), F.col("target").alias("next")), 1, left.select("source").union(left.select("target")).distinct().count()
    while length < nodes and not hop.isEmpty():
        hop, length = _doubled(hop), 2 * length
    return left.join(hop.select(F.col("next").alias("source")).distinct(), "source", "left_semi")


def check_acyclic(edges: DataFrame) -> None:
    if not on_cycles(edges).isEmpty():
        raise CycleFound("the graph must be acyclic")


def merge(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: rows of both, of equal keys the newer; among new rows the last by ``seq`` if there is one."""
    order = [F.desc("__new")] + ([F.desc("seq")] if "seq" in new.columns else [])
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n", "__new")


def merge_graph(nodes: DataFrame, edges: DataFrame, more_nodes: DataFrame, more_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return merge(nodes, more_nodes, ["id"]), merge(edges, more_edges, ["source", "target"])


def size(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("node_count")).crossJoin(edges.agg(F.count("*").alias("edge_count")))

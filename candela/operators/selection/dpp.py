"""Greedy MAP of a determinantal point process with an RBF kernel and exponential quality.

Incremental Cholesky form (Chen, Zhang and Zhou 2018): with the chosen rows' factor L, a candidate's gain is
log(k_ii - |L^-1 k_i|^2). Picks are lazy: a pass over the candidates with the chosen vectors broadcast - at most q of them - serves all
picks until one could come from the rows that it left behind. A pass holds no state but the choices, so lost tasks are simply run again.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that one pass brings to the driver.
ACTIVE = 2048


def mean_pairwise_distance(vectors: list[list[float]]) -> float:
    """Of the few selected vectors."""
    n = len(vectors)
    if n < 2:
        return 0.0
    x = np.array(vectors)
    return float(np.mean([np.linalg.norm(x[i] - x[j]) for i in range(n) for j in range(i)]))


def greedy_map(candidates: DataFrame, q: int, *, order_col: str, vector_col: str, quality_col: str | None = None, temperature: float = 10.0, gamma: float | None = None) -> tuple[list[dict], float]:
    """(trace, mean pairwise distance). The trace has step, key (of ``order_col``), quality, gain and log_det for each of
    ``q`` picks; ties go to the smallest key. Where no candidate has a positive determinant, the best quality left is taken
    with log_det 0. Without a quality column the overall score counts, else
    the manufacturability score; missing qualities count 50; no candidates, no picks."""
    if temperature <= 0:
        raise ValueError(f"temperature must be positive, got {temperature}")
    d = candidates.select(F.col(order_col).alias("key"), F.col(vector_col).cast("array<double>").alias("x"), F.coalesce(*(F.col(c).cast("double") for c in ([quality_col] if quality_col else ["overall_score", "manufacturability_score"]) if c in candidates.columns), F.lit(50.0)).alias("s"))
    top = d.agg(F.max("s")).first()[0]
    if top is None:
        return [], 0.0
    chosen = _lazy(d, q, top, temperature, gamma if gamma is not None else 1.0 / max(1, len(d.select("x").first()[0])))
    trace, total = [], 0.0
    for step, c in enumerate(chosen):
        gain = math.log(c["gain"]) if c["positive"] else 0.0
        total = total + gain if c["positive"] else 0.0
        trace.append({"step": step + 1, "key": c["key"], "quality": c["s"], "gain": gain, "log_det": total})
    return trace, mean_pairwise_distance([c["x"] for c in chosen])


class Chosen:
    """The rows chosen so far with their factor: gains of other rows against them."""

    def __init__(self, chosen: list[dict], top: float, temperature: float, width: float):
        self.top, self.temperature, self.width, self.keys = top, temperature, width, {c["key"] for c in chosen}
        self.x = np.array([c["x"] for c in chosen])
        self.w = self.quality(np.array([c["s"] for c in chosen]))
        if len(chosen):
            sq = ((self.x[:, None] - self.x[None]) ** 2).sum(-1)
            self.factor = np.linalg.cholesky(np.outer(self.w, self.w) * np.exp(-width * sq) + 1e-300 * np.eye(len(chosen)))

    def quality(self, s: np.ndarray) -> np.ndarray:
        return np.exp((s - self.top) / self.temperature)

    def gains(self, x: np.ndarray, s: np.ndarray) -> np.ndarray:
        quality = self.quality(s)
        if not len(self.x):
            return quality**2
        sq = np.maximum(0.0, (x**2).sum(1)[:, None] + (self.x**2).sum(1)[None] - 2 * x @ self.x.T)
        k = quality[:, None] * self.w[None] * np.exp(-self.width * sq)
        return quality**2 - (np.linalg.solve(self.factor, k.T) ** 2).sum(0)


def _lazy(d: DataFrame, q: int, top: float, temperature: float, width: float) -> list[dict]:
    """The ``q`` picks, each the row of the highest gain, ties to the smallest key. Gains only fall as rows are chosen. So a pass over
    all rows brings the ACTIVE best and the gain of the next one, which no row left behind can ever pass; picks are then made among the active, whose gains
    are worked out again, until the best is no longer above that bound, and only then the rows are read again."""
    spark, chosen, singular = d.sparkSession, [], False
    kind = d.schema["key"].dataType.simpleString()
    while len(chosen) < q:
        sent = spark.sparkContext.broadcast(Chosen([] if singular else chosen, top, temperature, width))
        done = spark.sparkContext.broadcast({c["key"] for c in chosen})

        def gained(batches, sent=sent, done=done, singular=singular):
            best = np.zeros(0)  # the highest worths that this task has met
            for b in batches:
                if not b.num_rows:
                    continue
                s = np.asarray(b.column("s"))
                gain = sent.value.gains(b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), s)
                positive = (gain > 1e-12 * sent.value.quality(s) ** 2) & (not singular)
                left = np.array([k not in done.value for k in b.column("key").to_pylist()]) if done.value else np.ones(b.num_rows, bool)
                worth = np.where(positive, gain, s)
                best = np.concatenate([best, worth[left & (positive | singular)]])
                if len(best) > ACTIVE:  # what ACTIVE + 1 rows of this task pass can't be among the first of all
                    best = np.partition(best, len(best) - ACTIVE - 1)[len(best) - ACTIVE - 1 :]
                    left &= (positive | singular) & (worth >= best[0])
                left = pa.array(left)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "x", "s")), pa.array(positive), pa.array(np.where(positive, gain, s))], names=["key", "x", "s", "positive", "worth"]).filter(left)

        rows = d.mapInArrow(gained, f"key {kind}, x array<double>, s double, positive boolean, worth double")
        best = rows.orderBy(F.desc("positive"), F.desc("worth"), "key").limit(ACTIVE + 1).collect()
        if not best:
            break
        first = best[0]
        chosen.append({"key": first["key"], "x": list(first["x"]), "s": first["s"], "positive": first["positive"], "gain": first["worth"]})
        if not first["positive"]:
            singular = True  # once a set is singular, so is every larger one: the best qualities left follow
            for r in best[1 : min(ACTIVE, q - len(chosen) + 1)]:
                chosen.append({"key": r["key"], "x": list(r["x"]), "s": r["s"], "positive": False, "gain": r["worth"]})
            continue
        bound = best[ACTIVE]["worth"] if len(best) > ACTIVE and best[ACTIVE]["positive"] else 0.0
        active = best[1:ACTIVE]
        x, s, keys = np.array([r["x"] for r in active]), np.array([r["s"] for r in active]), [r["key"] for r in active]
        free = np.ones(len(active), bool)
        while len(chosen) < q and free.any():
            now = Chosen(chosen, top, temperature, width)
            gain = np.where(free, now.gains(x, s), -np.inf)
            best_gain = gain.max()
            if not best_gain > max(bound * (1 + 1e-9), 1e-12 * float(now.quality(s[int(gain.argmax())])) ** 2):
                break
            i = min(np.flatnonzero(gain == best_gain).tolist(), key=lambda i: keys[i])
            chosen.append({"key": keys[i], "x": x[i].tolist(), "s": float(s[i]), "positive": True, "gain": float(best_gain)})
            free[i] = False
    return chosen[:q]


def select_batch(candidates: DataFrame, q: int, **how) -> DataFrame:
    """``greedy_map``'s trace as a table."""
    trace, _ = greedy_map(candidates, q, **how)
    kind = candidates.schema[how["order_col"]].dataType.simpleString()
    return candidates.sparkSession.createDataFrame([(t["step"], t["key"], t["quality"], t["gain"], t["log_det"]) for t in trace], f"step int, `{how['order_col']}` {kind}, quality double, gain double, log_det double")

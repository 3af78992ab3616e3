"""A health monitor over call events: three breaker states, window failure rates, fallback routing.

Calls of an agent are taken in event time. The batch form folds each agent's rows, streamed in time order from Spark's
sort, so an agent with very many calls is never held in memory; the streaming form keeps the same state a key.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    window: int = 10
    threshold: float = 0.40
    least_calls: int = 5
    timeout_s: float = 30.0
    canaries: int = 2


class Breaker:
    """The state machine of one agent: closed, open, half_open."""

    def __init__(self, config: Config, state: str = "closed", since: float = 0.0, wins: int = 0, history: str = ""):
        self.config, self.state, self.since, self.wins = config, state, since, wins
        self.history: deque[str] = deque(history, config.window)

    def allowed(self, at: float) -> bool:
        if self.state == "open" and at - self.since >= self.config.timeout_s:
            self.state, self.since, self.wins = "half_open", at, 0
        return self.state != "open"

    def record(self, ok: bool, at: float) -> None:
        self.history.append("1" if ok else "0")
        if ok:
            if self.state == "half_open":
                self.wins += 1
                if self.wins >= self.config.canaries:
                    self.state, self.since = "closed", at
                    self.history.clear()
        elif self.state == "half_open" or (len(self.history) >= self.config.least_calls and self.history.count("0") / len(self.history) >= self.config.threshold):
            self.state, self.since = "open", at

    def call(self, ok: bool, at: float) -> tuple[str, bool]:
        """(state after, blocked): a blocked call is not made and leaves no trace."""
        if not self.allowed(at):
            return self.state, True
        self.record(ok, at)
        return self.state, False

    def saved(self) -> tuple[str, float, int, str]:
        return self.state, self.since, self.wins, "".join(self.history)


def states(calls: DataFrame, config: Config = Config()) -> DataFrame:
    """calls (agent, ts, seq, ok) with state after the call, blocked, and use_fallback."""
    keys = calls.withColumn("__at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    names = calls.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agent, breaker = object(), None
        for b in batches:
            out = []
            for who, ok, at in zip(b.column("agent").to_pylist(), b.column("ok").to_pylist(), b.column("__at").to_pylist(), strict=True):
                if who != agent:
                    agent, breaker = who, Breaker(config)
                out.append(breaker.call(bool(ok), at))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array([s for s, _ in out], pa.string()), pa.array([x for _, x in out], pa.bool_())], names=[*names, "state", "blocked"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in calls.schema) + ", state string, blocked boolean"
    ordered = keys.repartition("agent").sortWithinPartitions("agent", "ts", "seq")
    return ordered.mapInArrow(fold, schema).withColumn("use_fallback", F.col("blocked") | ~F.col("ok"))


def failure_rates(calls: DataFrame, window: int = 10) -> DataFrame:
    """Failure rate over the last ``window`` calls of the agent, this one included."""
    w = Window.partitionBy("agent").orderBy("ts", "seq").rowsBetween(-(window - 1), 0)
    return calls.withColumn("failure_rate", F.avg((~F.col("ok")).cast("double")).over(w)).withColumn("n_calls", F.count("*").over(w))

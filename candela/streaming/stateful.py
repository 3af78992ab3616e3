"""Stateful stream operators with timers: breaker states in event time, and candidate cards that start from a table.

Both keep RocksDB state a key and are stateful processors; ``drained`` runs a stream over what is there now and hands
back the rows it wrote. Calls may come shuffled and late, up to the watermark's delay: they wait in the key's state until the watermark
has passed them and are then folded in order, so the result is that of the batch form.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from candela.operators.health import Breaker, Config
from candela.operators.staging import shared_folder
from candela.operators.telemetry import STAGES
from candela.streaming.cards import new_card

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

EVENTS = "agent string, kind string, seq long, at_us long, state string, blocked boolean"
CARDS = "candidate_id string, stage string, seq long, experiment_state string, status string, potency double, risk_flags array<string>"


class Breakers(StatefulProcessor):
    """State of an agent: its breaker, whether the present opening's end was told, and the calls that the watermark has not passed."""

    def __init__(self, config: Config):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.breaker = handle.getValueState("breaker", "state string, since double, wins int, history string, told boolean")
        self.waiting = handle.getListState("waiting", "at_us long, seq long, ok boolean")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(a), int(s), bool(o)) for part in rows for a, s, o in zip(part["at_us"], part["seq"], part["ok"], strict=True)]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(max(a for a, _, _ in new) // 1000 + 1)
        yield self.released(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.released(key, timerValues.getCurrentWatermarkInMs())

    def released(self, key, watermark_ms: int) -> pd.DataFrame:
        """All that the watermark has passed, in order: calls with the state after them, and the moments at which an open breaker half-opens."""
        now = watermark_ms * 1000
        queue = sorted(tuple(r) for r in self.waiting.get())
        due = [r for r in queue if r[0] <= now]
        *saved, told = self.breaker.get() if self.breaker.exists() else (*Breaker(self.config).saved(), False)
        breaker, out = Breaker(self.config, *saved), []

        def half_open(until: int) -> None:
            nonlocal told
            moment = round((breaker.since + self.config.timeout_s) * 1e6)
            if breaker.state == "open" and not told and moment <= until:
                out.append((key[0], "timer", None, moment, "half_open", False))
                told = True

        for at, seq, ok in due:
            half_open(at)
            was = breaker.state, breaker.since
            state, blocked = breaker.call(ok, at / 1e6)
            if state == "open" and (breaker.state, breaker.since) != was:
                told = False
                self.handle.registerTimer(round((breaker.since + self.config.timeout_s) * 1e3) + 1)
            out.append((key[0], "call", seq, at, state, blocked))
        half_open(now)
        if due:
            rest = [r for r in queue if r[0] > now]
            self.waiting.put(rest) if rest else self.waiting.clear()
        self.breaker.update((*breaker.saved(), told))
        frame = pd.DataFrame(out, columns=["agent", "kind", "seq", "at_us", "state", "blocked"])
        return frame.astype({"seq": "Int64", "at_us": "int64", "blocked": "bool"})


def breaker_events(calls: DataFrame, config: Config = Config(), *, late: str = "10 minutes") -> DataFrame:
    """A stream of calls (agent, ts, seq, ok) as EVENTS: a row a call with the breaker's state after it, and a timer row where an open
    breaker half-opens, whether or not a call comes. Calls later than ``late`` are dropped by the watermark."""
    rows = calls.select("agent", F.col("ts").cast("timestamp").alias("ts"), "seq", "ok", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us")).withWatermark("ts", late)
    return rows.groupBy("agent").transformWithStateInPandas(Breakers(config), EVENTS, "append", "eventTime")


class Cards(StatefulProcessor):
    """State of a bucket of candidates: each one's card with the records already applied to it, which expires ``ttl_ms`` after its last change.

    A bucket's records are folded at once, over columns; a call a candidate would cost more than its records do."""

    def __init__(self, ttl_ms: int | None, every: bool):
        self.ttl_ms, self.every = ttl_ms, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        value = "experiment_state string, status string, potency double, risk_flags array<string>, stages array<string>, applied binary"
        self.cards = handle.getMapState("cards", "candidate_id string", value, self.ttl_ms)

    def close(self) -> None:
        pass

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples():
            self.cards.updateValue((r.candidate_id,), (r.experiment_state, r.status, None if pd.isna(r.potency) else float(r.potency), list(r.risk_flags), [], b""))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        names = ["candidate_id", "stage", "seq", "experiment_state", "status", "potency", "risk_flags"]
        f = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=["candidate_id", "stage", "seq", "passed", "codes", "potency"])
        f = f.sort_values(["candidate_id", "seq"], kind="stable").drop_duplicates(["candidate_id", "stage", "seq"], ignore_index=True)
        ids, saved = list(dict.fromkeys(f["candidate_id"])), {}
        for c in ids:
            saved[c] = self.cards.getValue((c,)) or (*new_card().values(), [], b"")
        old = [(c, st[k], q) for c, (*_, st, packed) in saved.items() if packed for q, k in zip(*_unpacked(packed), strict=True)]
        if old:
            seen = pd.MultiIndex.from_tuples(old)
            f = f[~pd.MultiIndex.from_frame(f[["candidate_id", "stage", "seq"]]).isin(seen)].reset_index(drop=True)
        if not len(f):
            return
        of, ids = pd.factorize(f["candidate_id"])  # sorted, so a candidate's records are neighbours
        start = np.searchsorted(of, np.arange(len(ids)))
        end = np.append(start[1:], len(f))
        before = [saved[c] for c in ids]
        passed, third = f["passed"].to_numpy(bool), (f["stage"] == STAGES[2]).to_numpy(bool)
        experiment = np.where(third, "measured", np.where(passed, "in_flight_assay", "failed")).astype(object)
        status = _carried(np.where(~passed, "rejected", "evaluated").astype(object), ~passed | third, of, start, [b[1] for b in before])
        potency = _carried(f["potency"].to_numpy(object), third, of, start, [b[2] for b in before])
        named = f["codes"].to_numpy(object)
        change = (named != "") & ~f.duplicated(["candidate_id", "codes"]).to_numpy()  # others name no new flag
        lists, flags = np.empty(len(f), object), [list(b[3]) for b in before]
        first = [list(x) for x in flags]
        for r in np.flatnonzero(change).tolist():
            flags[of[r]] = lists[r] = list(dict.fromkeys([*flags[of[r]], *named[r].split("\n")]))
        lists = _carried(lists, change, of, start, first)
        stage, seq = f["stage"].to_numpy(object), f["seq"].to_numpy(np.int64)
        for k, c in enumerate(ids):
            a, z = start[k], end[k]
            known, packed = list(before[k][4]), bytes(before[k][5])
            known += [x for x in dict.fromkeys(stage[a:z]) if x not in known]
            at, no = _unpacked(packed)
            packed = np.concatenate([at, seq[a:z]]).tobytes() + np.concatenate([no, np.array([known.index(x) for x in stage[a:z]], np.uint8)]).tobytes()
            last = potency[z - 1]
            self.cards.updateValue((c,), (experiment[z - 1], status[z - 1], None if last is None else float(last), lists[z - 1], known, packed))
        out = np.arange(len(f)) if self.every else end - 1
        frame = pd.DataFrame(dict(zip(names, (f["candidate_id"].to_numpy(object)[out], stage[out], seq[out], experiment[out], status[out], potency[out], lists[out]), strict=True)))
        yield frame.astype({"seq": "int64", "potency": "float64"})


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Records applied: their seq, and where their stage stands among the card's stages."""
    n = len(packed) // 9
    return np.frombuffer(packed, np.int64, n), np.frombuffer(packed, np.uint8, n, 8 * n)


def _carried(values: np.ndarray, known: np.ndarray, of: np.ndarray, start: np.ndarray, before: list) -> np.ndarray:
    """Of each record the last known value of its candidate up to there, else the one from ``before``."""
    at = np.maximum.accumulate(np.where(known, np.arange(len(values)), -1))
    held = np.empty(len(before), object)
    held[:] = before
    inside = at >= start[of]
    out = held[of]
    out[inside] = values[at[inside]]
    return out


#: Groups of candidates that share a call and its columns.
BUCKETS = 1_024


def fold_cards(outcomes: DataFrame, cards: DataFrame | None = None, *, ttl_ms: int | None = None, every: bool = True) -> DataFrame:
    """A stream of ``cards.outcomes`` rows folded a candidate in order of seq, a row a record with the card after it; without ``every``
    only a row a candidate and micro-batch, its card after the last record. Cards start from
    the table ``cards`` (candidate_id, experiment_state, status, potency, risk_flags), each once, else as designed drafts; a record
    delivered again changes nothing; with ``ttl_ms`` a card untouched for so long is forgotten."""
    bucket = F.pmod(F.xxhash64("candidate_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
    start = cards.select(bucket, "candidate_id", "experiment_state", "status", "potency", "risk_flags").groupBy("bucket") if cards is not None else None
    rows = outcomes.select(bucket, "candidate_id", "stage", "seq", "passed", F.array_join("codes", "\n").alias("codes"), "potency")
    return rows.groupBy("bucket").transformWithStateInPandas(Cards(ttl_ms, every), CARDS, "append", "processingTime" if ttl_ms else "none", initialState=start)


def drained(stream: DataFrame, tag: str) -> DataFrame:
    """Runs ``stream`` over what its source holds now, into a table in the shared folder, and reads that table."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/stream-{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")

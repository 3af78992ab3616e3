"""Streaming forms: candidate cards over telemetry drops, breaker states over call events, dead letters."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from candela.operators.health import Breaker, Config
from candela.operators.telemetry import STAGES, gate

CARD = "candidate_id string, stage string, experiment_state string, status string, potency double, risk_flags array<string>"


def outcomes(records: DataFrame) -> DataFrame:
    """Canonical records with a ``stage`` column as (candidate_id, stage, seq, passed, codes, potency): stateless, in built-in functions."""
    none = F.array().cast("array<string>")
    ok, codes, potency = F.lit(False), none, F.lit(None).cast("double")
    for s in STAGES:
        g = gate(s)
        here = F.col("stage") == s
        ok, codes = F.when(here, g["passed"]).otherwise(ok), F.when(here, g["failure_codes"]).otherwise(codes)
        potency = F.when(here, g["potency"]).otherwise(potency) if "potency" in g else potency
    return records.select("candidate_id", "stage", "seq", ok.alias("passed"), F.when(ok, none).otherwise(codes).alias("codes"), potency.alias("potency"))


def new_card() -> dict:
    return {"experiment_state": "designed", "status": "draft", "potency": None, "risk_flags": []}


def advance(card: dict, r) -> dict:
    """The card after one outcome."""
    third = r.stage == STAGES[2]
    card["experiment_state"] = "measured" if third else "in_flight_assay" if r.passed else "failed"
    card["status"] = "rejected" if not r.passed else "evaluated" if third else card["status"]
    if third:
        card["potency"] = float(r.potency)
    card["risk_flags"] = list(dict.fromkeys([*card["risk_flags"], *r.codes]))
    return card


def in_order(batches, columns: list[str]):
    """A key's rows of one micro-batch in order, however many Arrow batches they come in."""
    parts = list(batches)
    return pd.concat(parts).sort_values(columns).itertuples() if parts else iter(())


def fold_cards(stream: DataFrame) -> DataFrame:
    """``outcomes`` rows folded a candidate in order of seq; a row a record with the card after it. State: the card."""

    def step(key, batches, state: GroupState):
        card = dict(zip(("experiment_state", "status", "potency", "risk_flags"), state.get, strict=True)) if state.exists else new_card()
        card["risk_flags"] = list(card["risk_flags"])
        rows = []
        for r in in_order(batches, ["seq"]):
            card = advance(card, r)
            rows.append((key[0], r.stage, card["experiment_state"], card["status"], card["potency"], list(card["risk_flags"])))
        state.update((card["experiment_state"], card["status"], card["potency"], card["risk_flags"]))
        yield pd.DataFrame(rows, columns=["candidate_id", "stage", "experiment_state", "status", "potency", "risk_flags"])

    return stream.groupBy("candidate_id").applyInPandasWithState(step, CARD, "experiment_state string, status string, potency double, risk_flags array<string>", "append", GroupStateTimeout.NoTimeout)


def without_replays(records: DataFrame, ts_col: str = "ts", late: str = "1 day") -> DataFrame:
    """Records of drops, each once within the watermark even if a file is delivered again."""
    return records.withWatermark(ts_col, late).dropDuplicatesWithinWatermark(["candidate_id", "stage", "seq"])


def fold_calls(stream: DataFrame, config: Config = Config()) -> DataFrame:
    """Calls (agent, seq, at seconds, ok) with the breaker's state after each. State: the breaker."""

    def step(key, batches, state: GroupState):
        breaker = Breaker(config, *state.get) if state.exists else Breaker(config)
        rows = []
        for r in in_order(batches, ["at", "seq"]):
            rows.append((key[0], int(r.seq), *breaker.call(bool(r.ok), float(r.at))))
        state.update(breaker.saved())
        yield pd.DataFrame(rows, columns=["agent", "seq", "state", "blocked"])

    return stream.groupBy("agent").applyInPandasWithState(step, "agent string, seq long, state string, blocked boolean", "state string, since double, wins int, history string", "append", GroupStateTimeout.NoTimeout)


def plate_alerts(stream: DataFrame, ts_col: str = "ts", width: str = "1 hour", most: float = 0.5) -> DataFrame:
    """Failure rate of each plate in tumbling windows, late rows up to a window's width."""
    w = stream.withWatermark(ts_col, width).groupBy(F.window(ts_col, width), "plate")
    return w.agg(F.avg(F.col("failed").cast("double")).alias("failure_rate")).withColumn("alert", F.col("failure_rate") > most)

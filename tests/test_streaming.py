"""The streaming forms give what the batch forms give."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from candela.operators import health, telemetry
from candela.streaming import cards


def _run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_breakers(spark, tmp_shared):
    rnd, at = random.Random(3), dt.datetime(2024, 1, 1)
    rows = [(f"a{rnd.randint(0, 3)}", at + dt.timedelta(seconds=7 * k), k, rnd.random() > 0.4) for k in range(300)]
    d = spark.createDataFrame(rows, "agent string, ts timestamp, seq long, ok boolean")
    for part in range(3):
        d.where((F.col("seq") >= part * 100) & (F.col("seq") < part * 100 + 100)).coalesce(1).write.mode("append").parquet(f"{tmp_shared}/calls")
    batch = {(r.agent, r.seq, r.state, r.blocked) for r in health.states(d).collect()}
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 3).parquet(f"{tmp_shared}/calls").select("agent", "seq", (F.unix_micros("ts") / 1e6).alias("at"), "ok")
    got = _run(spark, cards.fold_calls(stream), "calls")
    assert {(r.agent, r.seq, r.state, r.blocked) for r in got.collect()} == batch and len({s for *_, s, _ in batch}) > 1


def test_cards(spark, tmp_shared):
    rows = []
    for k in range(30):
        rows += [(f"c{k}", telemetry.STAGES[0], 3 * k, {"crude_purity": str(30 + k), "yield": "5"}), (f"c{k}", telemetry.STAGES[1], 3 * k + 1, {"purity": "95", "solubility": str(k / 20)}), (f"c{k}", telemetry.STAGES[2], 3 * k + 2, {"kd": str(10 ** (k % 6))})]
    drop = telemetry.records(spark.createDataFrame(rows, "candidate_id string, stage string, seq long, fields map<string,string>").select("stage", "seq", F.map_concat("fields", F.create_map(F.lit("id"), "candidate_id")).alias("fields")))
    table = spark.createDataFrame([(f"c{k}", "designed", "draft", None, []) for k in range(30)], "candidate_id string, experiment_state string, status string, potency double, risk_flags array<string>")
    for s in telemetry.STAGES:
        table = telemetry.apply_drop(table, drop.where(F.col("stage") == s), s, order_col="seq").drop("log")
    want = {(r.candidate_id, r.experiment_state, r.status, r.potency, tuple(r.risk_flags)) for r in table.collect()}
    for s in telemetry.STAGES:
        cards.outcomes(drop.where(F.col("stage") == s)).coalesce(1).write.mode("append").parquet(f"{tmp_shared}/drops")
    schema = spark.read.parquet(f"{tmp_shared}/drops").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_shared}/drops")
    got = _run(spark, cards.fold_cards(stream), "cards").where(F.col("stage") == telemetry.STAGES[2])
    assert {(r.candidate_id, r.experiment_state, r.status, r.potency, tuple(r.risk_flags)) for r in got.collect()} == want


def test_replays_and_plates(spark, tmp_shared):
    at = dt.datetime(2024, 1, 1)
    d = spark.createDataFrame([("c1", "s", 1, at), ("c1", "s", 1, at), ("c2", "s", 2, at)], "candidate_id string, stage string, seq long, ts timestamp")
    d.write.parquet(f"{tmp_shared}/r")
    assert _run(spark, cards.without_replays(spark.readStream.schema(d.schema).parquet(f"{tmp_shared}/r")), "replays").count() == 2
    p = spark.createDataFrame([(at, "p", True), (at, "p", True), (at, "q", False)], "ts timestamp, plate string, failed boolean")
    p.write.parquet(f"{tmp_shared}/p")
    got = {r.plate: r.alert for r in _run(spark, cards.plate_alerts(spark.readStream.schema(p.schema).parquet(f"{tmp_shared}/p")), "plates", "complete").collect()}
    assert got == {"p": True, "q": False}


def test_order_holds_across_arrow_batches(spark, tmp_shared):
    """A key's rows that come in several Arrow batches, out of order, are folded in order."""
    rnd = random.Random(4)
    rows = [(f"a{k % 2}", float(k), k, rnd.random() > 0.4) for k in range(200)]
    rnd.shuffle(rows)
    d = spark.createDataFrame(rows, "agent string, at double, seq long, ok boolean")
    d.coalesce(1).write.parquet(f"{tmp_shared}/shuffled")
    batch = {(r.agent, r.seq, r.state, r.blocked) for r in health.states(d.withColumn("ts", F.timestamp_micros((F.col("at") * 1e6).cast("long"))).select("agent", "ts", "seq", "ok")).collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        got = _run(spark, cards.fold_calls(spark.readStream.schema(d.schema).parquet(f"{tmp_shared}/shuffled")), "shuffled")
        assert {(r.agent, r.seq, r.state, r.blocked) for r in got.collect()} == batch
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)

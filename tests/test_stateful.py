"""Stateful stream operators against the batch forms: shuffled and late input, timers, initial state, replays."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from candela.operators import health, telemetry
from candela.streaming import cards, stateful

AT = dt.datetime(2024, 1, 1)


def test_breakers_with_late_and_shuffled_calls(spark, tmp_shared):
    rnd = random.Random(3)
    rows = [(f"a{rnd.randint(0, 3)}", AT + dt.timedelta(seconds=7 * k), k, rnd.random() > 0.4) for k in range(300)]
    d = spark.createDataFrame(rows, "agent string, ts timestamp, seq long, ok boolean")
    files = [[] for _ in range(3)]
    for k, r in enumerate(rows):
        files[min(2, k // 100 + (rnd.random() < 0.2))].append(r)  # a fifth comes one file later
    for f in files:
        rnd.shuffle(f)
        spark.createDataFrame(f, d.schema).coalesce(1).write.mode("append").parquet(f"{tmp_shared}/calls")
    spark.createDataFrame([("end", AT + dt.timedelta(days=2), 10**6, True)], d.schema).coalesce(1).write.mode("append").parquet(f"{tmp_shared}/calls")
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_shared}/calls")
    got = stateful.drained(stateful.breaker_events(stream, late="20 minutes"), "test").where("agent <> 'end'").collect()
    batch = health.states(d).collect()
    assert {(r.agent, r.seq, r.state, r.blocked) for r in got if r.kind == "call"} == {(r.agent, r.seq, r.state, r.blocked) for r in batch}
    before, opened = {}, set()
    for r in sorted(batch, key=lambda r: r.seq):  # every opening half-opens after the timeout, whether a call comes or not
        if r.state == "open" and not r.blocked:
            opened.add((r.agent, int(r.ts.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6) + 30_000_000))
        before[r.agent] = r.state
    assert {(r.agent, r.at_us) for r in got if r.kind == "timer"} == opened and len(opened) > 10


def test_cards_start_from_a_table_and_take_no_record_twice(spark, tmp_shared):
    fields = [(f"c{k}", telemetry.STAGES[0], k, {"crude_purity": str(30 + k), "yield": "5"}) for k in range(20)]
    drop = telemetry.records(spark.createDataFrame(fields, "candidate_id string, stage string, seq long, fields map<string,string>").select("stage", "seq", F.map_concat("fields", F.create_map(F.lit("id"), "candidate_id")).alias("fields")))
    table = spark.createDataFrame([(f"c{k}", "designed", "draft", 1.5 if k % 2 else None, ["OLD"] if k % 3 == 0 else []) for k in range(20)], "candidate_id string, experiment_state string, status string, potency double, risk_flags array<string>")
    want = {(r.candidate_id, r.experiment_state, r.status, r.potency, tuple(r.risk_flags)) for r in telemetry.apply_drop(table, drop, telemetry.STAGES[0], order_col="seq").collect()}
    for _ in range(2):  # delivered twice
        cards.outcomes(drop).coalesce(1).write.mode("append").parquet(f"{tmp_shared}/drop")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_shared}/drop").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_shared}/drop")
    got = stateful.drained(stateful.fold_cards(stream, table), "test").collect()
    assert len(got) == 20 and {(r.candidate_id, r.experiment_state, r.status, r.potency, tuple(r.risk_flags)) for r in got} == want


def test_cards_of_a_bucket_equal_a_plain_fold(spark, tmp_shared, monkeypatch):
    """Candidates that share a bucket, all stages mixed, over three files with a replay: each record's card, and the last one a file."""
    monkeypatch.setattr(stateful, "BUCKETS", 2)
    rnd = random.Random(5)
    records = [(f"c{rnd.randint(0, 12)}", rnd.choice(telemetry.STAGES), k, ok := rnd.random() < 0.5, [] if ok else rnd.sample(["A", "B", "C"], rnd.randint(1, 2)), float(k % 7)) for k in range(200)]
    schema = "candidate_id string, stage string, seq long, passed boolean, codes array<string>, potency double"
    for part in (records[:80], records[60:130], records[130:]):
        spark.createDataFrame(rnd.sample(part, len(part)), schema).coalesce(1).write.mode("append").parquet(f"{tmp_shared}/drop")
    table = spark.createDataFrame([("c1", "designed", "draft", 1.5, ["OLD"]), ("c99", "designed", "draft", None, [])], "candidate_id string, experiment_state string, status string, potency double, risk_flags array<string>")
    held = {"c1": {"experiment_state": "designed", "status": "draft", "potency": 1.5, "risk_flags": ["OLD"]}}
    want = set()
    for r in spark.createDataFrame(records, schema).orderBy("seq").collect():
        c = held[r.candidate_id] = cards.advance(held.get(r.candidate_id, cards.new_card()), r)
        want.add((r.candidate_id, r.stage, r.seq, c["experiment_state"], c["status"], c["potency"], tuple(c["risk_flags"])))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_shared}/drop")
    got = [(r.candidate_id, r.stage, r.seq, r.experiment_state, r.status, r.potency, tuple(r.risk_flags)) for r in stateful.drained(stateful.fold_cards(stream(), table), "test").collect()]
    assert len(got) == 200 and set(got) == want
    last = stateful.drained(stateful.fold_cards(stream(), table, every=False), "test").collect()
    assert len(last) <= 39 and {r.seq for r in last} >= {max(r[2] for r in records if r[0] == c) for c in held}
    assert {(r.candidate_id, r.stage, r.seq, r.experiment_state, r.status, r.potency, tuple(r.risk_flags)) for r in last} <= want

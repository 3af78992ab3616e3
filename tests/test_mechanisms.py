"""Doubled paths, contracts counted on the job's own pass, reader modes, two-way sinks and indel pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from candela.operators import contracts, graph, leakage
from candela.sources import datasets, sinks


def test_long_chains_take_few_rounds(spark):
    chain = spark.range(10_000).select(F.col("id").cast("string").alias("source"), (F.col("id") + 1).cast("string").alias("target"))
    got = graph.reachable(chain, spark.createDataFrame([("0",), ("9990",)], "id string")).groupBy("start").count().collect()
    assert {(r.start, r["count"]) for r in got} == {("0", 10_000), ("9990", 10)}
    assert {r.id for r in graph.reachable(chain, spark.createDataFrame([("20",)], "id string"), up=True).collect()} == {str(k) for k in range(20)}
    graph.check_acyclic(chain)


@pytest.mark.parametrize("seed", range(3))
def test_doubling_equals_walking(spark, seed, monkeypatch):
    """Reachability and cycles of random graphs, with cycles, against plain walks."""
    monkeypatch.setattr(graph, "STEPS", 1)
    rnd = random.Random(seed)
    edges = {(rnd.randint(0, 30), rnd.randint(0, 30)) for _ in range(34)}
    edges = {(a, b) for a, b in edges if a != b} | {(k, k + 1) for k in range(40, 52)}
    d = spark.createDataFrame([(str(a), str(b)) for a, b in edges], "source string, target string")
    after = {}
    for a in {x for e in edges for x in e}:
        todo, seen = [a], set()
        while todo:
            for b in [b for x, b in edges if x == todo[-1] and b not in seen] or [todo.pop()]:
                if b not in seen and (todo and (todo[-1], b) in edges):
                    seen.add(b)
                    todo.append(b)
                    break
        after[a] = seen
    starts = [0, 1, 40]
    got = {(r.start, r.id) for r in graph.reachable(d, spark.createDataFrame([(str(s),) for s in starts], "id string")).collect()}
    assert got == {(str(s), str(x)) for s in starts for x in after.get(s, ()) if x != s}
    on = {a for a in after if a in after[a]}
    behind = on | {x for a in on for x in after[a]}
    assert {(r.source, r.target) for r in graph.on_cycles(d).collect()} == {(str(a), str(b)) for a, b in edges if a in behind}


def test_contract_is_counted_on_the_way(spark, tmp_shared):
    d = spark.createDataFrame([(1, 5.0), (2, None), (3, 500.0)], "id int, score double")
    keep = lambda x: x.where("score is not null")
    some = contracts.Expectation("small", F.col("score") < 10, "warning")
    before = spark.sparkContext.statusTracker()
    assert before is not None
    counts = contracts.publish(d, [contracts.present("id")], keep, [some], f"{tmp_shared}/good")
    assert counts == {"id present": 0, "small": 1} and spark.read.parquet(f"{tmp_shared}/good").count() == 2
    with pytest.raises(contracts.ContractBroken, match=r"score within.*\(1 rows\)"):
        contracts.publish(d, [], keep, [contracts.bounded("score")], f"{tmp_shared}/bad")
    assert not datasets.exists(spark, f"{tmp_shared}/bad")


def test_reader_modes(spark, tmp_shared):
    spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "3")], "k string, n string").coalesce(1).write.option("header", True).csv(f"{tmp_shared}/csv")
    rows = {r.k: (r.n, r._corrupt_record) for r in datasets.read_by_schema(spark, f"{tmp_shared}/csv", "k string, n int").collect()}
    assert rows == {"a": (1, None), "b": (None, "b,x"), "c": (3, None)}
    assert {r.k for r in datasets.read_by_schema(spark, f"{tmp_shared}/csv", "k string, n int", "DROPMALFORMED").collect()} == {"a", "c"}
    with pytest.raises(Exception, match=r"(?i)malformed"):
        datasets.read_by_schema(spark, f"{tmp_shared}/csv", "k string, n int", "FAILFAST").collect()


def test_a_batch_delivered_again_replaces_itself(spark, tmp_shared):
    d = spark.createDataFrame([(1, None), (2, "bad"), (3, "")], "id int, error string")
    write = sinks.split_batch(tmp_shared)
    for _ in range(2):
        write(d, 7)
    write(d.where("id = 1"), 8)
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_shared}/good").collect()) == [1, 1, 3] and [r.id for r in spark.read.parquet(f"{tmp_shared}/dead").collect()] == [2]


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.9])
def test_indel_pairs_against_all_pairs(spark, threshold):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("ACDE") for _ in range(rnd.randint(0, 14))) for _ in range(120)]
    texts += [t[1:] for t in texts[:40]] + [t[:-1] + "" for t in texts[20:60]] + [texts[0]] * 3
    rows = [(i, str(i), t, f"s{i % 3}") for i, t in enumerate(texts)]
    d = leakage.distinct_rows(spark.createDataFrame(rows, "row long, id string, sequence string, split string"))
    got = {(r.row, r.other_row): (round(r.similarity, 9), r.n_pairs) for r in leakage.indel_groups(d, threshold).collect()}
    of = {}
    for i, _, t, s in rows:
        of.setdefault(t, []).append((i, s))
    want = {}
    for a in of:
        for b in of:
            if b and len(a) == len(b) + 1:
                sim = max(sum(x == y for x, y in zip(a[k:], b, strict=False)) for k in (0, 1)) / len(a)
                n = sum(s != z for _, s in of[a] for _, z in of[b])
                if sim >= threshold - 1e-12 and n:
                    want[min(of[a])[0], min(of[b])[0]] = (round(sim, 9), n)
    assert got == want and len(want) > 3


def test_grouped_leakage_events_are_linear(spark):
    rows = [(i, f"p{i}", "ACDEFGHIKLMNPQRSTVWY", f"s{i % 2}") for i in range(60)] + [(100, "q", "ACDEFGHIKLMNPQRSTVWW"[:17] + "VWY", "s0")]
    d = spark.createDataFrame(rows, "row long, id string, sequence string, split string")
    counts = {r.code: r.n for r in leakage.leakage_events(d, tags=["s0"], grouped=True).groupBy("code").agg(F.count("*").alias("n")).collect()}
    assert counts["SPLIT_LEAKAGE_EXACT_SEQUENCE"] in (60, 61) and counts["DATASET_SPLIT_TAG_MISMATCH"] == 30

"""Queries over whole texts against brute force: what lies behind letter 30 counts."""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import pytest

from candela import queries as R

HEAD = "ACDEFGHIKL" * 3
TAIL = HEAD + "M" * 60
TEXTS = [HEAD + "WWWW", HEAD + "WWWW", HEAD + "WWWW", TAIL + "CCC", TAIL[:-5] + "PPPPPCCC", HEAD + "B", HEAD + "RRRR", "", TAIL + "CCC", HEAD + "YYYYYYYY"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d


def counts(folder, spark, name):
    return {r.code: r.n for r in R.queries()[name](spark, folder).collect()}


def brute_pairs(least):
    seq = [t.replace("B", "") for t in TEXTS]
    alike = lambda a, b: sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
    return [(b, a) for a, b in combinations(range(len(seq)), 2) if a % 3 != b % 3 and seq[a] and len(seq[a]) == len(seq[b]) and seq[a][:3] == seq[b][:3] and seq[a][-3:] == seq[b][-3:] and alike(seq[a], seq[b]) >= least]


def test_exact_groups(spark, folder):
    rows = {r.first_row: (r.sequence, r.n_rows, r.n_splits) for r in R.queries()["exact_leakage_groups_whole"](spark, folder).collect()}
    assert rows == {0: (TEXTS[0], 3, 3), 3: (TEXTS[3], 2, 2)}


def test_near_groups(spark, folder):
    rows = R.queries()["near_duplicates_whole"](spark, folder).collect()
    equal = [p for p in brute_pairs(0.8) if TEXTS[p[0]] == TEXTS[p[1]]]
    assert [(r.row, r.other_row) for r in rows] == [(4, 3)] and sum(r.n_pairs for r in rows) == len(brute_pairs(0.8)) - len(equal) == 2


def test_preflight(spark, folder):
    got = counts(folder, spark, "preflight_counts_whole")
    exact = [p for p in brute_pairs(1.0)]
    assert got["SPLIT_LEAKAGE_EXACT_SEQUENCE"] == len(exact) == 4 and got["SPLIT_LEAKAGE_NEAR_DUPLICATE"] == len(brute_pairs(0.95))
    assert got["DATASET_SPLIT_TAG_MISMATCH"] == sum(k % 3 == 2 for k in range(len(TEXTS))) and got["DATASET_INVALID_SEQUENCE"] == 1


def test_residues_and_features(spark, folder):
    bad = {r.doc_id for r in R.queries()["residue_validation_whole"](spark, folder).where("not ok").collect()}
    assert 7 in bad
    rows = {r.doc_id: r for r in R.queries()["basic_features_whole"](spark, folder).collect()}
    assert all(rows[k].length == (len(t.replace("B", "")) or None) for k, t in enumerate(TEXTS))
    c = Counter(TEXTS[3])
    assert rows[3].cysteine_count == c["C"]
    contract = counts(folder, spark, "contract_event_counts_whole")
    assert contract["DATASET_INVALID_SEQUENCE"] == 2  # the empty text, and the B behind letter 30


def test_benchmark_passages(spark, tmp_path):
    """A quote from an item's middle at a document's end is found, and an item of fewer than 10 residues."""
    item = HEAD + "WYWYAAGGTTRRSSNNPPQQ" + HEAD
    docs = ["M" * 50 + item[32:46], "M" * 50 + item[32:41], "K" * 40 + "WWWAAA" + "K", "", "M" * 40 + item[35:50] + "V" + item[35:50]]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item), (1, "WWWAAA"), (2, ""), (3, "1234")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = R.queries()["benchmark_leakage_whole"](spark, str(tmp_path)).collect()
    cut = lambda t, w: {t[i : i + w] for i in range(len(t) - w + 1)}
    want = {(d, k): len(cut(t, w) & cut(x, w)) for d, t in enumerate(docs) for k, x, w in ((0, item, 10), (1, "WWWAAA", 6)) if cut(t, w) & cut(x, w)}
    assert {(r.doc_id, r.item_id): r.n_shared for r in rows} == want == {(0, 0): 5, (2, 1): 1, (4, 0): 6}
    assert {r.item_id: r.n_item for r in rows} == {0: len(cut(item, 10)), 1: 1}
    assert {(r.doc_id, r.item_id): r.n_shared for r in R.queries()["benchmark_leakage"](spark, str(tmp_path)).collect()} == want


def test_repairs_parse_a_payload_once(spark):
    """No filter inferred from the explode, which would parse each payload once a field."""
    log = R.queries()["payload_repair_log"](spark, "/root/testdata/sf0.001")
    assert log._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_repaired_rows_of_one_small_file_are_several_tasks(spark):
    from pyspark.sql import functions as F

    from candela.plans import jobs

    outputs = spark.createDataFrame([(k, '{"candidate_id":"c"}', "candidate_card", "c") for k in range(40)], "k long, output string, artifact string, want string").coalesce(1)
    out = jobs.repair_then_evaluate(outputs, expected={"candidate_id": "want"})
    assert len({r.p for r in out.select(F.spark_partition_id().alias("p")).collect()}) > 1 and out.count() == 40


def test_unknown_ends_without_gathered_rows(spark, monkeypatch):
    """Events of a graph come from its stored unknown ends; the edges are neither sorted nor hashed for them. Null ends and ids, and ends
    that many edges share, count as before."""
    from candela.operators import graph, staging

    monkeypatch.setattr(staging, "PART_ROWS", 10)
    nodes = spark.createDataFrame([(f"n{k}",) for k in range(40)] + [(None,)], "id string")
    edges = spark.createDataFrame([("gone", f"n{k}") for k in range(60)] + [("n1", None), (None, "n2"), ("n3", "n4")], "source string, target string")
    got = graph.integrity_events(nodes, edges)
    assert {(r.code, r["count"]) for r in got.groupBy("code").count().collect()} == {("NODE_ID_MISSING", 1), ("EDGE_SOURCE_UNKNOWN", 61), ("EDGE_TARGET_UNKNOWN", 21)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "SortMergeJoin" not in plan and "LeftSemi" in plan


def test_drop_counts_do_not_double_rows(spark):
    plan = R.queries()["telemetry_csv_drop"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "REPARTITION_BY_NUM" in plan


def test_preflight_reads_its_rows_once(spark):
    from candela.operators import governance

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    kinds = "_row_number long, peptide_id string, sequence string, split string"
    rows = spark.createDataFrame([(k, f"p{k}", TEXTS[k], f"s{k % 3}") for k in range(len(TEXTS))], kinds).mapInArrow(counted, kinds)
    got = governance.preflight(rows, {"split_column": "split", "split_required": True, "split_tags": ["s0", "s1"]}, strict=False, max_pairs=None, grouped=True)
    assert got.where("code = 'DATASET_SPLIT_TAG_MISMATCH'").count() == 3 and got.count() > 3 and seen.value == len(TEXTS)

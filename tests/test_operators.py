"""Literal cases of the operators: gates, parsing, repair, content addressing, breakers, contracts, graphs, review."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from candela.functions import design_rules, register, scoring
from candela.functions import sequence as S
from candela.operators import artifacts, contracts, events, governance, graph, health, leakage, payloads, results, review, telemetry
from candela.plans import jobs
from candela.sources import datasets, settings, sinks


def one(spark, **cols):
    return spark.range(1).select(*(v.alias(k) for k, v in cols.items())).first()


def test_stage1_drop(spark, tmp_shared):
    with open(f"{tmp_shared}/drop.csv", "w") as f:
        f.write("Candidate_ID,Crude_Purity,Yield (mg),Observed_Mass,Expected_Mass\n001,68.5,14.2,1850.2,1850.0\n002,28.0,2.1,1850.1,1850.0\n003,72.0,11.0,1720.0,1850.0\n")
    cards = spark.createDataFrame([(c, "in_flight_synthesis", "selected", None, []) for c in ("001", "002", "003", "004")], "candidate_id string, experiment_state string, status string, potency double, risk_flags array<string>")
    out, counts = jobs.telemetry_drop(cards, datasets.telemetry_csv(spark, f"{tmp_shared}/drop.csv"), telemetry.STAGES[0])
    rows = {r.candidate_id: r for r in out.collect()}
    assert counts.first().asDict() == {"passed_count": 1, "failed_count": 2}
    assert rows["001"].experiment_state == "in_flight_assay" and rows["002"].risk_flags == ["SYN_CRUDE_PURITY_LOW"] and rows["003"].risk_flags == ["SYN_WRONG_MASS"]
    assert rows["004"].status == "selected" and rows["004"].log is None


def test_stage2_json_and_stage3(spark):
    text = json.dumps({"records": [{"id": "001", "purified_purity": 96.5, "solubility": 4.5, "agg_index": 0.05, "dls_pdi": 0.08}, {"id": "004", "purified_purity": 94.0, "solubility": 0.1, "agg_index": 0.45, "dls_pdi": 0.38}, 7]})
    drop = telemetry.records(datasets.telemetry_json(spark.createDataFrame([(text,)], "value string")))
    g = telemetry.stage2()
    rows = {r.candidate_id: r.codes for r in drop.select("candidate_id", g["failure_codes"].alias("codes")).collect()}
    assert rows["001"] == [] and rows["004"] == ["SOLUBILITY_LOW", "AGGREGATION_HIGH"]
    single = telemetry.records(datasets.telemetry_json(spark.createDataFrame([('{"id":"a","kd":45,"kon":1.2e5,"koff":5.4e-3,"ic50":60}',), ('[{"id":"b","ic50":60},{"id":"c"},{"id":"d","kd":5,"censored":"YES"}]',)], "value string")))
    g = telemetry.stage3()
    r = {r.candidate_id: r for r in single.select("candidate_id", *(v.alias(k) for k, v in g.items())).collect()}
    assert r["a"].is_binder and r["a"].potency == pytest.approx(73.47) and r["b"].is_binder and not r["b"].passed and r["b"].potency == 0
    assert r["c"].failure_codes == ["ASSAY_NO_ACTIVITY"] and r["d"].failure_codes == ["ASSAY_NON_BINDER"]


def test_order_can_be_enforced(spark):
    cards = spark.createDataFrame([("x", "failed", "rejected", None, ["A"])], "candidate_id string, experiment_state string, status string, potency double, risk_flags array<string>")
    drop = telemetry.records(spark.createDataFrame([(0, {"id": "x", "kd": "1"}), (1, {"id": "x", "kd": "9"})], "ingest_order int, fields map<string,string>"))
    free = telemetry.apply_drop(cards, drop, telemetry.STAGES[2]).first()
    assert free.experiment_state == "measured" and free.potency == pytest.approx(80.46) and free.risk_flags == ["A"]
    assert telemetry.apply_drop(cards, drop, telemetry.STAGES[2], enforce_order=True).first().experiment_state == "failed"


def test_design_rules(spark):
    d = spark.createDataFrame([("AAAADGAA",), ("AAAAFVVVVVAA",), ("KPPPPK",), ("ACAC",), ("ACA",), ("",)], "s string")
    rows = {r.s: r for r in design_rules.screened(d, "s").collect()}
    v = {s: [(x.rule_id, x.severity, x.positions) for x in r.violations] for s, r in rows.items()}
    assert v["AAAADGAA"][0] == ("DRC-001", "fatal", [5, 6]) and not rows["AAAADGAA"].passed_hard_drc
    assert v["AAAAFVVVVVAA"][0] == ("DRC-002", "fatal", [5, 6, 7, 8, 9, 10]) and ("DRC-005", "warning", [2, 3, 4, 5]) in v["KPPPPK"]
    assert any(x[0] == "DRC-004" and x[2] == [2] for x in v["ACA"]) and v[""] == []


def test_similarities(spark):
    r = one(spark, eq=S.identity(F.lit("ACDE"), F.lit("ACDF")), indel=S.identity(F.lit("ACDEF"), F.lit("CDEF")), far=S.identity(F.lit("ACDEFG"), F.lit("ACDE")), none=S.identity(F.lit(""), F.lit("A")), k=S.kmers(F.lit("AC")), j=S.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")), v=S.feature_vector(F.lit(" ")))
    assert (r.eq, r.indel, r.far, r.none, r.k, r.j) == (0.75, 0.8, 0.0, 0.0, ["A", "C"], 1.0) and r.v == [0.0] * 24


def test_sql_functions_and_scores(spark):
    register.register(spark)
    r = spark.sql("SELECT seq_net_charge('KKWW') c, seq_gravy('AV') g, seq_normalised(' a c') n, seq_jaccard(seq_kmers('ACDE', 3), seq_kmers('ACDF', 3)) j").first()
    assert r.g == pytest.approx(3.0) and r.n == "AC" and r.c == pytest.approx(one(spark, c=S.net_charge(F.lit("KKWW"))).c) and r.j == pytest.approx(1 / 3)
    flags, score = scoring.flags_and_score(F.lit("GGGGSSSSNNNN"), F.lit("cyclic"))
    r = one(spark, f=flags, s=score)
    assert r.f == ["VERY_LOW_HYDROPHOBICITY_CHECK_BINDING_PLAUSIBILITY", "DEAMIDATION_LIABILITY", "MODIFICATION_COMPLEXITY_REVIEW"] and r.s == 82
    with pytest.raises(ValueError):
        scoring.priority(F.lit(1), F.lit(1), F.lit(1), F.lit(1), (-1, 0, 0))


DOC = """Result ID: R1
Candidate ID: C1
Result type: assay

## Summary
No antimicrobial activity was seen.

## Key values
| Metric | Value | Notes |
|---|---|---|
| Yield | 12 mg | |
| Solubility (mg/mL) | 0.3 | |
| Purity | n/a | |

## Failure modes
- off_target_signal
- some prose that reads on
"""


def test_result_documents(spark):
    d = spark.createDataFrame([(0, DOC), (1, DOC), (2, "Candidate ID: C"), (3, ""), (4, None)], "seq int, text string")
    good, bad = results.ingest(d, "seq")
    r = good.collect()
    assert len(r) == 1 and r[0].failure_modes == ["OFF_TARGET_SIGNAL", "SYN_LOW_YIELD", "LOW_AQUEOUS_SOLUBILITY", "NO_BINDING"][: len(r[0].failure_modes)] or set(r[0].failure_modes) >= {"OFF_TARGET_SIGNAL", "SYN_LOW_YIELD", "NO_BINDING"}
    assert r[0].unknown_modes == ["SOMEPROSETHATREADSON"] and r[0].key_values["Yield"] == "12 mg"
    errors = {x.seq: x.error for x in bad.collect()}
    assert errors[1].startswith("Duplicate") and "Result ID" in errors[2] and errors[3] == errors[4] == "Result text is empty."


def test_review(spark):
    found = spark.createDataFrame([("r1", "c1", [], 0), ("r2", "c2", ["NO_BINDING"], 1), ("r3", "zz", [], 2)], "result_id string, candidate_id string, failure_modes array<string>, seq long")
    cands = spark.createDataFrame([("c1", "scored"), ("c2", "scored"), ("c3", "scored")], "candidate_id string, status string")
    out = jobs.result_review(cands, found, campaign_id="K", run_id="1", strict=False)
    assert {r.candidate_id: r.status for r in out.candidates.collect()} == {"c1": "advanced", "c2": "rejected", "c3": "scored"}
    d = out.decision.first()
    assert d.decision == "proceed_to_next_round" and d.rationale.startswith("1/2") and d.risks == ["Frequent failure mode: NO_BINDING"]
    assert out.events.count() == 1
    with pytest.raises(events.ValidationFailed):
        jobs.result_review(cands, found, campaign_id="K", run_id="1")
    none = review.campaign_decision(out.reviews.limit(0), "K", "1").first()
    assert none.decision == "pause" and len(none.alternatives_considered) == 2


def test_scoring_round(spark):
    t, h = spark.createDataFrame([("t", "T")], "target_id string, name string"), spark.createDataFrame([("h", "t")], "hypothesis_id string, target_id string")
    rows = [("bad", "ACZ*Z", "t", "h", "linear", [], "draft", 0), ("good", "klmnpqrstvwy", "t", "h", "linear", ["OWN"], "draft", 1), ("bad", "ACDK", "t", "h", "linear", [], "draft", 2)]
    c = spark.createDataFrame(rows, "candidate_id string, sequence string, target_id string, hypothesis_id string, modality string, risk_flags array<string>, status string, seq long")
    r = jobs.scoring_round(t, h, c, run_id="1", strict=False)
    got = r.candidates.collect()
    assert [x.candidate_id for x in got] == ["good"] and got[0].status == "scored" and got[0].risk_flags[0] == "OWN"
    assert {(e.code, e.row_id) for e in r.events.collect()} == {("CANDIDATE_INVALID_SEQUENCE", "bad"), ("CANDIDATE_DUPLICATE_ID", "bad")}
    assert r.nodes.count() == 5 and r.edges.count() == 4
    with pytest.raises(events.ValidationFailed):
        jobs.scoring_round(t, h, c, run_id="1")


def test_dialectic(spark):
    d = spark.createDataFrame([("KWKLFKKIGAVLKVL", None, None), ("AAAADGAA", None, None), ("AKAKAKAK", 0.9, 0.6)], "sequence string, affinity double, liability double")
    got = [r.decision for r in jobs.dialectic_screen(d).collect()]
    assert got[1] == "REJECT" and got[2] == "DISCRIMINATIVE_ASSAY"


def test_repair(spark):
    p = [json.dumps({"confidence": "85.0", "overall_score": 105.0, "affinity_score": -500.0, "sequence": " ack ", "risk_flags": "a, b", "controls": 5, "candidate_id": "x"}), "{broken", "[1]"]
    r = payloads.repaired(spark.createDataFrame([(x,) for x in p], "payload string"), expected={"candidate_id": F.lit("c")}).collect()
    assert (r[0].confidence, r[0].overall_score, r[0].affinity_score, r[0].sequence, r[0].risk_flags, r[0].controls, r[0].candidate_id) == (0.85, 100.0, 0.0, "ACK", ["a", "b"], [], "c")
    assert sum(x.startswith("WARNING") for x in r[0].repairs) == 1 and r[1].sequence is None


def test_content_addressing(spark):
    d = spark.createDataFrame([('{"a":1,"b":[2],"c":"x"}',), ('{"c": "x", "b": [2], "a": 1}',)], "body string")
    new = payloads.put(d, None).collect()
    assert len(new) == 1 and len(new[0].hash) == 64 and new[0].uri == "cas://sha256/" + new[0].hash
    store = payloads.put(d, None)
    assert payloads.put(d, store).count() == 0
    found, missing = payloads.get(spark.createDataFrame([(new[0].uri,), ("cas://sha256/00",), ("http://x",)], "uri string"), store)
    assert found.count() == 1 and missing.count() == 2


def test_breaker(spark):
    at = dt.datetime(2024, 1, 1)
    calls = [(k, ok, s) for k, (ok, s) in enumerate([(False, 0)] * 5 + [(True, 1), (True, 40), (True, 41), (False, 42)])]
    d = spark.createDataFrame([("a", at + dt.timedelta(seconds=s), k, ok) for k, ok, s in calls], "agent string, ts timestamp, seq long, ok boolean")
    rows = sorted(health.states(d, health.Config(window=5)).collect(), key=lambda r: r.seq)
    assert [r.state for r in rows] == ["closed"] * 4 + ["open", "open", "half_open", "closed", "closed"] and [r.blocked for r in rows].index(True) == 5
    assert rows[0].use_fallback and not rows[6].use_fallback


def test_contracts(spark):
    d = spark.createDataFrame([(1, "ACD", 5.0), (2, "A*", None)], "i int, sequence string, score double")
    assert contracts.violations(d, [contracts.valid_sequence(), contracts.bounded("score")], "i").count() == 2
    with pytest.raises(contracts.ContractBroken):
        d.transform(contracts.with_contract([contracts.valid_sequence()], lambda x: x, []))
    assert d.where("i = 1").transform(contracts.with_contract([contracts.valid_sequence()], lambda x: x.withColumn("z", F.lit(1)), [contracts.present("z")])).count() == 1


def test_graph(spark):
    diamond = spark.createDataFrame([("a", "b", "x"), ("a", "c", "x"), ("b", "d", "x"), ("c", "d", "x")], "source string, target string, edge_type string")
    graph.check_acyclic(diamond)
    assert {(r.start, r.id) for r in graph.reachable(diamond, spark.createDataFrame([("a",)], "id string")).collect()} == {("a", "b"), ("a", "c"), ("a", "d")}
    with pytest.raises(graph.CycleFound):
        graph.check_acyclic(diamond.union(spark.createDataFrame([("d", "a", "x")], diamond.schema)))
    nodes = spark.createDataFrame([("a", "k", None), (None, "k", None)], "id string, node_type string, payload string")
    assert graph.integrity_events(nodes, diamond).count() == 1 + 2 + 4


def test_leakage(spark):
    rows = [(2, "a", "ACDEFGHIKLMNPQRSTVWY", "train"), (3, "b", "ACDEFGHIKLMNPQRSTVWY", "test"), (4, "c", "ACDEFGHIKMMNPQRSTVWY", "test"), (5, "d", "", "train"), (6, "e", "", "test"), (7, "f", "ACDEFGHIKMMNPQRSTVWY", "test")]
    d = spark.createDataFrame(rows, "row long, id string, sequence string, split string")
    assert {(r.row, r.prior_row) for r in leakage.exact_pairs(d).collect()} == {(3, 2), (6, 5)}
    assert {(r.row, r.other_row) for r in leakage.near_pairs(d, 0.95).collect()} == {(3, 2), (4, 2), (7, 2)}
    assert {(r.row, r.other_row) for r in leakage.near_pairs_budgeted(d, 0.95, 2).collect()} == {(3, 2), (4, 2)}
    e = leakage.leakage_events(d, threshold=0.95, max_pairs=2, strict=True).collect()
    assert sum(x.code == "SPLIT_LEAKAGE_PAIRWISE_TRUNCATED" for x in e) == 1 and sum(x.code == "SPLIT_LEAKAGE_EXACT_SEQUENCE" for x in e) == 1


def test_manifest_and_preflight(spark, tmp_shared):
    def manifest(text):
        path = f"{tmp_shared}/m.json"
        with open(path, "w") as f:
            f.write(text)
        return datasets.load_manifest(spark, path)

    code = lambda got: [e["code"] for e in got[1]]
    assert code(datasets.load_manifest(spark, f"{tmp_shared}/none.json")) == ["SPLIT_MANIFEST_NOT_FOUND"]
    assert code(manifest("{x")) == ["SPLIT_MANIFEST_PARSE_ERROR"] and code(manifest("[1]")) == ["SPLIT_MANIFEST_INVALID_FORMAT"] and code(manifest("{}")) == ["SPLIT_MANIFEST_MISSING_FIELDS"]
    base = {"dataset_id": "d", "split_method": "m", "split_column": "split"}
    assert code(manifest(json.dumps(base | {"split_tags": "x", "homology_guard": [1]}))) == ["SPLIT_MANIFEST_INVALID_SPLIT_TAGS", "SPLIT_MANIFEST_INVALID_GUARD"]
    m, _ = manifest(json.dumps(base | {"split_tags": ["train", "test"], "own": 1}))
    assert m["extra"] == {"own": 1} and m["split_required"] is True
    with open(f"{tmp_shared}/d.csv", "w") as f:
        f.write("peptide_id,sequence,split\n p1 ,acd,train\np1,ACD,test\np!,AC*,other\np3,ACX,\n")
    rows = datasets.read_dataset(spark, f"{tmp_shared}/d.csv")
    assert [r._row_number for r in rows.orderBy("_row_number").collect()] == [2, 3, 4, 5]
    codes = [e.code for e in governance.preflight(rows, m, strict=False).collect()]
    assert sorted(codes) == sorted(["DATASET_UNLISTED_SPLIT_TAG", "DATASET_DUPLICATE_ID", "DATASET_INVALID_ID", "DATASET_INVALID_SEQUENCE", "DATASET_AMBIGUOUS_RESIDUES", "SPLIT_LEAKAGE_EXACT_SEQUENCE", "SPLIT_LEAKAGE_NEAR_DUPLICATE", "DATASET_SPLIT_TAG_MISMATCH"])
    with pytest.raises(events.ValidationFailed):
        governance.preflight(rows, m)


def test_dataset_rules(spark):
    row = dict.fromkeys(governance.SEED_COLUMNS, "x") | {"sequence": "ACD", "length": "3.0", "linear_or_cyclic": "Linear", "gram_status": "Fungal"}
    seed = spark.createDataFrame([row | {"peptide_id": "a"}, row | {"peptide_id": "a", "length": "4"}]).withColumn("_row_number", F.monotonically_increasing_id() + 2)
    bad = dict.fromkeys(governance.LIABILITY_COLUMNS, "x") | {"peptide_id": "b", "sequence": "AC*", "severity": "huge", "liability_bucket": "liability"}
    lia = spark.createDataFrame([bad]).withColumn("_row_number", F.lit(2))
    e, counts = jobs.dataset_validation(seed, lia)
    assert {x.code for x in e.collect()} == {"SEED_DUPLICATE_ID", "SEED_LENGTH_MISMATCH", "LIABILITY_ID_UNKNOWN", "LIABILITY_SEQUENCE", "LIABILITY_SEVERITY"}
    assert counts.first().asDict() == {"rows": 2, "unique_peptides": 1}


def test_artifact_files_and_sinks(spark, tmp_shared):
    good = {"candidate_id": "c1", "sequence": "ACD", "target_id": "t", "hypothesis_id": "h", "modality": "linear", "status": "archived"}
    for name, text in {"a.json": json.dumps([good, good | {"candidate_id": "c2", "status": 5}]), "b.jsonl": json.dumps(good) + "\n{x\n", "c.json": ""}.items():
        with open(f"{tmp_shared}/{name}", "w") as f:
            f.write(text)
    v, counts = jobs.artifact_batch(spark, tmp_shared)
    assert sorted((r.valid, r.error) for r in v.select("valid", F.coalesce("error", F.lit("")).alias("error")).collect()) == [(False, ""), (False, "file is empty"), (False, "invalid JSON"), (True, ""), (True, "")]
    cands = datasets.candidate_records(spark, tmp_shared, reset_status=True)
    assert {r.candidate_id: r.status for r in cands.collect()} == {"c1": "scored", "c2": "scored"}
    named = sinks.with_file_names(v.where("valid").withColumn("i", F.monotonically_increasing_id()), "artifact_id", "i")
    assert named.select("file_name").distinct().count() == 2
    sinks.write_bundle(v.where("valid"), f"{tmp_shared}/bundle")
    assert sinks.read_bundle(spark, f"{tmp_shared}/bundle", ["candidate"]).count() == 2
    sinks.append_log(v.select("artifact_id"), f"{tmp_shared}/log")
    sinks.append_log(v.select("artifact_id"), f"{tmp_shared}/log")
    assert spark.read.json(f"{tmp_shared}/log").count() == 10
    text = cands.select(sinks.card({"Sequence": F.col("sequence"), "None": F.lit(None)}, F.col("candidate_id")).alias("t")).first().t
    assert "- Sequence: ACD" in text and "None" not in text


def test_packets(spark):
    t, c = spark.createDataFrame([("t", "T")], "target_id string, name string"), spark.createDataFrame([("a", "AC"), ("b", "AD")], "candidate_id string, sequence string")
    m = artifacts.packet_manifest(artifacts.packets(t, c, "r")).first()
    assert m.packet_count == 7 and len(m.agents) == 4


def test_graph_source_and_settings(spark):
    n, e = datasets.graph(spark.createDataFrame([('{"nodes":[{"id":"a","node_type":"k","payload":{"x":1}}],"edges":[{"source":"a","target":"b","edge_type":"t"}]}',)], "payload string"))
    assert n.first().id == "a" and e.first().target == "b"
    s = settings.parse("weights:\n  length: 0.2  # share\n  charge: 0.5\nkinds:\n  - a\n  - b\nname: 'x'\non: true\n")
    assert s == {"weights": {"length": 0.2, "charge": 0.5}, "kinds": ["a", "b"], "name": "x", "on": True}


def test_counted_verdicts_equal_the_findings(spark):
    """The fast verdicts are those of the full findings, to the last bit of charge and hydropathy."""
    import random

    from candela.functions import design_rules

    rnd = random.Random(9)
    rows = ["", None, "D", "G", "DG", " dg ", "PPP", "PP", "PPPP" * 2, "VILFYW", "VILF", "CCC", "é漢DGéPPP", "DGDSDNDDG"] + ["".join(rnd.choice("ACDGNSPVILFYWKREHX") for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    d = spark.createDataFrame(list(enumerate(rows)), "i int, sequence string").repartition(3)
    fast = {r.i: r for r in design_rules.counted(d).collect()}
    for r in design_rules.screened(d.where("sequence is not null")).collect():
        n = {level: sum(v.severity == level for v in r.violations) for level in ("fatal", "high_risk", "warning")}
        f = fast[r.i]
        assert (f.n_fatal, f.n_high_risk, f.n_warning, f.passed_hard_drc, f.net_charge_ph74, f.gravy_index) == (n["fatal"], n["high_risk"], n["warning"], r.passed_hard_drc, r.net_charge_ph74, r.gravy_index), r.sequence
    assert len(fast) == len(rows) and fast[1].n_fatal == 0


def test_failure_rules_literally(spark):
    """What a narrative of each rule's words gives, written out."""
    from candela.operators import results

    cases = [
        ("There was no measurable activity.", ["NO_BINDING"]), ("Weak activity and OFF-TARGET effects", ["WEAK_BINDING", "OFF_TARGET_SIGNAL"]), ("buffer failed", []), ("Buffer incompatibility", ["BUFFER_INCOMPATIBILITY"]), ("the failed condition was a buffer", ["BUFFER_INCOMPATIBILITY"]),
        ("aggregated product seen", ["AGGREGATED_PRODUCT", "AGGREGATION"]), ("aggregates", ["AGGREGATED_PRODUCT", "AGGREGATION"]), ("high background interference", ["ASSAY_INTERFERENCE"]), ("no controls; bad controls", ["MISSING_REPRODUCIBILITY_CONTEXT", "INSUFFICIENT_CONTROLS"]), ("control was missing", ["INSUFFICIENT_CONTROLS"]),
        ("hydrophobicity and cyclization", ["SYN_HYDROPHOBIC_SEQUENCE", "SYN_CYCLISATION_FAILED"]), ("freeze thaw, freeze-thaw", ["FREEZE_THAW_INSTABILITY"]), ("co-eluting", ["COELUTING_IMPURITIES"]), ("protease", ["PROTEASE_LABILE"]), ("all good", []), ("", []), (None, []),
        ("no bindingno functional effect", ["NO_BINDING", "NO_FUNCTIONAL_EFFECT"]),
    ]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.m for r in d.select("i", results.classify(F.col("t")).alias("m")).collect()}
    assert [got[i] for i in range(len(cases))] == [m for _, m in cases]
    values = F.create_map(F.lit("Crude yield"), F.lit("12 mg"), F.lit("purity"), F.lit("95 %"), F.lit("Solubility"), F.lit("0.4"))
    row = spark.range(1).select(results.classify(F.lit("protease"), values, F.array(F.lit("no-binding"), F.lit("odd"))).alias("m")).first()
    assert row.m == ["NO_BINDING", "SYN_LOW_YIELD", "LOW_AQUEOUS_SOLUBILITY", "PROTEASE_LABILE"]

"""Plans, reports and composed jobs, and parts of operators that other subjects do not reach."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from candela.operators import governance, graph, payloads, summaries, telemetry
from candela.operators.selection import dpp, surrogate
from candela.operators.staging import shared_folder
from candela.plans import jobs as J
from candela.queries import laboratory, records, selection
from candela.queries.tables import seq_hash, table
from candela.sources import sinks


def selection_plan(spark, sf_dir):
    """The plan of the next batch as graph rows by kind, with the size of its batch and its backups."""
    p = J.selection_plan(seq_hash(spark, sf_dir).select(F.col("doc_id").alias("candidate_id"), "sequence"), campaign_id="C", run_id="R1", batch_size=3)
    kinds = p.nodes.groupBy(F.col("node_type").alias("kind")).agg(F.count("*").alias("n")).unionByName(p.edges.groupBy(F.col("edge_type").alias("kind")).agg(F.count("*").alias("n")))
    sizes = p.batch.agg(F.count("*").alias("n")).select(F.lit("batch").alias("kind"), "n").unionByName(p.backups.agg(F.count("*").alias("n")).select(F.lit("backups").alias("kind"), "n"))
    return kinds.unionByName(sizes).unionByName(p.plan.select(F.lit("selected").alias("kind"), F.size("selected_candidate_ids").cast("long").alias("n")))


def campaign_report(spark, sf_dir):
    """The campaign's report as lines of text."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("candidate_id"), F.lit("scored").alias("status"))
    return J.campaign_report(J.result_review(c, laboratory._results(spark, sf_dir), campaign_id=laboratory.CAMPAIGN, run_id=laboratory.RUN, strict=False)).where("line < 10000")


def artifact_batch(spark, sf_dir):
    """customers as JSON files of two kinds, some incomplete, validated as one job and exported; what the bundle then holds."""
    path, c = f"{shared_folder(spark)}/batch-{uuid.uuid4().hex}", table(spark, sf_dir, "customer")
    ident = F.col("c_custkey").cast("string")
    body = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit('{"decision_id":"'), ident, F.lit('","campaign_id":"c","decision":"pause"'), F.when(F.col("c_custkey") % 3 == 0, "}").otherwise(',"rationale":"r"}'))).otherwise(F.concat(F.lit('{"target_id":"'), ident, F.lit('","name":"n","organism":"o","use_case":"u","rationale":"r"}')))
    c.select(body.alias("value")).write.text(f"{path}/in")
    J.artifact_batch(spark, f"{path}/in", out=f"{path}/out", pattern="*.txt")
    return sinks.read_bundle(spark, f"{path}/out").groupBy("artifact_type").agg(F.count("*").alias("n"))


def cas_get(spark, sf_dir):
    """References to objects: found with their bodies, or missing, or of another scheme."""
    c = table(spark, sf_dir, "customer")
    body = lambda k: F.concat(F.lit('{"k":'), k.cast("string"), F.lit("}"))
    store = payloads.put(c.where("c_custkey % 3 <> 0").select(body(F.col("c_custkey")).alias("body")), None)
    uri = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("file:///"), "c_custkey")).otherwise(F.concat(F.lit("cas://sha256/"), F.sha2(body(F.col("c_custkey")), 256)))
    found, missing = payloads.get(c.select("c_custkey", uri.alias("uri")), store)
    return found.select("c_custkey", F.col("body")).unionByName(missing.select("c_custkey", F.lit(None).cast("string").alias("body")))


def selected_subset(spark, sf_dir):
    """Summaries that name selected candidates, some of them not offered."""
    d = table(spark, sf_dir, "customer").withColumn("output", F.concat(F.lit('{"campaign_id":"c","run_id":"r","summary":"s","recommendation":"x","selected_candidate_ids":["c'), "c_custkey", F.lit('"]}')))
    d = d.select("c_custkey", "output", F.lit("active_learning_scoring_summary").alias("artifact"), F.array(F.concat(F.lit("c"), (F.col("c_custkey") - F.col("c_custkey") % 4).cast("string"))).alias("offered"))
    e = payloads.evaluated(d, allowed_ids=F.col("offered"))
    return e.select("c_custkey", F.array_contains("failure_codes", "CONTEXT_ID_MISMATCH").alias("mismatch"))


def repair_then_evaluate(spark, sf_dir):
    """Candidate cards whose flags are text and whose ids are wrong: failing before repair, passing after it."""
    m = F.col("c_custkey") % 4
    body = F.concat(F.lit('{"candidate_id":"'), F.when(m == 1, "wrong").otherwise(F.concat(F.lit("c"), "c_custkey")), F.lit('","target_id":"t","hypothesis_id":"h","modality":"linear","sequence":"ack","note":"kept",'), F.when(m == 2, '"risk_flags":"A, B"').otherwise('"risk_flags":["A"]'), F.lit("}"))
    d = table(spark, sf_dir, "customer").select("c_custkey", F.when(m == 3, "broken").otherwise(body).alias("output"), F.lit("candidate_card").alias("artifact"), F.concat(F.lit("c"), "c_custkey").alias("want"))
    e = J.repair_then_evaluate(d, expected={"candidate_id": "want"})
    return e.select("c_custkey", F.array_join("codes_before", ";").alias("codes_before"), F.array_join("failure_codes", ";").alias("codes_after"), "passed", F.get_json_object("repaired", "$.sequence").alias("sequence"), F.get_json_object("repaired", "$.note").alias("note"))


def top_acquisition(spark, sf_dir):
    """The five vectors of the highest upper confidence bound where two are measured."""
    v = selection._vectors(spark, sf_dir).select("vec_id", F.transform("x", lambda e: e / 4).alias("x"), (F.col("quality") / 100).alias("y"))
    return surrogate.propose(v.select("vec_id", "x"), v.where("vec_id < 2").select("x", "y"), batch_size=5, use_dpp=False, id_col="vec_id", kind="UCB", seed=1).select("vec_id", F.round("acquisition", 6).alias("acquisition"))


def batch_distance(spark, sf_dir):
    """Mean distance between the vectors of a diverse batch."""
    _, far = dpp.greedy_map(selection._vectors(spark, sf_dir), 3, order_col="vec_id", vector_col="x", quality_col="quality", temperature=10.0, gamma=selection.GAMMA)
    return spark.createDataFrame([(round(far, 5),)], "mean_distance double")


def graph_size(spark, sf_dir):
    e = records._edges(spark, sf_dir)
    return graph.size(e.select(F.col("source").alias("id")).union(e.select("target")).distinct(), e)


def length_tolerance(spark, sf_dir):
    """The first gate with a tolerance that grows with the row's length."""
    d = laboratory._drop(spark, sf_dir).withColumn("tolerance", F.lit(0.5) + (F.col("ingest_order") % 10) * 0.5)
    return d.select("candidate_id", "ingest_order", "plate", "mass_observed_da", telemetry.stage1(F.col("tolerance"))["is_mass_matched"].alias("is_mass_matched"))


def feasibility_weights(spark, sf_dir):
    """Acquisition weighted by feasibility, which is clipped and counts 1 where unknown."""
    li = table(spark, sf_dir, "lineitem")
    f = F.when(F.col("l_linenumber") != 4, F.col("l_discount") * 20 - 0.3)
    return li.select("l_orderkey", "l_linenumber", "l_suppkey", F.round(summaries.feasible(F.col("l_quantity").cast("double"), f), 6).alias("weighted"))


def liability_rules(spark, sf_dir):
    """The liability dataset's rules over parts, of which the seed dataset knows some."""
    k, p = F.col("p_partkey"), table(spark, sf_dir, "part")
    rows = p.select(
        k.alias("_row_number"), F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("p"), k)).alias("peptide_id"), F.when(k % 5 == 0, "").otherwise("n").alias("name"), F.when(k % 6 == 0, "").when(k % 6 == 1, "odd bucket").otherwise("").alias("liability_bucket"), F.when(k % 7 == 0, " ").otherwise("t").alias("liability_type"),
        F.when(k % 8 == 0, "ACX").when(k % 8 == 1, "").otherwise("ACK").alias("sequence"), F.when(k % 9 == 0, "odd severity").otherwise("high").alias("severity"), F.lit("m").alias("metric"), F.when(k % 10 == 0, "").otherwise("r").alias("reference"),
    )
    seed = p.where("p_partkey % 4 = 0").select(F.concat(F.lit("p"), k).alias("peptide_id"))
    return governance.liability_rules(rows, seed).groupBy("severity", "code").agg(F.count("*").alias("n"))


_UCB = f"""(WITH v AS (SELECT vec_id, list_transform(x, lambda e: e / 4) AS x, s / 100 AS y FROM {selection._V} AS t), a AS (SELECT * FROM v WHERE vec_id = 0), b AS (SELECT * FROM v WHERE vec_id = 1),
  k AS (SELECT v.vec_id, exp(-0.5::DOUBLE * pow(list_distance(v.x, a.x), 2)) AS p, exp(-0.5::DOUBLE * pow(list_distance(v.x, b.x), 2)) AS q, exp(-0.5::DOUBLE * pow(list_distance(a.x, b.x), 2)) AS c, 1 + 1.01e-4::DOUBLE AS d, a.y AS ya, b.y AS yb FROM v, a, b)
  SELECT vec_id, (p * (d * ya - c * yb) + q * (d * yb - c * ya)) / (d * d - c * c) + 2 * sqrt(greatest(1e-10, 1 - (d * p * p - 2 * c * p * q + d * q * q) / (d * d - c * c))) AS u FROM k)"""
_K = "p_partkey"

QUERIES = {f.__name__: f for f in (selection_plan, campaign_report, artifact_batch, cas_get, selected_subset, repair_then_evaluate, top_acquisition, batch_distance, graph_size, length_tolerance, feasibility_weights, liability_rules)}
SQL = {
    "selection_plan": "SELECT unnest(['peptide_candidate', 'active_learning_rank', 'ranked_by', 'informs']) AS kind, count(*) AS n FROM documents UNION ALL SELECT unnest(['active_learning_plan', 'prompt_packet', 'requests_summary']), 1 UNION ALL SELECT unnest(['batch', 'selected']), least(3, count(*)) FROM documents UNION ALL SELECT 'backups', count(*) - 3 FROM documents",
    "campaign_report": f"""WITH d AS ({laboratory.SQL["campaign_decision"]}), s AS (SELECT step, row_number() OVER (ORDER BY n DESC, f) AS k FROM {laboratory._STEPS} AS s)
      SELECT line, value FROM (SELECT unnest([0, 1, 2, 3, 4, 5]) AS line, unnest(['# Campaign {laboratory.CAMPAIGN}', '', 'Decision: ' || decision, 'Rationale: ' || rationale, '', '## Next round']) AS value FROM d
      UNION ALL SELECT 99 + row_number() OVER (ORDER BY bucket), '- ' || bucket || ': ' || n FROM ({laboratory.SQL["next_round_buckets"]}) AS b UNION ALL SELECT 1000, '## Steps' UNION ALL SELECT 1000 + k, '- ' || step FROM s WHERE k <= 3)""",
    "artifact_batch": "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'decision_record' ELSE 'target' END AS artifact_type, count(*) AS n FROM customer WHERE c_custkey % 6 <> 0 GROUP BY 1",
    "cas_get": """SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 3 <> 0 THEN '{"k":' || c_custkey || '}' END AS body FROM customer""",
    "selected_subset": "SELECT c_custkey, c_custkey % 4 <> 0 AS mismatch FROM customer",
    "repair_then_evaluate": """SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN 'CONTEXT_ID_MISMATCH' WHEN 2 THEN 'SCHEMA_VALIDATION_FAILED' WHEN 3 THEN 'NON_JSON_OUTPUT' ELSE '' END AS codes_before, CASE c_custkey % 4 WHEN 3 THEN 'NON_JSON_OUTPUT' ELSE '' END AS codes_after, c_custkey % 4 <> 3 AS passed,
      CASE WHEN c_custkey % 4 <> 3 THEN 'ACK' END AS sequence, CASE WHEN c_custkey % 4 <> 3 THEN 'kept' END AS note FROM customer""",
    "top_acquisition": f"SELECT vec_id, round(u, 6) AS acquisition FROM {_UCB} AS t ORDER BY u DESC, vec_id LIMIT 5",
    "batch_distance": f"WITH p AS (SELECT s.step, v.x FROM ({selection.SQL['dpp_batch']}) AS s JOIN {selection._V} AS v ON v.vec_id = s.vec_id) SELECT round(avg(list_distance(a.x, b.x)), 5) AS mean_distance FROM p AS a JOIN p AS b ON a.step < b.step",
    "graph_size": f"SELECT (SELECT count(*) FROM (SELECT s FROM {records._EDGES} AS e UNION SELECT t FROM {records._EDGES} AS e)) AS node_count, count(*) AS edge_count FROM {records._EDGES} AS e",
    "length_tolerance": f"SELECT candidate_id, ingest_order, plate, mass_observed_da, {laboratory._ERR} <= 0.5::DOUBLE + (ingest_order % 10) * 0.5::DOUBLE OR {laboratory._ERR} / greatest(1.0, coalesce(expected, mass_observed_da)) < 0.0005 AS is_mass_matched FROM {laboratory._DROP} AS d",
    "feasibility_weights": "SELECT l_orderkey, l_linenumber, l_suppkey, round(l_quantity::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN l_linenumber <> 4 THEN l_discount * 20 - 0.3::DOUBLE ELSE 1.0::DOUBLE END)), 6) AS weighted FROM lineitem",
    "liability_rules": f"""SELECT severity, code, count(*) AS n FROM (SELECT {_K}, unnest([
        CASE WHEN {_K} % 11 = 0 THEN 'warning LIABILITY_ID_EMPTY' END, CASE WHEN {_K} % 11 <> 0 AND {_K} % 4 <> 0 THEN 'warning LIABILITY_ID_UNKNOWN' END, CASE WHEN {_K} % 5 = 0 THEN 'warning LIABILITY_NAME_EMPTY' END, CASE WHEN {_K} % 6 = 1 THEN 'warning LIABILITY_BUCKET' ELSE 'warning LIABILITY_BUCKET_MISSING' END,
        CASE WHEN {_K} % 7 = 0 THEN 'warning LIABILITY_TYPE_EMPTY' END, CASE WHEN {_K} % 8 < 2 THEN 'error LIABILITY_SEQUENCE' END, CASE WHEN {_K} % 9 = 0 THEN 'error LIABILITY_SEVERITY' END, CASE WHEN {_K} % 10 = 0 THEN 'warning LIABILITY_REFERENCE_EMPTY' END]) AS x FROM part), (SELECT 1), LATERAL (SELECT split_part(x, ' ', 1) AS severity, split_part(x, ' ', 2) AS code) WHERE x IS NOT NULL GROUP BY severity, code""",
}

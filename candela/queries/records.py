"""Payload repair and contracts, content addressing, change sets, graphs, artifacts and packets."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.operators import artifacts as A
from candela.operators import contracts as X
from candela.operators import graph as R
from candela.operators import payloads as P
from candela.operators.staging import dealt, spread, staged
from candela.queries.tables import SEQ_HASH, seq_hash, table


def _payloads(spark, sf_dir):
    """events as JSON payloads with scores out of bounds, numbers as text, lower-case sequences and lists as text."""
    e = spread(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props")).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    score = F.when(F.col("k") % 3 == 0, F.format_string('"%d.5"', F.col("k") * 3)).when(F.col("k") % 3 == 1, F.format_string("%d", 40 - F.col("k") * 2)).otherwise(F.lit('"n/a"'))
    return e.select("event_id", "k", F.concat(F.lit('{"candidate_id":"c'), "user_id", F.lit('","sequence":" ack'), F.lower("event_type"), F.lit(' ","overall_score":'), score, F.lit(',"confidence":'), F.format_string("%d", "k"), F.lit(',"risk_flags":"A, B,,'), "k", F.lit('"}')).alias("payload"))


def payload_repair(spark, sf_dir):
    d = P.repaired(_payloads(spark, sf_dir), expected={"candidate_id": F.when(F.col("k") % 10 == 0, "c0")})
    return d.select("event_id", "candidate_id", "sequence", "overall_score", "confidence", F.array_join("risk_flags", ";").alias("risk_flags"), F.array_join("invalid_fields", ";").alias("invalid_fields"), "requires_repair")


def payload_repair_log(spark, sf_dir):
    """What repairs were made. An outer explode: a plain one has the optimizer ask first whether ``repairs`` is empty, which parses each payload once a field."""
    d = P.repaired(_payloads(spark, sf_dir))
    return d.select(F.explode_outer("repairs").alias("repair")).where("repair is not null").groupBy(F.regexp_replace("repair", r"-?[0-9.]+", "#").alias("repair")).agg(F.count("*").alias("n"))


def output_contract(spark, sf_dir):
    """labels as outputs of five kinds, some empty, broken, of another id or incomplete."""
    d = table(spark, sf_dir, "labels")
    m = F.col("doc_id") % 9
    body = F.concat(F.lit('{"candidate_id":"c'), "doc_id", F.lit('","target_id":"t","hypothesis_id":"h","modality":"linear"'), F.when(m == 3, "").otherwise(F.lit(',"sequence":"ACK"')), F.when(m == 4, ',"risk_flags":"x"').when(m == 5, ',"risk_flags":["x"]').otherwise(""), F.lit("}"))
    d = d.select("doc_id", F.when(m == 0, " ").when(m == 1, "not json").when(m == 2, "[1]").otherwise(body).alias("output"), F.when(m == 6, "unheard_of").otherwise("candidate_card").alias("artifact"), (F.col("doc_id") % 4 + 1).alias("attempt"), F.when(m == 7, "c-1").otherwise(F.concat(F.lit("c"), "doc_id")).alias("want"))
    e = P.evaluated(d, expected={"candidate_id": F.col("want")}, attempt=F.col("attempt"))
    return e.select("doc_id", F.array_join("failure_codes", ";").alias("failure_codes"), F.size("warnings").alias("n_warnings"), "passed", "retry_recommended")


def cas_put(spark, sf_dir):
    """nation objects not yet in a store that holds some of them; the hash is taken of canonical JSON."""
    n = table(spark, sf_dir, "nation").where("n_nationkey >= 0")
    body = F.concat(F.lit('{"region": '), F.col("n_regionkey").cast("string"), F.lit(', "name":"'), "n_name", F.lit('"}'))
    objects = n.select(body.alias("body")).union(n.select(body.alias("body")))
    store = P.put(n.where("n_nationkey < 5").select(body.alias("body")), None)
    return P.put(objects, store)


def _snapshots(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.select(F.col("c_custkey").alias("doc_id"), F.map_filter(F.create_map(F.lit("seg"), "c_mktsegment", F.lit("nat"), F.col("c_nationkey").cast("string"), F.lit("old"), F.lit("1")), lambda k, _: (k != "old") | (F.col("c_custkey") % 3 == 0)).alias("fields"))
    new = c.select(F.col("c_custkey").alias("doc_id"), F.map_filter(F.create_map(F.lit("seg"), F.when(F.col("c_custkey") % 4 == 0, "NEW").otherwise(F.col("c_mktsegment")), F.lit("nat"), F.col("c_nationkey").cast("string"), F.lit("add"), F.lit("2")), lambda k, _: (k != "add") | (F.col("c_custkey") % 5 == 0)).alias("fields"))
    return old, new


def snapshot_diff(spark, sf_dir):
    return P.changes(*_snapshots(spark, sf_dir))


def patch_roundtrip(spark, sf_dir):
    """The old snapshots after the change sets, which must be the new ones."""
    old, new = _snapshots(spark, sf_dir)
    ops = P.changes(old, new).withColumn("pos", F.lit(0))
    out = P.applied(old, ops)
    return out.select("doc_id", F.array_join(F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("fields"))


def _edges(spark, sf_dir):
    n, c, o = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    return (
        n.select(F.concat(F.lit("r"), "n_regionkey").alias("source"), F.concat(F.lit("n"), "n_nationkey").alias("target"))
        .union(c.select(F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("c"), "c_custkey")))
        .union(o.select(F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("o"), "o_orderkey")))
    )


def graph_descendants(spark, sf_dir):
    starts = spark.createDataFrame([("r1",), ("n7",)], "id string")
    return R.reachable(_edges(spark, sf_dir), starts).groupBy("start", F.left("id", F.lit(1)).alias("kind")).agg(F.count("*").alias("n"))


def graph_ancestors(spark, sf_dir):
    starts = table(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select(F.concat(F.lit("o"), "o_orderkey").alias("id"))
    return R.reachable(_edges(spark, sf_dir), starts, up=True)


def graph_cycle_check(spark, sf_dir):
    """Edges on or behind cycles once two orders point back to their nation."""
    back = table(spark, sf_dir, "orders").where("o_orderkey in (1, 2, 3)").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lit("o"), "o_orderkey").alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("target"))
    left = R.on_cycles(_edges(spark, sf_dir).union(back))
    return left.groupBy(F.left("source", F.lit(1)).alias("kind")).agg(F.count_distinct("source").alias("n"))


def graph_integrity(spark, sf_dir):
    e = _edges(spark, sf_dir)
    ids = staged(dealt(e.select(F.col("source").alias("id")).union(e.select("target")), "id", 2 * e.count()).distinct(), "ids")
    nodes = ids.where("id not in ('n3', 'r2')").withColumn("node_type", F.left("id", F.lit(1))).withColumn("payload", F.lit(None).cast("string"))
    return R.integrity_events(nodes, e).groupBy("severity", "code").agg(F.count("*").alias("n"))


def graph_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("node_type"))
    new = c.where("c_custkey % 3 = 0").select(F.concat(F.lit("c"), F.col("c_custkey") + 100).alias("id"), F.lit("moved").alias("node_type"), F.col("c_custkey").alias("seq"))
    return R.merge(old, new, ["id"]).groupBy("node_type").agg(F.count("*").alias("n"))


def artifact_validation(spark, sf_dir):
    """customers as artifacts of several kinds, some without a field, some unreadable."""
    c, m = table(spark, sf_dir, "customer"), F.col("c_custkey") % 8
    ident = F.col("c_custkey").cast("string")
    body = (
        F.when(m == 0, F.concat(F.lit('{"candidate_id":"'), ident, F.lit('","sequence":"ACK","target_id":"t","hypothesis_id":"h","modality":"linear"}')))
        .when(m == 1, F.concat(F.lit('{"candidate_id":"'), ident, F.lit('","sequence":"ACK","target_id":"t","hypothesis_id":"h"}')))
        .when(m == 2, F.concat(F.lit('{"hypothesis_id":"'), ident, F.lit('","target_id":"t","claim":"x","rejection_criteria":[]}')))
        .when(m == 3, F.concat(F.lit('{"target_id":"'), ident, F.lit('","use_case":"u","rationale":"r"}')))
        .when(m == 4, F.concat(F.lit('{"result_id":"'), ident, F.lit('","candidate_id":"c","result_type":"assay","summary":"s","interpretation":"i"}')))
        .when(m == 5, F.concat(F.lit('{"decision_id":"'), ident, F.lit('","campaign_id":"c","decision":"pause","rationale":"r"}')))
        .when(m == 6, F.concat(F.lit('{"other":"'), ident, F.lit('"}'))).otherwise("{broken")
    )
    d = c.select("c_custkey", body.alias("payload"))
    ref, strict = A.validated(d), A.validated(d, mode="schema")
    return ref.select("c_custkey", "artifact_type", "artifact_id", "valid").join(strict.select("c_custkey", F.col("valid").alias("valid_by_schema")), "c_custkey")


def artifact_counts(spark, sf_dir):
    d = table(spark, sf_dir, "customer").select(F.concat(F.lit('{"decision_id":"'), "c_custkey", F.lit('","campaign_id":"c","decision":"pause"'), F.when(F.col("c_custkey") % 2 == 0, ',"rationale":"r"}').otherwise("}")).alias("payload"))
    return A.counts(A.validated(d))


def prompt_packets(spark, sf_dir):
    c = seq_hash(spark, sf_dir).select(F.concat(F.lit("c"), "doc_id").alias("candidate_id"), "sequence")
    t = table(spark, sf_dir, "region").where("r_regionkey = 1").select(F.concat(F.lit("t"), "r_regionkey").alias("target_id"), F.col("r_name").alias("name"))
    return A.packets(t, c, "R1").groupBy("agent", "artifact").agg(F.count("*").alias("n"), F.count_distinct("packet_id").alias("n_ids"))


def contract_violations(spark, sf_dir):
    d = seq_hash(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    v = X.violations(d, [X.valid_sequence(most=20), X.present("quality"), X.bounded("toxic", 0, 0)], "doc_id")
    return v.groupBy("severity", "message").agg(F.count("*").alias("n"))


_K = "CAST(json_extract_string(props, '$.k') AS INT)"
_RAW = f"CASE WHEN {_K} % 3 = 0 THEN {_K} * 3 + 0.5 WHEN {_K} % 3 = 1 THEN 40 - {_K} * 2 END"
_CLAMP = f"CASE WHEN {_RAW} < 0 THEN 0 WHEN {_RAW} > 100 THEN 100 ELSE {_RAW} END::DOUBLE"
_EDGES = "(SELECT 'r' || n_regionkey AS s, 'n' || n_nationkey AS t FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"
_BODY = "'{\"name\":\"' || n_name || '\",\"region\":' || n_regionkey || '}'"
_M = "doc_id % 9"

QUERIES = {f.__name__: f for f in (payload_repair, payload_repair_log, output_contract, cas_put, snapshot_diff, patch_roundtrip, graph_descendants, graph_ancestors, graph_cycle_check, graph_integrity, graph_merge, artifact_validation, artifact_counts, prompt_packets, contract_violations)}
SQL = {
    "payload_repair": f"""SELECT event_id, CASE WHEN {_K} % 10 = 0 THEN 'c0' ELSE 'c' || user_id END AS candidate_id, upper('ack' || event_type) AS sequence, {_CLAMP} AS overall_score,
      CASE WHEN {_K} > 1 AND {_K} <= 100 THEN {_K} / 100.0::DOUBLE ELSE {_K} END::DOUBLE AS confidence, 'A;B;' || {_K} AS risk_flags, CASE WHEN {_K} % 3 = 2 THEN 'overall_score' ELSE '' END AS invalid_fields, {_K} % 3 = 2 AS requires_repair FROM events""",
    "output_contract": f"""SELECT doc_id, CASE {_M} WHEN 0 THEN 'EMPTY_OUTPUT' WHEN 1 THEN 'NON_JSON_OUTPUT' WHEN 2 THEN 'NON_OBJECT_OUTPUT' WHEN 3 THEN 'SCHEMA_VALIDATION_FAILED' WHEN 4 THEN 'SCHEMA_VALIDATION_FAILED' WHEN 6 THEN 'UNSUPPORTED_ARTIFACT_CONTRACT' WHEN 7 THEN 'CONTEXT_ID_MISMATCH' ELSE '' END AS failure_codes,
      CASE WHEN {_M} < 3 OR {_M} = 6 THEN 0 WHEN {_M} IN (4, 5) THEN 1 ELSE 2 END AS n_warnings, {_M} IN (5, 8) AS passed, {_M} NOT IN (5, 8) AND doc_id % 4 + 1 < 3 AS retry_recommended FROM labels""",
    "cas_put": f"SELECT sha256({_BODY}) AS hash, 'cas://sha256/' || sha256({_BODY}) AS uri, {_BODY} AS body FROM nation WHERE n_nationkey >= 5",
    "snapshot_diff": "SELECT c_custkey AS doc_id, 'remove' AS op, '/old' AS path, NULL AS value FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 'add', '/add', '2' FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, 'replace', '/seg', 'NEW' FROM customer WHERE c_custkey % 4 = 0",
    "patch_roundtrip": "SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 5 = 0 THEN 'add=2;' ELSE '' END || 'nat=' || c_nationkey || ';seg=' || CASE WHEN c_custkey % 4 = 0 THEN 'NEW' ELSE c_mktsegment END AS fields FROM customer",
    "graph_descendants": f"WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT s, t FROM {_EDGES} AS e), r AS (SELECT s AS start, t AS id FROM e WHERE s IN ('r1', 'n7') UNION SELECT r.start, e.t FROM r JOIN e ON e.s = r.id) SELECT start, left(id, 1) AS kind, count(*) AS n FROM r GROUP BY 1, 2",
    "graph_ancestors": f"WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT s, t FROM {_EDGES} AS e), r AS (SELECT t AS start, s AS id FROM e WHERE t IN (SELECT 'o' || o_orderkey FROM orders WHERE o_orderkey % 50 = 0) UNION SELECT r.start, e.s FROM r JOIN e ON e.t = r.id) SELECT start, id FROM r",
    "graph_cycle_check": f"""WITH RECURSIVE back AS (SELECT 'o' || o_orderkey AS s, 'n' || c_nationkey AS t FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN (1, 2, 3)), e AS MATERIALIZED (SELECT DISTINCT s, t FROM {_EDGES} AS e UNION SELECT s, t FROM back),
      r AS (SELECT t AS id FROM back UNION SELECT e.t FROM r JOIN e ON e.s = r.id) SELECT left(s, 1) AS kind, count(DISTINCT s) AS n FROM e WHERE s IN (SELECT id FROM r) GROUP BY 1""",
    "graph_integrity": f"SELECT 'error' AS severity, code, count(*) AS n FROM (SELECT 'EDGE_SOURCE_UNKNOWN' AS code FROM {_EDGES} AS e WHERE s IN ('n3', 'r2') UNION ALL SELECT 'EDGE_TARGET_UNKNOWN' FROM {_EDGES} AS e WHERE t IN ('n3', 'r2')) GROUP BY code",
    "graph_merge": "WITH new AS (SELECT c_custkey + 100 AS id FROM customer WHERE c_custkey % 3 = 0) SELECT node_type, count(*) AS n FROM (SELECT c_mktsegment AS node_type FROM customer WHERE c_custkey NOT IN (SELECT id FROM new) UNION ALL SELECT 'moved' FROM new) GROUP BY node_type",
    "artifact_validation": """SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'candidate' WHEN 1 THEN 'candidate' WHEN 2 THEN 'hypothesis' WHEN 3 THEN 'target' WHEN 4 THEN 'experimental_result' WHEN 5 THEN 'decision_record' END AS artifact_type,
      CASE WHEN c_custkey % 8 < 6 THEN CAST(c_custkey AS VARCHAR) END AS artifact_id, c_custkey % 8 IN (0, 1, 2, 4, 5) AS valid, c_custkey % 8 IN (0, 2, 4, 5) AS valid_by_schema FROM customer""",
    "artifact_counts": "SELECT 'decision_record' AS artifact_type, count(*) FILTER (c_custkey % 2 = 0) AS valid_count, count(*) FILTER (c_custkey % 2 = 1) AS invalid_count FROM customer",
    "prompt_packets": "SELECT agent, artifact, n, n AS n_ids FROM (SELECT 'target_biology_agent' AS agent, 'target_dossier' AS artifact, 1 AS n UNION ALL SELECT 'candidate_generation_agent', 'candidate_card', count(*) FROM documents UNION ALL SELECT 'red_team_agent', 'red_team_review', count(*) FROM documents UNION ALL SELECT 'assay_planning_agent', 'assay_pack', count(*) FROM documents)",
    "contract_violations": f"""SELECT 'error' AS severity, message, count(*) AS n FROM (SELECT 'sequence is a sequence of 2 to 20 standard residues' AS message FROM {SEQ_HASH} AS t WHERE length(sequence) > 20
      UNION ALL SELECT 'quality present' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'toxic within [0, 0]' FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 1) <> 0) GROUP BY message""",
}

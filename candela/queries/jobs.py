"""The end-to-end jobs over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.operators import results
from candela.plans import jobs as J
from candela.queries import laboratory
from candela.queries.tables import SEQ_HASH, repeated, repeated_sql, seq_hash


def _candidates(spark, sf_dir):
    d = seq_hash(spark, sf_dir)
    return d.select(
        F.concat(F.lit("c"), repeated(F.col("doc_id"), 33).cast("string")).alias("candidate_id"), F.when(F.col("doc_id") % 50 == 0, F.concat("sequence", F.lit("*"))).otherwise(F.col("sequence")).alias("sequence"),
        F.when(F.col("doc_id") % 70 == 0, "t2").otherwise("t1").alias("target_id"), F.lit("h1").alias("hypothesis_id"), F.lit("linear").alias("modality"), F.array().cast("array<string>").alias("risk_flags"), F.lit("draft").alias("status"), F.col("doc_id").alias("seq"),
    )


def _round(spark, sf_dir):
    t, h = spark.createDataFrame([("t1", "T")], "target_id string, name string"), spark.createDataFrame([("h1", "t1")], "hypothesis_id string, target_id string")
    return J.scoring_round(t, h, _candidates(spark, sf_dir), run_id="R1", strict=False)


def scoring_round(spark, sf_dir):
    r = _round(spark, sf_dir)
    return r.candidates.groupBy("recommendation", "status").agg(F.count("*").alias("n"))


def scoring_round_events(spark, sf_dir):
    return _round(spark, sf_dir).events.groupBy("severity", "code").agg(F.count("*").alias("n"))


def scoring_round_graph(spark, sf_dir):
    r = _round(spark, sf_dir)
    return r.nodes.groupBy(F.col("node_type").alias("kind")).agg(F.count("*").alias("n")).unionByName(r.edges.groupBy(F.col("edge_type").alias("kind")).agg(F.count("*").alias("n")))


def result_review(spark, sf_dir):
    c = seq_hash(spark, sf_dir).select(F.concat(F.lit("c"), "doc_id").alias("candidate_id"), F.lit("scored").alias("status"))
    r = J.result_review(c, laboratory._results(spark, sf_dir), campaign_id="CAMP", run_id="R1", strict=False)
    return r.candidates.groupBy("status").agg(F.count("*").alias("n"))


def document_results(spark, sf_dir):
    """Result documents written from events, parsed, classified and counted by failure mode."""
    from candela.queries.tables import table

    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    text = F.concat(
        F.lit("Result ID: R"), repeated(F.col("event_id"), 11), F.lit("\nCandidate ID: C"), "user_id", F.lit("\nResult type: assay\n\n## Summary\nRun showed "), F.when(k % 5 == 0, "no binding").when(k % 5 == 1, "aggregate").otherwise("activity"),
        F.lit(".\n\n## Key values\n| Metric | Value | Notes |\n|---|---|---|\n| Yield | "), k, F.lit(" mg | |\n| Purity | "), F.when(k % 2 == 0, "95-97").otherwise("n/a"), F.lit(" | |\n\n## Failure modes\n- "), F.when(k % 7 == 0, "OFF_TARGET_SIGNAL").otherwise("to be populated"), F.lit("\n"),
    )
    good, bad = results.ingest(e.select("event_id", text.alias("text")), "event_id")
    return results.mode_counts(good).unionByName(bad.select(F.regexp_replace("error", "[0-9]+", "#").alias("failure_mode")).groupBy("failure_mode").agg(F.count("*").alias("n")))


def dialectic_screen(spark, sf_dir):
    return J.dialectic_screen(seq_hash(spark, sf_dir)).groupBy("decision", "passed_hard_drc").agg(F.count("*").alias("n"))


from candela.queries import sequences as Q  # noqa: E402

_K = "CAST(json_extract_string(props, '$.k') AS INT)"
_CAND = f"(SELECT 'c' || {repeated_sql('doc_id', 33)} AS id, doc_id AS seq, doc_id % 50 = 0 AS bad, doc_id % 70 = 0 AS other, row_number() OVER (PARTITION BY {repeated_sql('doc_id', 33)} ORDER BY doc_id) AS n, * FROM {Q._DRC} AS d JOIN (SELECT doc_id, greatest(0.0, least(100.0, {Q._SCORE})) AS s FROM {SEQ_HASH} AS t) USING (doc_id))"
_GOOD = f"(SELECT * FROM {_CAND} AS c WHERE NOT bad AND NOT other AND n = 1)"

QUERIES = {f.__name__: f for f in (scoring_round, scoring_round_events, scoring_round_graph, result_review, document_results, dialectic_screen)}
SQL = {
    "scoring_round": f"SELECT CASE WHEN n_fatal > 0 THEN 'reject_or_redesign_drc_failure' WHEN s >= 80 THEN 'test_or_keep' WHEN s >= 60 THEN 'revise_or_test_with_caution' ELSE 'revise_before_testing' END AS recommendation, 'scored' AS status, count(*) AS n FROM {_GOOD} AS g GROUP BY 1",
    "scoring_round_events": f"SELECT 'error' AS severity, code, count(*) AS n FROM (SELECT 'CANDIDATE_INVALID_SEQUENCE' AS code FROM {_CAND} AS c WHERE bad UNION ALL SELECT 'CANDIDATE_TARGET_MISMATCH' FROM {_CAND} AS c WHERE other UNION ALL SELECT 'CANDIDATE_DUPLICATE_ID' FROM {_CAND} AS c WHERE n > 1) GROUP BY code",
    "scoring_round_graph": f"SELECT unnest(['target', 'hypothesis', 'candidate', 'prediction', 'assessment', 'supports', 'generated', 'evaluated_by']) AS kind, unnest([1, 1, n, n, n, 1, n, 2 * n]) AS n FROM (SELECT count(*) AS n FROM {_GOOD} AS g)",
    "result_review": f"SELECT status, count(*) AS n FROM (SELECT coalesce(arg_max(CASE WHEN len(modes) > 0 THEN 'rejected' ELSE 'advanced' END, seq), 'scored') AS status FROM (SELECT 'c' || doc_id AS id FROM documents) AS c LEFT JOIN {laboratory._RES} AS r ON r.candidate_id = c.id GROUP BY c.id) GROUP BY status",
    "document_results": f"""WITH d AS (SELECT {_K} AS k, row_number() OVER (PARTITION BY {repeated_sql('event_id', 11)} ORDER BY event_id) AS n FROM events), m AS (SELECT unnest(list_filter([CASE WHEN k % 7 = 0 THEN 'OFF_TARGET_SIGNAL' END, CASE WHEN k < 20 THEN 'SYN_LOW_YIELD' END, CASE WHEN k % 5 = 0 THEN 'NO_BINDING' END, CASE WHEN k % 5 = 1 THEN 'AGGREGATED_PRODUCT' END, CASE WHEN k % 5 = 1 THEN 'AGGREGATION' END], lambda x: x IS NOT NULL)) AS failure_mode FROM d WHERE n = 1)
      SELECT failure_mode, count(*) AS n FROM m GROUP BY 1 UNION ALL SELECT 'Duplicate result_id encountered: R#', count(*) FROM d WHERE n > 1 HAVING count(*) > 0""",
    "dialectic_screen": f"""SELECT CASE WHEN n_fatal > 0 THEN 'REJECT' WHEN s >= 0.70 THEN 'REJECT' WHEN abs(a - (1.0 - s)) > 0.35 THEN 'DISCRIMINATIVE_ASSAY' WHEN a >= 0.60 THEN 'PASS' ELSE 'REJECT' END AS decision, n_fatal = 0 AS passed_hard_drc, count(*) AS n
      FROM (SELECT *, 0.70::DOUBLE + least(0.25::DOUBLE, {Q.count_sql('KRH')} / length(sequence)::DOUBLE * 0.5) AS a, least(1.0::DOUBLE, n_fatal * 0.5::DOUBLE + n_high_risk * 0.25::DOUBLE) AS s FROM {Q._DRC} AS d) GROUP BY 1, 2""",
}

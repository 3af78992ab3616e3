"""Sources and sinks: files written from the given tables into the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from candela.functions.sequence import HYDROPHOBIC_WIDE
from candela.operators import artifacts as A
from candela.operators import telemetry as T
from candela.operators.staging import dealt, shared_folder, staged
from candela.plans import jobs as J
from candela.queries.tables import SEQ_HASH, count_sql, seq_hash, streamed, table
from candela.sources import datasets, sinks


def _folder(spark, name):
    return f"{shared_folder(spark)}/files-{name}-{uuid.uuid4().hex}"


def csv_dataset(spark, sf_dir):
    """customer as CSV with padded values, read as trimmed strings; record numbers are counted from 2."""
    path = _folder(spark, "csv")
    table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("name"), F.concat("c_mktsegment", F.lit(', "x"')).alias("seg")).write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    d = datasets.read_dataset(spark, path)
    n = d.agg(F.count("*").alias("n"), F.min("_row_number").alias("lo"), F.max("_row_number").alias("hi"), F.count_distinct("_row_number").alias("kinds"))
    return d.select("c_custkey", "name", "seg").crossJoin(F.broadcast(n))  # one row


def csv_typed(spark, sf_dir):
    """lineitem as CSV with a blank and a wrong number, read by a schema."""
    path, li = _folder(spark, "typed"), table(spark, sf_dir, "lineitem")
    quantity = F.when(F.col("l_linenumber") == 2, "many").when(F.col("l_linenumber") == 3, " ").otherwise(F.col("l_quantity").cast("string"))
    li.select("l_orderkey", "l_linenumber", quantity.alias("quantity")).write.option("header", True).csv(path)
    d = datasets.read_typed(spark, path, "l_orderkey long, l_linenumber int, quantity double, absent string")
    return d.select("l_orderkey", "l_linenumber", "quantity", "absent", F.array_join("_invalid", ";").alias("invalid"))


def csv_modes(spark, sf_dir):
    """lineitem as CSV with wrong numbers, read by a schema that keeps the records that do not fit, and one that leaves them out."""
    path, li = _folder(spark, "modes"), table(spark, sf_dir, "lineitem")
    quantity = F.when(F.col("l_linenumber") == 2, "many").otherwise(F.col("l_quantity").cast("string"))
    li.select("l_orderkey", quantity.alias("quantity"), "l_returnflag").write.option("header", True).csv(path)
    schema = "l_orderkey long, quantity double, l_returnflag string"
    kept = datasets.read_by_schema(spark, path, schema).groupBy(F.when(F.col("_corrupt_record").isNull(), "fits").otherwise(F.substring_index("_corrupt_record", ",", -1)).alias("what")).agg(F.count("*").alias("n"), F.count("quantity").alias("n_quantity"))
    rest = datasets.read_by_schema(spark, path, schema, "DROPMALFORMED").select(F.lit("left in").alias("what"), "quantity", "l_orderkey", "l_returnflag")
    return kept.unionByName(rest.groupBy("what").agg(F.count("*").alias("n"), F.count("quantity").alias("n_quantity")))


def split_stream(spark, sf_dir):
    """events as a stream into good rows and dead letters, its first batch delivered twice."""
    path = _folder(spark, "split")
    e = streamed(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("value") % 1 < 0.35, "Timeout").alias("error"))
    sinks.split_stream(e, path).awaitTermination()
    again = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("value") % 1 < 0.35, "Timeout").alias("error"))
    sinks.split_batch(path)(again, 0)
    good, dead = spark.read.parquet(f"{path}/good"), spark.read.parquet(f"{path}/dead")
    return good.groupBy(F.lit("good").alias("what"), "event_type").agg(F.count("*").alias("n")).unionByName(dead.groupBy(F.col("error").alias("what"), "event_type").agg(F.count("*").alias("n")))


def json_artifacts(spark, sf_dir):
    """orders as JSON texts, some of them broken, read with their errors; a missing file and a wrong suffix are rows too."""
    path, o = _folder(spark, "json"), table(spark, sf_dir, "orders")
    o.select(F.when(F.col("o_orderkey") % 10 == 0, "{broken").otherwise(F.to_json(F.struct("o_orderkey", "o_custkey"))).alias("value")).write.text(f"{path}/lines")
    files, wrong = datasets.expanded(spark, [path, f"{path}/none.json"], (".txt",))
    _, suffix = datasets.expanded(spark, files[:1])
    d, wrong = spark.read.text(files).select(F.col("value").alias("payload")), wrong.unionByName(suffix)
    ok = d.select(F.when(F.try_parse_json("payload").isNull(), "invalid JSON").otherwise("").alias("error"))
    return ok.unionByName(wrong.select("error")).groupBy("error").agg(F.count("*").alias("n"))


def telemetry_csv_drop(spark, sf_dir):
    """lineitem as a vendor's CSV, read as telemetry, through the second stage's gate."""
    path = _folder(spark, "drop")
    li = table(spark, sf_dir, "lineitem")
    li.select(F.concat(F.lit("P"), "l_partkey").alias("Sample ID"), (F.col("l_quantity") * 2).alias("HPLC_Purity"), (F.col("l_discount") * 20).alias("Solubility (mg/ml)"), (F.col("l_tax") * 5).alias("agg_index"), "l_suppkey").write.option("header", True).csv(path)
    r = T.records(datasets.telemetry_csv(spark, path))
    r = staged(r.select(F.array_join(T.stage2()["failure_codes"], ";").alias("codes"), "ingest_order", "candidate_id"), "drop")
    n = r.count()
    # each distinct count on its own, in parts of bounded rows: both at once double all rows, and whole files' rows meet in one task
    orders = dealt(r.select("codes", "ingest_order"), "ingest_order", n).distinct().groupBy("codes").agg(F.count("*").alias("n_orders"))
    candidates = dealt(r.select("codes", "candidate_id"), "candidate_id", n).groupBy("codes", "candidate_id").agg(F.count("*").alias("n")).groupBy("codes").agg(F.sum("n").alias("n"), F.count("candidate_id").alias("n_candidates"))
    return candidates.join(orders, "codes").select("codes", "n", "n_orders", "n_candidates")


def telemetry_json_drop(spark, sf_dir):
    """lineitem as JSON drops - lists, objects with records, single objects - read as telemetry."""
    li = table(spark, sf_dir, "lineitem")
    record = F.struct(F.concat(F.lit("P"), "l_partkey").alias("peptide_id"), F.col("l_quantity").cast("string").alias("yield"))
    d = li.groupBy("l_orderkey").agg(F.collect_list(record).alias("r"))
    text = F.when(F.col("l_orderkey") % 3 == 0, F.to_json("r")).when(F.col("l_orderkey") % 3 == 1, F.concat(F.lit('{"records":'), F.to_json("r"), F.lit("}"))).otherwise(F.to_json(F.array_min("r")))
    path = _folder(spark, "drops")
    d.select(text.alias("value")).write.text(path)
    r = T.records(datasets.telemetry_json(spark.read.text(path)))
    return r.groupBy("candidate_id").agg(F.count("*").alias("n"), F.round(F.sum("yield_mg"), 2).alias("yield_mg"))


def graph_files(spark, sf_dir):
    """Customers and their orders as JSON graphs and as an edge list, written and read back."""
    path, o = _folder(spark, "graph"), table(spark, sf_dir, "orders")
    node = F.struct(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.lit("order").alias("node_type"), F.struct(F.col("o_orderstatus").alias("s")).alias("payload"))
    edge = F.struct(F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("o"), "o_orderkey").alias("target"), F.lit("placed").alias("edge_type"))
    o.groupBy("o_custkey").agg(F.collect_list(node).alias("nodes"), F.collect_list(edge).alias("edges")).select(F.to_json(F.struct("nodes", "edges")).alias("value")).write.text(f"{path}/graphs")
    nodes, edges = datasets.graph(spark.read.text(f"{path}/graphs").withColumnRenamed("value", "payload"))
    sinks.write_graph(nodes, edges, f"{path}/tables")
    edges.write.option("header", True).csv(f"{path}/list")
    again = spark.read.json(f"{path}/tables/nodes").groupBy(F.col("payload").alias("what")).agg(F.count("*").alias("n"))
    return again.unionByName(datasets.edge_list(spark, f"{path}/list").groupBy(F.col("edge_type").alias("what")).agg(F.count_distinct("source", "target").alias("n")))


def candidate_files(spark, sf_dir):
    """documents as candidate records, some incomplete, read with statuses reset."""
    path, d = _folder(spark, "candidates"), seq_hash(spark, sf_dir)
    m = F.col("doc_id") % 6
    status = F.when(m == 0, "rejected").when(m == 1, "selected").when(m == 2, "tested")
    sinks.write_records(d.select(F.concat(F.lit("c"), "doc_id").alias("candidate_id"), F.when(m != 4, F.col("sequence")).alias("sequence"), F.lit("t").alias("target_id"), F.lit("h").alias("hypothesis_id"), status.alias("status")), path)
    return datasets.candidate_records(spark, path, reset_status=True).select("candidate_id", "sequence", "status", "modality")


def appended_log(spark, sf_dir):
    """events appended in two turns to one log."""
    path, e = _folder(spark, "log"), table(spark, sf_dir, "events").select("event_id", "event_type")
    sinks.append_log(e.where("event_id % 2 = 0"), path)
    sinks.append_log(e.where("event_id % 2 = 1"), path)
    return spark.read.json(path).groupBy("event_type").agg(F.count_distinct("event_id").alias("n"))


def artifact_bundle(spark, sf_dir):
    """Validated artifacts in a bundle: two kinds read back, with the manifest and the report's lines."""
    path, c = _folder(spark, "bundle"), table(spark, sf_dir, "customer")
    ident, m = F.col("c_custkey").cast("string"), F.col("c_custkey") % 3
    body = F.when(m == 0, F.concat(F.lit('{"candidate_id":"'), ident, F.lit('","sequence":"ACK","target_id":"t","hypothesis_id":"h","modality":"linear"}'))).when(m == 1, F.concat(F.lit('{"decision_id":"'), ident, F.lit('","campaign_id":"c","decision":"pause","rationale":"r"}'))).otherwise(F.concat(F.lit('{"target_id":"'), ident, F.lit('","name":"n","organism":"o","use_case":"u","rationale":"r"}')))
    c.select(body.alias("value")).write.text(f"{path}/in")
    v = A.validated(spark.read.text(f"{path}/in").withColumnRenamed("value", "payload"))
    sinks.write_bundle(v.select("artifact_type", "artifact_id", "payload", "valid"), f"{path}/bundle")
    two = sinks.read_bundle(spark, f"{path}/bundle", ["candidate", "target"]).groupBy(F.concat(F.lit("read "), "artifact_type").alias("what")).agg(F.count_if("valid").alias("n"))
    manifest = spark.read.json(f"{path}/bundle/manifest").select(F.concat(F.lit("listed "), "artifact_type").alias("what"), "n")
    report = spark.read.text(f"{path}/bundle/report").select(F.col("value").alias("what"), F.lit(1).cast("long").alias("n"))
    return two.unionByName(manifest).unionByName(report)


def feature_csv(spark, sf_dir):
    """A dataset with its curation features as CSV, read back."""
    path = _folder(spark, "features")
    sinks.write_features(seq_hash(spark, sf_dir), path)
    d = datasets.read_typed(spark, path, "doc_id long, sequence string, length int, net_charge double, hydrophobic_fraction double, aromatic_count int, cysteine_count int")
    return d.drop("_row_number", "_invalid")


def packet_files(spark, sf_dir):
    """Packets of work in a folder an agent."""
    path = _folder(spark, "packets")
    c = seq_hash(spark, sf_dir).select(F.concat(F.lit("c"), "doc_id").alias("candidate_id"), "sequence")
    t = table(spark, sf_dir, "region").select(F.concat(F.lit("t"), "r_regionkey").alias("target_id"), F.col("r_name").alias("name"))
    sinks.write_packets(A.packets(t, c, "R1"), path)
    read = spark.read.json(f"{path}/packets").groupBy("agent").agg(F.count("*").alias("n"))
    return read.join(spark.read.json(f"{path}/manifest").groupBy("agent").agg(F.sum("n").alias("n_listed")), "agent")


def card_files(spark, sf_dir):
    """Cards as text; documents without a sequence are skipped."""
    path = _folder(spark, "cards")
    d = seq_hash(spark, sf_dir).withColumn("sequence", F.when(F.col("doc_id") % 7 != 0, F.col("sequence")).otherwise(" ")).withColumn("length", F.length("sequence"))
    sinks.write_cards(d.withColumn("card", F.regexp_replace(sinks.card({"length": F.col("length"), "note": F.lit(None)}, F.concat(F.lit("c"), "doc_id")), "\n", "~")), "card", path, needs=("doc_id", "sequence"))
    return spark.read.text(path)


def dead_letter_log(spark, sf_dir):
    """Failed calls of events as dead letters."""
    path = _folder(spark, "dead")
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("agent"), "ts", (F.col("value") % 1 >= 0.35).alias("ok"), F.lit("Timeout").alias("error_type"), F.concat(F.lit("call "), "event_id").alias("error_message"), F.col("props").alias("payload"))
    sinks.append_log(sinks.dead_letters(e), path)
    return spark.read.json(path).groupBy("agent", "error_type").agg(F.count("*").alias("n"), F.count_distinct("error_message").alias("n_messages"))


def dataset_rules(spark, sf_dir):
    """The seed and the liability dataset, checked together, from CSV."""
    path, d = _folder(spark, "datasets"), seq_hash(spark, sf_dir)
    seed = d.select(F.concat(F.lit("p"), "doc_id").alias("peptide_id"), F.when(F.col("doc_id") % 10 == 0, F.concat("sequence", F.lit("Z"))).otherwise(F.col("sequence")).alias("sequence"), F.length("sequence").alias("length"), F.lit("n").alias("name"), F.lit("linear").alias("linear_or_cyclic"), F.lit("m").alias("target_microbe"))
    seed.write.option("header", True).csv(f"{path}/seed")
    events, counts = J.dataset_validation(datasets.read_dataset(spark, f"{path}/seed"), datasets.read_dataset(spark, f"{path}/seed").select("_row_number", "peptide_id"))
    some = events.where("code in ('SEED_SEQUENCE', 'SEED_LENGTH_MISMATCH')").groupBy("code").agg(F.count("*").alias("n"))
    return some.unionByName(counts.select(F.lit("rows").alias("code"), F.col("rows").alias("n"))).unionByName(counts.select(F.lit("ids").alias("code"), F.col("unique_peptides").alias("n")))


QUERIES = {f.__name__: f for f in (csv_dataset, csv_typed, csv_modes, split_stream, json_artifacts, telemetry_csv_drop, telemetry_json_drop, graph_files, candidate_files, appended_log, artifact_bundle, feature_csv, packet_files, card_files, dead_letter_log, dataset_rules)}
SQL = {
    "csv_dataset": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name AS name, c_mktsegment || ', \"x\"' AS seg, n, 2 AS lo, n + 1 AS hi, n AS kinds FROM customer, (SELECT count(*) AS n FROM customer)",
    "csv_typed": "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber NOT IN (2, 3) THEN l_quantity::DOUBLE END AS quantity, NULL AS absent, CASE WHEN l_linenumber = 2 THEN 'quantity' ELSE '' END AS invalid FROM lineitem",
    "csv_modes": "SELECT CASE WHEN l_linenumber = 2 THEN l_returnflag ELSE 'fits' END AS what, count(*) AS n, count(*) FILTER (l_linenumber <> 2) AS n_quantity FROM lineitem GROUP BY 1 UNION ALL SELECT 'left in', count(*), count(*) FROM lineitem WHERE l_linenumber <> 2",
    "split_stream": "SELECT CASE WHEN value % 1 < 0.35 THEN 'Timeout' ELSE 'good' END AS what, event_type, count(*) AS n FROM events GROUP BY ALL",
    "json_artifacts": "SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'invalid JSON' ELSE '' END AS error, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'file does not exist', 1 UNION ALL SELECT 'unsupported suffix, expected one of .json, .jsonl', 1",
    "telemetry_csv_drop": "SELECT codes, count(*) AS n, count(*) AS n_orders, count(DISTINCT l_partkey) AS n_candidates FROM (SELECT l_partkey, array_to_string(list_filter([CASE WHEN l_quantity * 2 < 90 THEN 'SYN_PURITY_FAIL' END, CASE WHEN l_discount * 20 < 0.5 THEN 'SOLUBILITY_LOW' END, CASE WHEN l_tax * 5 > 0.30 THEN 'AGGREGATION_HIGH' END], lambda x: x IS NOT NULL), ';') AS codes FROM lineitem) GROUP BY codes",
    "telemetry_json_drop": "SELECT 'P' || l_partkey AS candidate_id, count(*) AS n, round(sum(l_quantity), 2) AS yield_mg FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY 'P' || l_partkey, CAST(l_quantity::DOUBLE AS VARCHAR)) AS k FROM lineitem) WHERE l_orderkey % 3 <> 2 OR k = 1 GROUP BY 1",
    "graph_files": "SELECT '{\"s\":\"' || o_orderstatus || '\"}' AS what, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT 'placed', count(*) FROM orders",
    "candidate_files": f"SELECT 'c' || doc_id AS candidate_id, sequence, CASE doc_id % 6 WHEN 0 THEN 'scored' WHEN 1 THEN 'selected' WHEN 2 THEN 'tested' ELSE 'draft' END AS status, 'unknown' AS modality FROM {SEQ_HASH} AS t WHERE doc_id % 6 <> 4",
    "appended_log": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "artifact_bundle": "WITH k AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'candidate' WHEN 1 THEN 'decision_record' ELSE 'target' END AS kind, count(*) AS n FROM customer GROUP BY 1) SELECT 'read ' || kind AS what, n FROM k WHERE kind <> 'decision_record' UNION ALL SELECT 'listed ' || kind, n FROM k UNION ALL SELECT '- ' || kind || ': ' || n, 1 FROM k",
    "feature_csv": f"SELECT doc_id, sequence, length(sequence)::INT AS length, round({count_sql('KR')} + 0.1::DOUBLE * {count_sql('H')} - {count_sql('DE')}, 2) AS net_charge, round({count_sql(HYDROPHOBIC_WIDE)} / length(sequence)::DOUBLE, 4) AS hydrophobic_fraction, {count_sql('FWY')}::INT AS aromatic_count, {count_sql('C')}::INT AS cysteine_count FROM {SEQ_HASH} AS t",
    "packet_files": "SELECT agent, n, n AS n_listed FROM (SELECT 'target_biology_agent' AS agent, (SELECT count(*) FROM region) AS n UNION ALL SELECT unnest(['candidate_generation_agent', 'red_team_agent', 'assay_planning_agent']), (SELECT count(*) FROM documents))",
    "card_files": f"SELECT '# c' || doc_id || '~~- length: ' || length(sequence) || '~' AS value FROM {SEQ_HASH} AS t WHERE doc_id % 7 <> 0",
    "dead_letter_log": "SELECT CAST(user_id AS VARCHAR) AS agent, 'Timeout' AS error_type, count(*) AS n, count(*) AS n_messages FROM events WHERE NOT value % 1 >= 0.35 GROUP BY 1",
    "dataset_rules": f"SELECT code, n FROM (SELECT 'SEED_SEQUENCE' AS code, count(*) AS n FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT 'SEED_LENGTH_MISMATCH', count(*) FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT 'rows', count(*) FROM documents UNION ALL SELECT 'ids', count(DISTINCT doc_id) FROM documents)",
}

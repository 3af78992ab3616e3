"""Telemetry, result classification, review roll-ups, breaker states and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.operators import health, results, review, summaries
from candela.operators import telemetry as T
from candela.operators.staging import staged
from candela.queries.tables import SEQ_HASH, seq_hash, streamed, table
from candela.streaming import cards, stateful

CAMPAIGN, RUN = "CAMP", "R1"
#: Every phrase of the narrative rules; one of them, or none, is written behind each text.
PHRASES = [" and ".join(some) for _, *lists in results.RULES for some in ([*(x[0] for x in lists)], *([p] for p in lists[0][1:]))] + ["nothing of note"] * 20


def _drop(spark, sf_dir):
    return _records(table(spark, sf_dir, "lineitem"))


def _records(li, *more):
    """lineitem as canonical telemetry records of parts."""
    return li.select(
        *more,
        F.concat(F.lit("P"), "l_partkey").alias("candidate_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ingest_order"), (F.col("l_quantity") * 2).alias("crude_purity_pct"), (F.col("l_discount") * 100).alias("yield_mg"),
        F.round(F.col("l_extendedprice") / 10).alias("mass_observed_da"), F.when(F.col("l_linenumber") < 6, F.round(F.col("l_extendedprice") / 10) + F.when(F.col("l_linenumber") == 5, 3).otherwise(0)).alias("mass_expected_da"), (F.col("l_quantity") * 2).alias("purified_purity_pct"),
        (F.col("l_discount") * 20).alias("solubility_mg_ml"), (F.col("l_tax") * 5).alias("aggregation_index"), F.lit(None).cast("double").alias("dls_polydispersity"),
        F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")).alias("kd_nm"), F.when(F.col("l_linenumber") == 3, F.when(F.col("l_tax") > 0.04, F.col("l_quantity"))).alias("ic50_nm"), F.when(F.col("l_returnflag") == "R", "yes").otherwise("no").alias("censored"),
        F.col("l_suppkey").alias("plate"),
    )


def _ordered(records):
    """With ``at``, which orders a candidate's records: an ingest_order may come twice."""
    return records.withColumn("at", F.struct("ingest_order", "mass_observed_da", "yield_mg", "plate", "aggregation_index"))


_KEYS = ["candidate_id", "ingest_order", "plate"]


def telemetry_stage1(spark, sf_dir):
    g = T.stage1()
    return _drop(spark, sf_dir).select(*_KEYS, "mass_observed_da", g["is_mass_matched"].alias("is_mass_matched"), F.array_join(g["failure_codes"], ";").alias("codes"))


def telemetry_stage2(spark, sf_dir):
    return _drop(spark, sf_dir).select(*_KEYS, "solubility_mg_ml", F.array_join(T.stage2()["failure_codes"], ";").alias("codes"))


def telemetry_stage3(spark, sf_dir):
    g = T.stage3()
    return _drop(spark, sf_dir).select(*_KEYS, g["is_binder"].alias("is_binder"), g["potency"].alias("potency"), F.array_join(g["failure_codes"], ";").alias("codes"))


def _cards(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("P"), "p_partkey").alias("candidate_id"), F.lit("designed").alias("experiment_state"), F.lit("draft").alias("status"), F.lit(None).cast("double").alias("potency"), F.array().cast("array<string>").alias("risk_flags"))


def telemetry_lifecycle(spark, sf_dir):
    """Cards of all parts after the three drops, of each part the last record counting."""
    d, c = _ordered(_drop(spark, sf_dir)), _cards(spark, sf_dir)
    for s in T.STAGES:
        c = T.apply_drop(c, d, s, order_col="at").drop("log")
    return c.select("candidate_id", "experiment_state", "status", "potency", F.array_join("risk_flags", ";").alias("risk_flags"))


def telemetry_counts(spark, sf_dir):
    return T.counts(T.apply_drop(_cards(spark, sf_dir), _ordered(_drop(spark, sf_dir)), T.STAGES[1], order_col="at"))


def card_stream(spark, sf_dir):
    """Cards after every record of every stage, folded from a stream that starts from the table of cards: the last card of each part."""
    li = streamed(spark, sf_dir, "lineitem")
    records = _records(li, "l_extendedprice")
    at = {s: k for k, s in enumerate(T.STAGES)}
    staged_rows = records.withColumn("stage", F.explode(F.array(*map(F.lit, T.STAGES))))
    order = F.create_map(*(F.lit(x) for kv in at.items() for x in kv))[F.col("stage")].cast("long") * (1 << 60) + F.col("ingest_order") * (1 << 24) + F.round(F.col("l_extendedprice") * 100).cast("long")
    rows = stateful.drained(stateful.fold_cards(cards.outcomes(staged_rows.withColumn("seq", order)), _cards(spark, sf_dir), every=False), "cards")
    last = rows.groupBy("candidate_id").agg(F.max_by(F.struct("experiment_state", "status", "potency", F.array_join("risk_flags", ";").alias("risk_flags")), "seq").alias("c"))
    return last.select("candidate_id", "c.*")


def telemetry_headers(spark, sf_dir):
    """Vendor headers made canonical: two headers of one field, a blank value and an unknown header."""
    li = table(spark, sf_dir, "lineitem")
    m = F.create_map(F.lit("Sample ID"), F.col("l_partkey").cast("string"), F.lit(" Yield (mg)"), F.col("l_quantity").cast("string"), F.lit("yield"), F.when(F.col("l_returnflag") == "R", "7.5").otherwise(" "), F.lit("Operator X"), F.col("l_linestatus"))
    d = li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("s"), T.canonical_keys(m).alias("m"))
    return d.select("k", "line", "s", F.expr("m['candidate_id']").alias("candidate_id"), F.expr("try_cast(m['yield_mg'] as double)").alias("yield_mg"), F.expr("m['operator_x']").alias("operator_x"), F.size("m").alias("n"))


def plate_failures(spark, sf_dir):
    d = T.plate_failures(_drop(spark, sf_dir), "plate", ~T.stage2()["passed"])
    return d.select("plate", F.round("failure_rate", 6).alias("failure_rate"), "n", "alert")


def conversion_rate(spark, sf_dir):
    d = _drop(spark, sf_dir)
    return T.conversion_rate(d, d, "plate").select("plate", F.round("rate", 6).alias("rate"), "alert")


def control_normalised(spark, sf_dir):
    d = _drop(spark, sf_dir)
    out = T.control_normalised(d.select("candidate_id", "ingest_order", "plate", "kd_nm"), d.where("ingest_order % 10 = 1"), "plate", "kd_nm")
    return out.groupBy("plate").agg(F.round(F.avg("ratio"), 5).alias("mean_ratio"), F.count("ratio").alias("n"))


def _candidate(doc_id):
    """Three results a candidate, but one result in 20 of a candidate that nobody knows."""
    return F.when(doc_id % 20 == 0, F.concat(F.lit("x"), doc_id.cast("string"))).otherwise(F.concat(F.lit("c"), (F.floor(doc_id / 3) + 1).cast("string")))


def _results(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("seq"), F.concat(F.lit("r"), "doc_id").alias("result_id"), _candidate(F.col("doc_id")).alias("candidate_id"), results.classify(F.concat("text", F.lit(" "), F.get(F.array(*map(F.lit, PHRASES)), (F.col("doc_id") % len(PHRASES)).cast("int")))).alias("failure_modes"))


def failure_modes(spark, sf_dir):
    return _results(spark, sf_dir).select("result_id", F.array_join("failure_modes", ";").alias("failure_modes"))


def failure_mode_counts(spark, sf_dir):
    return results.mode_counts(_results(spark, sf_dir))


def _reviews(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("candidate_id"), F.lit("scored").alias("status"))
    return review.review(staged(_results(spark, sf_dir), "results"), c, CAMPAIGN, RUN)  # texts are classified once, whatever reads the reviews


def review_rollup(spark, sf_dir):
    r, _ = _reviews(spark, sf_dir)
    return review.ranked_counts(r, "recommendations", "step").select("step", "n")


def review_decisions(spark, sf_dir):
    r, _ = _reviews(spark, sf_dir)
    return r.select("decision_id", "result_id", "decision", "rationale", F.array_join("recommendations", " ").alias("recommendations"))


def review_unmatched(spark, sf_dir):
    return _reviews(spark, sf_dir)[1].groupBy("severity", "code").agg(F.count("*").alias("n"))


def next_round_buckets(spark, sf_dir):
    return review.next_round(_reviews(spark, sf_dir)[0]).groupBy("bucket").agg(F.count("*").alias("n"))


def first_transitions(spark, sf_dir):
    return review.first_transitions(_reviews(spark, sf_dir)[0])


def campaign_decision(spark, sf_dir):
    d = review.campaign_decision(_reviews(spark, sf_dir)[0], CAMPAIGN, RUN)
    return d.select("decision_id", "decision", "rationale", F.col("alternatives_considered")[0].alias("top_step"), F.col("risks")[0].alias("top_risk"), F.size("risks").alias("n_risks"))


def closed_loop_check(spark, sf_dir):
    r = _reviews(spark, sf_dir)[0]
    d = review.campaign_decision(r.where("seq % 2 = 0"), CAMPAIGN, "R2")
    return review.consistency_events(r.withColumn("candidate_id", F.when(F.col("seq") % 100 != 0, F.col("candidate_id"))), d, CAMPAIGN, RUN).groupBy("severity", "code").agg(F.count("*").alias("n"))


def _calls(spark, sf_dir):
    return _call_rows(table(spark, sf_dir, "events"))


def _call_rows(events):
    return events.select(F.col("user_id").cast("string").alias("agent"), "ts", F.col("event_id").alias("seq"), (F.col("value") % 1 >= 0.35).alias("ok"))


def failure_rate_window(spark, sf_dir):
    return health.failure_rates(_calls(spark, sf_dir)).select("agent", "seq", F.round("failure_rate", 6).alias("failure_rate"), "n_calls")


def breaker_states(spark, sf_dir):
    return health.states(_calls(spark, sf_dir), health.Config(timeout_s=86_400)).select("agent", "seq", "ok", "state", "blocked", "use_fallback")


def breaker_stream(spark, sf_dir):
    """Calls and half-open moments from a stream of all events. A last row, a year on, lets the watermark pass them all."""
    end = table(spark, sf_dir, "events").agg((F.max("ts") + F.expr("interval 365 days")).alias("ts")).select(F.lit(None).cast("string").alias("agent"), "ts", F.lit(0).cast("long").alias("seq"), F.lit(True).alias("ok"))
    last = staged(end, "end")
    calls = _call_rows(streamed(spark, sf_dir, "events")).unionByName(spark.readStream.schema(last.schema).parquet(last.inputFiles()[0].rpartition("/")[0]))
    rows = stateful.drained(stateful.breaker_events(calls, health.Config(timeout_s=86_400)), "breakers")
    return rows.where("agent is not null").select("agent", "kind", "seq", "at_us", "state", "blocked")


def triage(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", (F.col("l_quantity") / 50).alias("p"), (1 - F.col("l_tax") * 2).alias("m"), F.when(F.col("l_discount") > 0.08, F.array(F.lit("X"))).otherwise(F.array().cast("array<string>")).alias("f"), (F.col("l_tax") * 5).alias("w"), (F.col("l_returnflag") == "R").alias("x"), F.lit(0.5).alias("a"))
    out = d.select("l_suppkey", review.triage(F.col("p"), F.col("m"), F.col("f"), F.col("w"), F.col("x"), F.col("a")).alias("colour"))
    return out.groupBy("l_suppkey", "colour").agg(F.count("*").alias("n"))


def distinct_sources(spark, sf_dir):
    """Distinct parts of a separated column, with their rows."""
    d = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("; "), "lang", F.lit(" ;"), F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise("")).alias("s"))
    return summaries.distinct_parts(d, "s")


def failure_attribution(spark, sf_dir):
    return summaries.attribution(_results(spark, sf_dir))


def motif_sweep(spark, sf_dir):
    motifs = spark.createDataFrame([("DG", "ASP"), ("PPP", "PRO"), ("CYC", "CYS")], "motif string, flag string")
    return review.motif_sweep(seq_hash(spark, sf_dir).select(F.col("doc_id").alias("candidate_id"), "sequence"), motifs)


_DROP = """(SELECT 'P' || l_partkey AS candidate_id, l_orderkey * 10 + l_linenumber AS ingest_order, l_quantity * 2 AS crude, l_discount * 100 AS yield_mg, round(l_extendedprice / 10) AS mass_observed_da,
  CASE WHEN l_linenumber < 6 THEN round(l_extendedprice / 10) + CASE WHEN l_linenumber = 5 THEN 3 ELSE 0 END END AS expected, l_discount * 20 AS solubility_mg_ml, l_tax * 5 AS aggregation_index,
  CASE WHEN l_linenumber <> 3 THEN l_extendedprice END AS kd, CASE WHEN l_linenumber = 3 AND l_tax > 0.04 THEN l_quantity END AS ic50, l_returnflag = 'R' AS censored, l_suppkey AS plate, round(l_extendedprice * 100)::BIGINT AS cents FROM lineitem)"""
_JOIN = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), ';')"
_ERR = "abs(mass_observed_da - coalesce(expected, mass_observed_da))"
_MATCH = f"({_ERR} <= 1.0 OR {_ERR} / greatest(1.0, coalesce(expected, mass_observed_da)) < 0.0005)"
_C1 = f"CASE WHEN NOT {_MATCH} THEN 'SYN_WRONG_MASS' END, CASE WHEN crude < 40 THEN 'SYN_CRUDE_PURITY_LOW' END, CASE WHEN yield_mg < 1 THEN 'SYN_YIELD_LOW' END"
_C2 = "CASE WHEN crude < 90 THEN 'SYN_PURITY_FAIL' END, CASE WHEN solubility_mg_ml < 0.5 THEN 'SOLUBILITY_LOW' END, CASE WHEN aggregation_index > 0.30 THEN 'AGGREGATION_HIGH' END"
_BEYOND = "(censored OR coalesce(kd > 10000, FALSE))"
_NONE = f"(NOT {_BEYOND} AND kd IS NULL AND ic50 IS NULL)"
_PASS3 = f"(NOT {_BEYOND} AND kd IS NOT NULL)"
_POT = f"CASE WHEN {_PASS3} THEN round(-log10(greatest(1e-12, kd * 1e-9::DOUBLE)) * 10.0, 2) ELSE 0.0 END"
_C3 = f"CASE WHEN {_BEYOND} THEN 'ASSAY_NON_BINDER' END, CASE WHEN {_NONE} THEN 'ASSAY_NO_ACTIVITY' END"
_LAST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY ingest_order DESC, mass_observed_da DESC, yield_mg DESC, plate DESC, aggregation_index DESC) AS n FROM {_DROP} AS d) WHERE n = 1)"
_PASS2 = "(crude >= 90 AND solubility_mg_ml >= 0.5 AND aggregation_index <= 0.30)"


_CODES = " UNION ALL ".join(f"SELECT candidate_id, {k} AS st, ingest_order, cents, unnest([{c}]) AS code, unnest(range(3)) AS pos FROM {_DROP} AS d WHERE NOT ({ok})" for k, (c, ok) in enumerate([(f"{_C1}", f"{_MATCH} AND crude >= 40 AND yield_mg >= 1"), (f"{_C2}", _PASS2), (f"{_C3}, NULL", _PASS3)]))
_FLAGS = f"(SELECT candidate_id, string_agg(code, ';' ORDER BY first) AS flags FROM (SELECT candidate_id, code, min((st, ingest_order, cents, pos)) AS first FROM ({_CODES}) WHERE code IS NOT NULL GROUP BY candidate_id, code) GROUP BY candidate_id)"

#: The breaker as recursive SQL: a step takes the next call of every agent. The constants are those of the queries: 40 % of the last 10 calls, at least 5, one day, two canaries.
_BREAKER = """(WITH RECURSIVE c AS (SELECT CAST(user_id AS VARCHAR) AS agent, event_id AS seq, epoch_us(ts) AS tus, value % 1 >= 0.35 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  b AS (SELECT agent, NULL::BIGINT AS seq, NULL::BIGINT AS tus, NULL::BOOLEAN AS ok, 0::BIGINT AS n, 'closed' AS state, 0::BIGINT AS since, 0 AS wins, '' AS past, FALSE AS blocked FROM (SELECT DISTINCT agent FROM c)
    UNION ALL
    SELECT agent, seq, tus, ok, n,
           CASE WHEN blocked THEN st WHEN ok AND st = 'half_open' AND w >= 1 THEN 'closed' WHEN NOT ok AND (st = 'half_open' OR (length(h) >= 5 AND length(replace(h, '1', '')) / length(h) >= 0.4)) THEN 'open' ELSE st END,
           CASE WHEN blocked THEN si WHEN (ok AND st = 'half_open' AND w >= 1) OR (NOT ok AND (st = 'half_open' OR (length(h) >= 5 AND length(replace(h, '1', '')) / length(h) >= 0.4))) THEN tus ELSE si END,
           CASE WHEN NOT blocked AND ok AND st = 'half_open' THEN w + 1 ELSE w END,
           CASE WHEN blocked THEN past WHEN ok AND st = 'half_open' AND w >= 1 THEN '' ELSE h END, blocked
    FROM (SELECT *, st = 'open' AS blocked FROM (
      SELECT c.*, b.past, right(b.past || CASE WHEN c.ok THEN '1' ELSE '0' END, 10) AS h, CASE WHEN b.state = 'open' AND c.tus - b.since >= 86400000000 THEN 'half_open' ELSE b.state END AS st,
             CASE WHEN b.state = 'open' AND c.tus - b.since >= 86400000000 THEN c.tus ELSE b.since END AS si, CASE WHEN b.state = 'open' AND c.tus - b.since >= 86400000000 THEN 0 ELSE b.wins END AS w
      FROM b JOIN c ON c.agent = b.agent AND c.n = b.n + 1)))
  SELECT * FROM b WHERE n > 0)"""


def _rules_sql() -> str:
    has = lambda ps: "(" + " OR ".join(f"contains(t, '{p}')" for p in ps) + ")"
    return ", ".join(f"CASE WHEN {' AND '.join(map(has, lists))} THEN '{code}' END" for code, *lists in results.RULES)


_NARRATIVE = "lower(text || ' ' || ([" + ", ".join(f"'{p}'" for p in PHRASES) + f"])[doc_id % {len(PHRASES)} + 1])"
_FOUND = "list_filter([" + _rules_sql() + "], lambda x: x IS NOT NULL)"
_MODES = f"list_transform(list_filter(range(1, len(f) + 1), lambda i: list_position(f, f[i]) = i), lambda i: f[i])"
_RES = f"(SELECT doc_id AS seq, 'r' || doc_id AS result_id, CASE WHEN doc_id % 20 = 0 THEN 'x' || doc_id ELSE 'c' || (doc_id // 3 + 1) END AS candidate_id, {_MODES} AS modes FROM (SELECT doc_id, {_FOUND} AS f FROM (SELECT doc_id, {_NARRATIVE} AS t FROM documents)))"
_KNOWN = "(SELECT 'c' || c_custkey AS id FROM customer)"


def _recommend_sql() -> str:
    quoted = lambda texts: ", ".join("'" + x.replace("'", "''") + "'" for x in texts)
    cases = " ".join(f"WHEN '{mode}' THEN [{quoted(texts)}]" for mode, texts in review.RECOMMENDATIONS.items())
    flat = f"flatten(list_transform(modes, lambda m: CASE m {cases} ELSE [] END))"
    first = f"list_transform(list_filter(range(1, len({flat}) + 1), lambda i: list_position({flat}, ({flat})[i]) = i), lambda i: ({flat})[i])"
    return f"CASE WHEN len(modes) = 0 THEN {review.ADVANCED!r} WHEN len({flat}) > 0 THEN {first} ELSE {review.UNKNOWN_MODE!r} END"


_REV = f"(SELECT r.*, CASE WHEN len(modes) > 0 THEN 'rejected' ELSE 'advanced' END AS status, {_recommend_sql()} AS recs FROM {_RES} AS r JOIN {_KNOWN} AS k ON r.candidate_id = k.id)"
_STEPS = f"(SELECT step, count(*) AS n, min(seq * 1000 + pos) AS f FROM (SELECT seq, unnest(recs) AS step, unnest(range(len(recs))) AS pos FROM {_REV} AS r) GROUP BY step)"
_RATIONALE = "CASE WHEN status = 'rejected' THEN 'Candidate ' || candidate_id || ' is rejected due to inferred failures (' || array_to_string(modes, ', ') || ') in result ' || result_id || '.' ELSE 'Candidate ' || candidate_id || ' advanced because no failure modes were inferred from result ' || result_id || '.' END"

QUERIES = {f.__name__: f for f in (telemetry_stage1, telemetry_stage2, telemetry_stage3, telemetry_lifecycle, card_stream, telemetry_counts, telemetry_headers, plate_failures, conversion_rate, control_normalised, failure_modes, failure_mode_counts, review_rollup, review_decisions, review_unmatched, next_round_buckets, first_transitions, campaign_decision, closed_loop_check, failure_rate_window, breaker_states, breaker_stream, triage, distinct_sources, failure_attribution, motif_sweep)}
SQL = {
    "telemetry_stage1": f"SELECT candidate_id, ingest_order, plate, mass_observed_da, {_MATCH} AS is_mass_matched, {_JOIN.format(_C1)} AS codes FROM {_DROP} AS d",
    "telemetry_stage2": f"SELECT candidate_id, ingest_order, plate, solubility_mg_ml, {_JOIN.format(_C2)} AS codes FROM {_DROP} AS d",
    "telemetry_stage3": f"SELECT candidate_id, ingest_order, plate, NOT {_BEYOND} AND NOT {_NONE} AS is_binder, {_POT} AS potency, {_JOIN.format(_C3)} AS codes FROM {_DROP} AS d",
    "telemetry_lifecycle": f"""SELECT 'P' || p_partkey AS candidate_id, CASE WHEN l.candidate_id IS NULL THEN 'designed' ELSE 'measured' END AS experiment_state, CASE WHEN l.candidate_id IS NULL THEN 'draft' WHEN {_PASS3} THEN 'evaluated' ELSE 'rejected' END AS status,
      CASE WHEN l.candidate_id IS NOT NULL THEN {_POT} END AS potency, CASE WHEN l.candidate_id IS NULL THEN '' ELSE {_JOIN.format(_C1 + ', ' + _C2 + ', ' + f"CASE WHEN NOT {_PASS3} AND {_BEYOND} THEN 'ASSAY_NON_BINDER' END, CASE WHEN {_NONE} THEN 'ASSAY_NO_ACTIVITY' END")} END AS risk_flags
      FROM part LEFT JOIN {_LAST} AS l ON 'P' || p_partkey = l.candidate_id""",
    "card_stream": f"""SELECT l.candidate_id, 'measured' AS experiment_state, CASE WHEN {_PASS3} THEN 'evaluated' ELSE 'rejected' END AS status, {_POT} AS potency, coalesce(flags, '') AS risk_flags
      FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY ingest_order DESC, cents DESC) AS n FROM {_DROP} AS d) WHERE n = 1) AS l LEFT JOIN {_FLAGS} AS f USING (candidate_id)""",
    "telemetry_counts": f"SELECT count(*) FILTER ({_PASS2}) AS passed_count, count(*) FILTER (NOT {_PASS2}) AS failed_count FROM {_LAST} AS l JOIN part ON 'P' || p_partkey = candidate_id",
    "telemetry_headers": "SELECT l_orderkey AS k, l_linenumber AS line, l_suppkey AS s, CAST(l_partkey AS VARCHAR) AS candidate_id, CASE WHEN l_returnflag = 'R' THEN 7.5 ELSE l_quantity END AS yield_mg, l_linestatus AS operator_x, 3 AS n FROM lineitem",
    "plate_failures": f"SELECT plate, round(avg((NOT {_PASS2})::INT), 6) AS failure_rate, count(*) AS n, avg((NOT {_PASS2})::INT) > 0.5 AS alert FROM {_DROP} AS d GROUP BY plate",
    "conversion_rate": f"SELECT plate, round(avg(ok), 6) AS rate, avg(ok) < 0.70 AS alert FROM (SELECT DISTINCT plate, candidate_id, (candidate_id IN (SELECT candidate_id FROM {_DROP} AS d WHERE {_PASS2}))::INT AS ok FROM {_DROP} AS d) GROUP BY plate",
    "control_normalised": f"SELECT d.plate, round(avg(kd / c), 5) AS mean_ratio, count(kd / c) AS n FROM {_DROP} AS d LEFT JOIN (SELECT plate, avg(kd) AS c FROM {_DROP} AS d WHERE ingest_order % 10 = 1 GROUP BY plate) AS k ON d.plate = k.plate GROUP BY d.plate",
    "failure_modes": f"SELECT result_id, array_to_string(modes, ';') AS failure_modes FROM {_RES} AS r",
    "failure_mode_counts": f"SELECT m AS failure_mode, count(*) AS n FROM (SELECT unnest(modes) AS m FROM {_RES} AS r) GROUP BY m",
    "review_rollup": f"SELECT step, n FROM {_STEPS} AS s",
    "review_decisions": f"SELECT '{CAMPAIGN}-{RUN}-' || candidate_id || '-decision' AS decision_id, result_id, status AS decision, {_RATIONALE} AS rationale, array_to_string(recs, ' ') AS recommendations FROM {_REV} AS r",
    "review_unmatched": f"SELECT 'warning' AS severity, 'RESULT_WITHOUT_CANDIDATE' AS code, count(*) AS n FROM {_RES} AS r WHERE candidate_id NOT IN (SELECT id FROM {_KNOWN} AS k)",
    "next_round_buckets": f"SELECT CASE status WHEN 'advanced' THEN 'advance_for_orthogonal_confirmation' ELSE 'drop_from_active_pool' END AS bucket, count(*) AS n FROM {_REV} AS r GROUP BY 1",
    "first_transitions": f"SELECT candidate_id, 'scored' AS old_status, arg_min(status, seq) AS status FROM {_REV} AS r GROUP BY candidate_id",
    "campaign_decision": f"""SELECT '{CAMPAIGN}-{RUN}-campaign-close-loop-decision' AS decision_id, CASE WHEN a > 0 THEN 'proceed_to_next_round' ELSE 'rework_pool' END AS decision,
      CASE WHEN a > 0 THEN a || '/' || t || ' candidates are advanced in run {RUN}; ' || (t - a) || ' rejected and 0 require rework.' ELSE 'No candidates advanced for {CAMPAIGN} in run {RUN}; ' || (t - a) || ' rejected and the next round should focus on redesign.' END AS rationale,
      (SELECT step FROM {_STEPS} AS s ORDER BY n DESC, f LIMIT 1) AS top_step, (SELECT 'Frequent failure mode: ' || m FROM (SELECT seq, unnest(modes) AS m, unnest(range(len(modes))) AS pos FROM {_REV} AS r) ORDER BY seq, pos LIMIT 1) AS top_risk,
      (SELECT count(DISTINCT m)::INT FROM (SELECT unnest(modes) AS m FROM {_REV} AS r)) AS n_risks FROM (SELECT count(*) AS t, count(*) FILTER (status = 'advanced') AS a FROM {_REV} AS r)""",
    "closed_loop_check": f"SELECT 'error' AS severity, code, n FROM (SELECT 'REVIEW_BLANK_ID' AS code, count(*) AS n FROM {_REV} AS r WHERE seq % 100 = 0 UNION ALL SELECT 'REVIEW_COUNT', 1 UNION ALL SELECT 'DECISION_ID', 1) WHERE n > 0",
    "failure_rate_window": "SELECT CAST(user_id AS VARCHAR) AS agent, event_id AS seq, round(avg((value % 1 < 0.35)::INT) OVER w, 6) AS failure_rate, count(*) OVER w AS n_calls FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)",
    "breaker_states": f"SELECT agent, seq, ok, state, blocked, blocked OR NOT ok AS use_fallback FROM {_BREAKER} AS b",
    "breaker_stream": f"SELECT agent, 'call' AS kind, seq, tus AS at_us, state, blocked FROM {_BREAKER} AS b UNION ALL SELECT agent, 'timer', NULL, tus + 86400000000, 'half_open', FALSE FROM {_BREAKER} AS b WHERE state = 'open' AND NOT blocked",
    "triage": "SELECT l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'red' WHEN l_quantity / 50 >= 0.80 AND 1 - l_tax * 2 >= 0.85 AND l_discount <= 0.08 AND l_tax * 5 <= 0.35 THEN 'green' ELSE 'amber' END AS colour, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "distinct_sources": "SELECT v AS value, count(*) AS n FROM (SELECT source AS v FROM documents UNION ALL SELECT lang FROM documents) GROUP BY v",
    "failure_attribution": f"SELECT cause, count(*) AS n FROM (SELECT DISTINCT seq, CASE WHEN m LIKE 'SYN%' THEN 'synthesis' WHEN m IN ('PURIFICATION_DIFFICULT', 'COELUTING_IMPURITIES', 'ANALYTICAL_AMBIGUITY', 'LCMS_MISMATCH') THEN 'purification' WHEN m IN ('LOW_AQUEOUS_SOLUBILITY', 'PRECIPITATION', 'AGGREGATION') THEN 'solubility' WHEN m IN ('NO_BINDING', 'WEAK_BINDING', 'WRONG_BINDING_SITE') THEN 'binding' WHEN m IN ('MODEL_OVERCONFIDENCE', 'DOCKING_ARTEFACT', 'STRUCTURE_PREDICTION_ARTEFACT', 'DATA_LEAKAGE') THEN 'model' ELSE 'other' END AS cause FROM (SELECT seq, unnest(modes) AS m FROM {_RES} AS r)) GROUP BY cause",
    "motif_sweep": f"SELECT doc_id AS candidate_id, motif, flag FROM {SEQ_HASH} AS t JOIN (VALUES ('DG', 'ASP'), ('PPP', 'PRO'), ('CYC', 'CYS')) AS m(motif, flag) ON contains(sequence, motif)",
}

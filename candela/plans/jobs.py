"""End-to-end jobs over the operators. A job returns its tables; the caller writes them with ``sources.sinks``."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candela.functions import design_rules as D
from candela.functions import scoring as C
from candela.functions import sequence as S
from candela.operators import artifacts, governance, graph, payloads, results, review, telemetry
from candela.operators import events as E
from candela.operators.selection import novelty
from candela.operators.staging import spread, staged
from candela.sources import datasets, sinks


@dataclass
class Round:
    """A scoring round's tables."""

    candidates: DataFrame
    predictions: DataFrame
    assessments: DataFrame
    nodes: DataFrame
    edges: DataFrame
    events: DataFrame


def scored_candidates(candidates: DataFrame) -> DataFrame:
    """Score, flags, design-rule findings and recommendation of each candidate; a hard stop overrides the recommendation, a
    draft becomes scored. One narrow pass."""
    modality = F.col("modality") if "modality" in candidates.columns else None
    flags, score = C.flags_and_score(F.col("sequence"), modality)
    d = D.screened(candidates.withColumns({"__flags": flags, "overall_score": score}))
    own = F.coalesce("risk_flags", F.array().cast("array<string>")) if "risk_flags" in candidates.columns else F.array().cast("array<string>")
    codes = F.transform("violations", lambda v: v["failure_code"])
    d = d.withColumn("risk_flags", F.array_distinct(F.concat(own, F.col("__flags"), codes)))
    d = d.withColumn("recommendation", F.when(F.col("passed_hard_drc"), C.recommendation(F.col("overall_score"))).otherwise("reject_or_redesign_drc_failure"))
    d = d.withColumn("manufacturability_score", F.col("overall_score"))
    status = F.coalesce("status", F.lit("draft")) if "status" in candidates.columns else F.lit("draft")
    return d.withColumn("status", F.when(status == "draft", "scored").otherwise(status)).drop("__flags")


def scoring_round(target: DataFrame, hypothesis: DataFrame, candidates: DataFrame, *, run_id: str, strict: bool = True, preflight: DataFrame | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> Round:
    """Validate, score and record a round. target (target_id, name), hypothesis (hypothesis_id, target_id), each one row;
    candidates (candidate_id, sequence, target_id, hypothesis_id, modality, risk_flags, status, seq).

    Of equal candidate ids the first by seq counts even if it fails (the later ones are rejected). Where the hypothesis
    names another target, candidates that follow the hypothesis are accepted and an event says so.
    """
    t, h = target.first(), hypothesis.first()
    aim = h["target_id"]
    moved = aim != t["target_id"]
    if moved and strict:
        raise E.ValidationFailed(f"hypothesis {h['hypothesis_id']} does not belong to target {t['target_id']}")
    first = F.row_number().over(Window.partitionBy("candidate_id").orderBy("seq"))
    seq = S.normalised(F.col("sequence"))
    verdict = governance.sequence_verdict(seq)
    d = candidates.withColumn("__n", first).withColumn("sequence", seq)
    why = governance.identifier_reason(F.col("candidate_id"))
    checks: list[tuple[Column, str, Column | str]] = [
        (F.col("__n") > 1, "CANDIDATE_DUPLICATE_ID", "duplicate candidate_id"),
        (why.isNotNull(), "CANDIDATE_INVALID_ID", why),
        (~verdict["ok"], "CANDIDATE_INVALID_SEQUENCE", F.concat(F.lit("unsupported residues: "), verdict["invalid"])),
        (F.col("target_id") != aim, "CANDIDATE_TARGET_MISMATCH", "candidate belongs to another target"),
        (F.col("hypothesis_id") != h["hypothesis_id"], "CANDIDATE_HYPOTHESIS_MISMATCH", "candidate belongs to another hypothesis"),
    ]
    events = E.where_true(d, [(c, E.event("error", code, m, row_id=F.col("candidate_id"))) for c, code, m in checks])
    vague = E.where_true(d, [(verdict["ok"] & (verdict["ambiguous"] != ""), E.event("warning", "CANDIDATE_AMBIGUOUS_RESIDUES", "ambiguous residues present", row_id=F.col("candidate_id"), metadata={"residues": verdict["ambiguous"]}))])
    head = [{"severity": "warning", "code": "HYPOTHESIS_TARGET_MISMATCH", "message": f"hypothesis targets {aim}"}] if moved else []
    spark = candidates.sparkSession
    events = E.union(*([preflight] if preflight is not None else []), E.fixed(spark, head), events, vague)
    if strict:
        E.strict(events, "scoring round")
    broken = F.lit(False)
    for c, _, _ in checks:
        broken = broken | F.coalesce(c, F.lit(True))
    good = staged(scored_candidates(d.where(~broken).drop("__n")), "scored")
    pid, aid = F.concat(F.lit(f"{run_id}-"), "candidate_id", F.lit("-prediction")), F.concat(F.lit(f"{run_id}-"), "candidate_id", F.lit("-assessment"))
    predictions = good.select(pid.alias("prediction_id"), "candidate_id", F.lit("heuristic_manufacturability").alias("tool_name"), F.to_json(F.struct("overall_score", "net_charge_ph74", "gravy_index", "passed_hard_drc")).alias("outputs"))
    dims = F.create_map(*(x for k, v in C.dimension_scores(F.col("sequence")).items() for x in (F.lit(k), v)))
    assessments = good.select(aid.alias("assessment_id"), "candidate_id", dims.alias("dimension_scores"), "overall_score", "risk_flags", F.col("suggested_remediations").alias("mitigation_notes"), "recommendation")
    node = lambda i, kind, body: (i.alias("id"), F.lit(kind).alias("node_type"), body.alias("payload"))
    fixed = spark.createDataFrame([(t["target_id"], "target", None), (h["hypothesis_id"], "hypothesis", None)], "id string, node_type string, payload string")
    new_nodes = fixed.unionByName(good.select(*node(F.col("candidate_id"), "candidate", F.to_json(F.struct("sequence", "status"))))).unionByName(good.select(*node(pid, "prediction", F.lit(None).cast("string")))).unionByName(good.select(*node(aid, "assessment", F.lit(None).cast("string"))))
    edge = lambda a, b, kind: (a.alias("source"), b.alias("target"), F.lit(kind).alias("edge_type"))
    c = F.col("candidate_id")
    new_edges = spark.createDataFrame([(t["target_id"], h["hypothesis_id"], "supports")], "source string, target string, edge_type string")
    for e in (good.select(*edge(F.lit(h["hypothesis_id"]), c, "generated")), good.select(*edge(c, pid, "evaluated_by")), good.select(*edge(c, aid, "evaluated_by"))):
        new_edges = new_edges.unionByName(e)
    if nodes is not None and edges is not None:
        new_nodes, new_edges = graph.merge_graph(nodes, edges, new_nodes, new_edges)
    graph.check_acyclic(new_edges)
    return Round(good, predictions, assessments, new_nodes, new_edges, events)


@dataclass
class Review:
    """A result review's tables."""

    reviews: DataFrame
    decision: DataFrame
    next_round: DataFrame
    steps: DataFrame
    transitions: DataFrame
    candidates: DataFrame
    events: DataFrame
    nodes: DataFrame | None = field(default=None)
    edges: DataFrame | None = field(default=None)


def result_review(candidates: DataFrame, found: DataFrame, *, campaign_id: str, run_id: str, strict: bool = True, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> Review:
    """Results (result_id, candidate_id, failure_modes, seq) against candidates (candidate_id, status): decisions,
    roll-ups, the candidates with their new status - of several results the last - and a checked closed loop."""
    r, lost = review.review(found, candidates, campaign_id, run_id)
    if strict and not lost.isEmpty():
        raise E.ValidationFailed("a result names no known candidate")
    r = staged(r, "reviews")
    decision = staged(review.campaign_decision(r, campaign_id, run_id), "decision")
    E.strict(review.consistency_events(r, decision, campaign_id, run_id), "closed loop")
    last = r.groupBy("candidate_id").agg(F.max_by("status", "seq").alias("new_status"))
    updated = candidates.join(last, "candidate_id", "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")
    if nodes is not None and edges is not None:
        more = r.select(F.col("decision_id").alias("id"), F.lit("decision").alias("node_type"), F.to_json(F.struct("decision", "rationale")).alias("payload"), "seq").unionByName(r.select(F.col("result_id").alias("id"), F.lit("result").alias("node_type"), F.lit(None).cast("string").alias("payload"), "seq"))
        links = r.select(F.col("candidate_id").alias("source"), F.col("result_id").alias("target"), F.lit("evaluated_by").alias("edge_type")).unionByName(r.select(F.col("result_id").alias("source"), F.col("decision_id").alias("target"), F.lit("supports").alias("edge_type")))
        nodes, edges = graph.merge(nodes, more, ["id"]).drop("seq"), graph.merge(edges, links.distinct(), ["source", "target"])
        graph.check_acyclic(edges)
    return Review(r, decision, review.next_round(r), review.ranked_counts(r, "recommendations", "step"), review.first_transitions(r), updated, lost, nodes, edges)


def result_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(results, errors) of a folder of result documents, in path order."""
    d = datasets.documents(spark, path)
    return results.ingest(d.withColumn("seq", F.col("path")), "seq")


def telemetry_drop(cards: DataFrame, drop: DataFrame, stage: str) -> tuple[DataFrame, DataFrame]:
    """(cards after the drop, counts). ``drop`` is (ingest_order, fields map)."""
    out = staged(telemetry.apply_drop(cards, telemetry.records(drop), stage), "cards")
    return out, telemetry.counts(out)


def artifact_batch(spark: SparkSession, path: str, kind: str | None = None, mode: str = "reference", out: str | None = None, pattern: str = "*.{json,jsonl}") -> tuple[DataFrame, DataFrame]:
    """(validated artifacts, counts) of a folder of JSON and JSON-lines files; with ``out`` the valid ones are also exported as a bundle
    with manifest and report, to be read again by kind."""
    v = staged(artifacts.validated(datasets.json_payloads(spark, path, pattern=pattern), kind=kind, mode=mode), "artifacts")
    if out:
        sinks.write_bundle(v.where("valid").select("artifact_type", "artifact_id", "payload"), out)
    return v, artifacts.counts(v)


def campaign_report(r: "Review") -> DataFrame:
    """A campaign's report as lines of markdown, in order (line, value): the decision and its rationale, the next round's buckets with their sizes,
    the most frequent steps and the risks. A line a bucket, step and risk."""
    d = r.decision
    head = d.select(F.posexplode(F.array(F.concat(F.lit("# Campaign "), "campaign_id"), F.lit(""), F.concat(F.lit("Decision: "), "decision"), F.concat(F.lit("Rationale: "), "rationale"), F.lit(""), F.lit("## Next round"))).alias("line", "value"))
    buckets = r.next_round.groupBy("bucket").agg(F.count("*").alias("n")).select((F.row_number().over(Window.orderBy("bucket")) + 99).alias("line"), F.concat(F.lit("- "), "bucket", F.lit(": "), F.col("n").cast("string")).alias("value"))  # three buckets
    steps = d.select(F.posexplode("alternatives_considered").alias("line", "value")).select((F.col("line") + 1001).alias("line"), F.concat(F.lit("- "), "value").alias("value"))
    risks = d.select(F.posexplode("risks").alias("line", "value")).select((F.col("line") + 10_001).alias("line"), F.concat(F.lit("- "), "value").alias("value"))
    titles = d.select(F.explode(F.array(F.struct(F.lit(1000).alias("line"), F.lit("## Steps").alias("value")), F.struct(F.lit(10_000).alias("line"), F.lit("## Risks").alias("value")))).alias("t")).select("t.*")
    return head.unionByName(buckets).unionByName(titles).unionByName(steps).unionByName(risks)


def dataset_validation(seed: DataFrame, liability: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, counts) of the seed and the liability dataset, the second checked against the first."""
    spark = seed.sparkSession
    missing = [{"severity": "error", "code": "DATASET_MISSING_REQUIRED_COLUMN", "message": f"[{label}] Missing column: {c}", "location": "header"} for d, cols, label in ((seed, governance.SEED_COLUMNS, "seed"), (liability, governance.LIABILITY_COLUMNS, "liability")) for c in governance.missing_columns(d, cols)]
    events = E.union(E.fixed(spark, missing), governance.seed_rules(seed), governance.liability_rules(liability, seed.select("peptide_id")))
    return events, seed.agg(F.count("*").alias("rows"), F.count_distinct("peptide_id").alias("unique_peptides"))


def next_batch(candidates: DataFrame, *, batch_size: int = 5, weights: tuple[float, float, float] = novelty.WEIGHTS) -> DataFrame:
    """The ranking with its selected batch."""
    return novelty.select_batch(candidates, batch_size, weights)


@dataclass
class Plan:
    """A selection plan: the ranking, the plan's own row, and the graph rows that it adds."""

    rankings: DataFrame
    plan: DataFrame
    nodes: DataFrame
    edges: DataFrame

    @property
    def batch(self) -> DataFrame:
        return self.rankings.where("selected")

    @property
    def backups(self) -> DataFrame:
        return self.rankings.where("not selected")


def selection_plan(candidates: DataFrame, *, campaign_id: str, run_id: str, batch_size: int = 5, weights: tuple[float, float, float] = novelty.WEIGHTS) -> Plan:
    """The next batch as a plan with its policy, selected ids and summary request, and as nodes and edges: every candidate with its
    rank, the ranks informing the plan, the plan requesting a summary. The graph runs one way by construction, and is checked."""
    spark = candidates.sparkSession
    ranking = staged(next_batch(candidates, batch_size=batch_size, weights=weights), "rankings")
    at, prompt = f"{campaign_id}-{run_id}", f"active-learning-scoring-summary-{campaign_id}-{run_id}"
    chosen = [r[0] for r in ranking.where("selected").orderBy("rank").select("candidate_id").collect()]  # batch_size at most
    policy = F.struct(F.lit(batch_size).alias("batch_size"), *(F.lit(w).alias(f"{n}_weight") for n, w in zip(("exploitation", "exploration", "uncertainty"), weights, strict=True)), F.lit("7 points per risk flag, capped at 35").alias("risk_penalty"), F.lit("greedy k-mer Jaccard novelty against selected sequences").alias("diversity_method"))
    plan = spark.range(1).select(F.lit(run_id).alias("run_id"), F.lit(campaign_id).alias("campaign_id"), F.current_timestamp().alias("created_at"), policy.alias("selection_policy"), F.array(*map(F.lit, chosen)).cast("array<string>").alias("selected_candidate_ids"), F.lit(prompt).alias("scoring_summary_prompt_id"))
    rank_id = F.concat(F.lit(f"{at}-"), "candidate_id", F.lit("-active-learning-rank"))
    plan_id = f"{at}-active-learning-plan"
    kind = lambda d, i, t, payload: d.select(i.alias("id"), F.lit(t).alias("node_type"), payload.alias("payload"))
    nodes = kind(candidates, F.col("candidate_id").cast("string"), "peptide_candidate", F.to_json(F.struct(*candidates.columns)))
    nodes = nodes.unionByName(kind(ranking, rank_id, "active_learning_rank", F.to_json(F.struct(*ranking.columns))))
    nodes = nodes.unionByName(kind(plan, F.lit(plan_id), "active_learning_plan", F.to_json(F.struct(*plan.columns))))
    nodes = nodes.unionByName(kind(plan, F.lit(prompt), "prompt_packet", F.to_json(F.struct(F.lit(prompt).alias("packet_id"), F.col("selected_candidate_ids")))))
    edge = lambda d, s, t, e: d.select(s.alias("source"), t.alias("target"), F.lit(e).alias("edge_type"))
    edges = edge(ranking, F.col("candidate_id").cast("string"), rank_id, "ranked_by").unionByName(edge(ranking, rank_id, F.lit(plan_id), "informs")).unionByName(edge(plan, F.lit(plan_id), F.lit(prompt), "requests_summary"))
    graph.check_acyclic(edges)
    return Plan(ranking, plan, nodes, edges)


def repair_then_evaluate(outputs: DataFrame, *, json_col: str = "output", kind_col: str = "artifact", expected: dict[str, str] | None = None, **how) -> DataFrame:
    """Outputs against their contracts, before and after repair, ``expected`` mapping context ids to columns: codes_before, repairs, repaired (JSON), failure_codes, warnings, passed and
    retry_recommended. Fields that repair does not know stay as they are; what is no object is evaluated as it came."""
    want = {k: F.col(v) for k, v in (expected or {}).items()}
    outputs = spread(outputs)
    first = payloads.evaluated(outputs, json_col=json_col, kind_col=kind_col, expected=want, **how).withColumnRenamed("failure_codes", "codes_before").drop("warnings", "passed", "retry_recommended")
    names = [*payloads.CONTEXT_IDS, "sequence", *payloads.SCORES, *payloads.LISTS]
    kept = {c: f"kept_{i}" for i, c in enumerate(first.columns)}
    d = payloads.repaired(first.select(*(F.col(c).alias(k) for c, k in kept.items())), json_col=kept[json_col], expected={k: F.col(kept[v]) for k, v in (expected or {}).items()})
    fixed = F.from_json(F.to_json(F.struct(*(n for n in names if n in d.columns))), "map<string,string>")
    old = F.from_json(F.col(kept[json_col]), "map<string,string>")
    lists = [n for n in payloads.LISTS if n in d.columns]
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~k.isin([*names])), F.map_filter(fixed, lambda k, v: v.isNotNull() & ~k.isin(lists)))
    parts = F.transform(F.map_entries(merged), lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), F.to_json(F.array(e["value"])).substr(F.lit(2), F.length(F.to_json(F.array(e["value"]))) - 2)))
    more = F.array_compact(F.array(*(F.when(F.col(n).isNotNull(), F.concat(F.lit(f'"{n}":'), F.to_json(n))) for n in lists)))
    body = F.when(old.isNull(), F.col(kept[json_col])).otherwise(F.concat(F.lit("{"), F.array_join(F.concat(parts, more), ","), F.lit("}")))
    back = d.select(*(F.col(k).alias(c) for c, k in kept.items()), "repairs", body.alias("repaired"))
    return payloads.evaluated(back, json_col="repaired", kind_col=kind_col, expected=want, **how)


def dialectic_screen(candidates: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Advocate and sceptic scores (own ``affinity`` and ``liability`` columns take part) and the verdict of each candidate."""
    d = D.screened(candidates)
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.cast("double")))
    a, s = D.advocate_score(F.col("sequence")), D.liability_score(F.col("violations"))
    d = d.withColumn("advocate_score", F.coalesce(clip(F.col("affinity")), a) if "affinity" in candidates.columns else a)
    d = d.withColumn("sceptic_score", F.coalesce(clip(F.col("liability")), s) if "liability" in candidates.columns else s)
    motifs = F.transform(F.sequence(F.lit(1), F.greatest(F.length("sequence") - 2, F.lit(1)), F.lit(3)), lambda i: F.substring(F.col("sequence"), i, F.lit(3)))
    return d.withColumn("supporting_motifs", motifs).withColumn("dissensus_delta", F.abs(F.col("advocate_score") - (1.0 - F.col("sceptic_score")))).withColumn("decision", D.verdict(F.col("advocate_score"), F.col("sceptic_score"), F.col("passed_hard_drc"), threshold))


def batch_summary(candidates: DataFrame) -> DataFrame:
    """A line of markdown a candidate, best first."""
    line = F.concat(F.lit("- "), "candidate_id", F.lit(": "), F.format_string("%.1f", "overall_score"), F.lit(" ("), "recommendation", F.lit(")"))
    return candidates.orderBy(F.desc("overall_score"), "candidate_id").select(line.alias("value"))

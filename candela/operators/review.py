"""Result review: status, recommendations, decisions, and the roll-ups of a campaign."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.operators import events as E

# Failure mode and its recommendations, in order.
RECOMMENDATIONS = {
    "SYN_LOW_YIELD": ["Revisit synthesis chemistry and optimize equivalents/reaction conditions.", "Add an alternate synthetic route contingency before rerunning this sequence."],
    "SYN_LOW_CRUDE_PURITY": ["Improve purification design before rerun (extra polishing step or alternate resin).", "Benchmark impurity profile against historical route controls."],
    "SYN_HYDROPHOBIC_SEQUENCE": ["Review hydrophobe burden and consider polar substitutions.", "Run solubility-focused analog redesign before repeating synthesis."],
    "SYN_SEQUENCE_LENGTH_RISK": ["Consider length-optimized truncation/extension experiments.", "Retune design constraints to avoid out-of-distribution sequence lengths."],
    "SYN_CYCLISATION_FAILED": ["Reassess cyclization chemistry and protecting group strategy.", "Explore orthogonal cyclization chemistry for the backup route."],
    "SYN_MODIFICATION_FAILED": ["Verify modification reagents and orthogonal reaction order.", "Retry with a fallback modification route and tighter QC checks."],
    "SYN_SCALE_UP_FAILED": ["Prototype scale-up conditions in staged pilot batches before rerun.", "Split process transfer into stages to isolate bottlenecks."],
    "PURIFICATION_DIFFICULT": ["Design purification handles or alternative cleanup strategy before synthesis.", "Evaluate fast-condition screening for yield/purity tradeoffs."],
    "NO_BINDING": ["Recheck assay controls and replicate measurements.", "Revisit target engagement assumptions and add orthogonal readouts."],
    "WEAK_BINDING": ["Run broader concentration-response series across orthogonal assays.", "Prioritize analogs with improved contact surface and selectivity potential."],
    "NON_SPECIFIC_BINDING": ["Add counter-screening against an off-target panel.", "Refine design constraints for selectivity before next synthesis."],
    "OFF_TARGET_SIGNAL": ["Run a cleaned specificity panel before repeating synthesis.", "Trim motifs linked to known off-target signatures."],
    "NO_FUNCTIONAL_EFFECT": ["Investigate alternate functional readout and timing points.", "Review model system validity and control gating before repeating."],
    "ASSAY_INTERFERENCE": ["Re-run in orthogonal assay chemistry with strengthened controls.", "Collect signal-to-background and blank-corrected baseline first."],
    "LOW_AQUEOUS_SOLUBILITY": ["Improve assay and formulation pre-checks for solubility.", "Screen polar substitutions before rerunning the assay."],
    "AGGREGATION": ["Run pre-assay aggregation diagnostics and adjust assay format.", "Avoid formulation conditions that trigger rapid aggregation."],
    "AGGREGATED_PRODUCT": ["Check peptide handling conditions and storage before rerun.", "Add stabilising workflow guards (shorter hold times, chilled handling)."],
    "PRECIPITATION": ["Investigate buffer composition and concentration envelope changes.", "Re-evaluate formulation conditions before next rerun."],
    "MODEL_OVERCONFIDENCE": ["Tighten uncertainty capture and reduce exploitation pressure.", "Broaden exploration before additional synthesis commitments."],
    "WRONG_BINDING_SITE": ["Validate binding-site assumptions before revisiting design.", "Add binding-site probes to next design batch."],
}
# What is recommended without failure modes, and for modes without a recommendation.
ADVANCED = ["Advance to orthogonal confirmation assays.", "Prioritize the candidate for synthesis and CRO handoff if not complete."]
UNKNOWN_MODE = ["Re-check protocol assumptions and rerun only after controls are tightened."]
# Texts of decision records.
REJECTED_ALTERNATIVES = ["Retest under alternate assay conditions", "Revisit sequence modifications"]
ADVANCED_ALTERNATIVES = ["Broaden orthogonal assay set", "Proceed to CRO confirmation if not already complete"]


def _strings(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def status(modes: Column) -> Column:
    return F.when(F.size(modes) > 0, "rejected").otherwise("advanced")


def recommended(modes: Column, table: dict[str, list[str]] = RECOMMENDATIONS) -> Column:
    """The recommendations of the modes in order, each once; fallbacks where there are none. Narrow: the table is a literal map."""
    known = F.create_map(*(y for mode, texts in table.items() for y in (F.lit(mode), _strings(texts))))
    found = F.array_distinct(F.flatten(F.transform(modes, lambda m: F.coalesce(F.try_element_at(known, m), F.array().cast("array<string>")))))
    return F.when(F.size(modes) == 0, _strings(ADVANCED)).when(F.size(found) > 0, found).otherwise(_strings(UNKNOWN_MODE))


def review(results: DataFrame, candidates: DataFrame, campaign_id: str, run_id: str) -> tuple[DataFrame, DataFrame]:
    """(reviews, events): results (result_id, candidate_id, failure_modes, seq) of known candidates with status,
    recommendations and decision record; results without a candidate become warnings."""
    known = candidates.select(F.col("candidate_id").alias("__id"), F.col("status").alias("old_status"))
    j = results.join(known, F.col("candidate_id") == F.col("__id"), "left")
    lost = j.where("__id is null").select(E.event("warning", "RESULT_WITHOUT_CANDIDATE", F.concat(F.lit("no candidate for result "), "result_id"), row_id=F.col("result_id")).alias("e")).select("e.*")
    modes = F.col("failure_modes")
    d = j.where("__id is not null").drop("__id").withColumn("status", status(modes)).withColumn("recommendations", recommended(modes))
    bad = F.col("status") == "rejected"
    # The sentences of decision records.
    listed = F.coalesce(F.nullif(F.array_join(modes, ", "), F.lit("")), F.lit("none"))
    d = d.withColumns({
        "decision_id": F.concat(F.lit(f"{campaign_id}-{run_id}-"), "candidate_id", F.lit("-decision")),
        "decision": F.col("status"),
        "rationale": F.when(bad, F.concat(F.lit("Candidate "), "candidate_id", F.lit(" is rejected due to inferred failures ("), listed, F.lit(") in result "), "result_id", F.lit("."))).otherwise(F.concat(F.lit("Candidate "), "candidate_id", F.lit(" advanced because no failure modes were inferred from result "), "result_id", F.lit("."))),
        "alternatives_considered": F.concat(F.when(bad, _strings(REJECTED_ALTERNATIVES)).otherwise(_strings(ADVANCED_ALTERNATIVES)), F.col("recommendations")),
        "risks": F.when(bad, F.transform(F.array_sort(F.array_distinct(modes)), lambda m: F.concat(F.lit("Observed failure mode: "), m))).otherwise(F.array(F.lit("Need reproducibility check across replicate batches."))),
    })
    return d, lost


def first_transitions(reviews: DataFrame, order_col: str = "seq") -> DataFrame:
    """The first recorded status change of each candidate."""
    return reviews.groupBy("candidate_id").agg(F.min_by(F.struct("old_status", "status"), order_col).alias("t")).select("candidate_id", "t.*")


def ranked_counts(reviews: DataFrame, array_col: str, name: str, order_col: str = "seq") -> DataFrame:
    """``name``, n and first_seen of the entries of an array column, most frequent first, ties by first appearance. Exploded with its empty
    rows, so that no filter on the array is inferred and pushed below what makes it."""
    e = reviews.select(F.col(order_col).alias("s"), F.posexplode_outer(array_col).alias("pos", name)).where("pos is not null")
    return e.groupBy(name).agg(F.count("*").alias("n"), F.min(F.struct("s", "pos")).alias("first_seen")).orderBy(F.desc("n"), "first_seen")


def status_counts(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("status").agg(F.count("*").alias("n"))


def next_round(reviews: DataFrame) -> DataFrame:
    """A row a reviewed result with its bucket: advance, drop, or (for any other status) retest."""
    bucket = F.when(F.col("status") == "advanced", "advance_for_orthogonal_confirmation").when(F.col("status") == "rejected", "drop_from_active_pool").otherwise("retest_or_rework")
    return reviews.select(bucket.alias("bucket"), "candidate_id", "decision_id", "result_id", "failure_modes", "recommendations")


def campaign_decision(reviews: DataFrame, campaign_id: str, run_id: str) -> DataFrame:
    """One row: decision, rationale, the top three steps and the risks."""
    n = reviews.agg(F.count("*").alias("reviewed"), F.count_if(F.col("status") == "advanced").alias("advanced"), F.count_if(F.col("status") == "rejected").alias("rejected"))
    steps = ranked_counts(reviews, "recommendations", "step").limit(3).agg(F.sort_array(F.collect_list(F.struct(-F.col("n"), "first_seen", "step"))).alias("s")).select(F.transform("s", lambda x: x["step"]).alias("steps"))
    modes = ranked_counts(reviews, "failure_modes", "mode").agg(F.sort_array(F.collect_list(F.struct("first_seen", "mode"))).alias("m")).select(F.transform("m", lambda x: F.concat(F.lit("Frequent failure mode: "), x["mode"])).alias("modes"))  # the ontology bounds them
    c = lambda x: F.col(x).cast("string")
    pending = F.greatest(F.col("reviewed") - F.col("advanced") - F.col("rejected"), F.lit(0))
    # The sentences of campaign decisions.
    at = f"{campaign_id} in run {run_id}"
    rationale = (
        F.when(F.col("reviewed") == 0, f"No candidates were reviewed for {at}; hold and refresh assay inputs before proceeding.")
        .when(F.col("advanced") > 0, F.concat(c("advanced"), F.lit("/"), c("reviewed"), F.lit(f" candidates are advanced in run {run_id}; "), c("rejected"), F.lit(" rejected and "), pending.cast("string"), F.lit(" require rework.")))
        .otherwise(F.concat(F.lit(f"No candidates advanced for {at}; "), c("rejected"), F.lit(" rejected and the next round should focus on redesign.")))
    )
    decision = F.when(F.col("reviewed") == 0, "pause").when(F.col("advanced") > 0, "proceed_to_next_round").otherwise("rework_pool")
    one = n.crossJoin(steps).crossJoin(modes)  # three one-row tables
    return one.select(
        F.lit(f"{campaign_id}-{run_id}-campaign-close-loop-decision").alias("decision_id"), F.lit(campaign_id).alias("campaign_id"), decision.alias("decision"), rationale.alias("rationale"),
        F.when(F.size("steps") > 0, F.col("steps")).otherwise(_strings(["Increase orthogonal assay confirmation before next synthetic run.", "Broaden the redesign strategy before re-pooling."])).alias("alternatives_considered"),
        F.when(F.size("modes") > 0, F.col("modes")).otherwise(_strings(["Unspecified risk mix; require additional assay replication."])).alias("risks"), "reviewed", "advanced", "rejected",
    )


def consistency_events(reviews: DataFrame, decision: DataFrame, campaign_id: str, run_id: str) -> DataFrame:
    """What contradicts a closed loop: blank ids, unknown statuses or decisions, wrong decision ids, counts that differ."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rows = E.where_true(reviews, [(blank(c), E.event("error", "REVIEW_BLANK_ID", f"{c} must be non-empty")) for c in ("candidate_id", "result_id", "decision_id")] + [(~F.col("status").isin("advanced", "rejected"), E.event("error", "REVIEW_STATUS", "status must be advanced or rejected"))])
    total = reviews.agg(F.count("*").alias("n")).crossJoin(decision)
    ends = E.where_true(
        total,
        [
            (F.col("n") != F.col("reviewed"), E.event("error", "REVIEW_COUNT", "count does not match recommendations length")),
            (F.col("campaign_id") != campaign_id, E.event("error", "DECISION_CAMPAIGN", "campaign_id mismatch with recommendation payload")),
            (F.col("decision_id") != f"{campaign_id}-{run_id}-campaign-close-loop-decision", E.event("error", "DECISION_ID", "decision_id mismatch with campaign and run identifiers")),
            (~F.col("decision").isin("proceed_to_next_round", "rework_pool", "pause"), E.event("error", "DECISION_VALUE", "unsupported decision value")),
        ],
    )
    return E.union(rows, ends)


def triage(potency: Column, manufacturability: Column, flags: Column, width: Column, fatal: Column, aggregation: Column, max_width: float = 0.35) -> Column:
    """green, amber or red."""
    red = fatal | (aggregation > 0.90)
    green = (potency >= 0.80) & (manufacturability >= 0.85) & (F.size(flags) == 0) & (width <= max_width)
    return F.when(red, "red").when(green, "green").otherwise("amber")


def motif_sweep(candidates: DataFrame, motifs: DataFrame) -> DataFrame:
    """(candidate_id, motif, flag) of every historical candidate that holds a newly listed motif (motif, flag): substrings of
    the few lengths that motifs have meet them by equality."""
    lengths = sorted(r[0] for r in motifs.select(F.length("motif")).where("motif <> ''").distinct().collect())
    seq, none = F.col("sequence"), F.array().cast("array<string>")
    cut = [F.when(F.length(seq) >= n, F.transform(F.sequence(F.lit(1), F.length(seq) - n + 1), lambda i: F.substring(seq, i, F.lit(n)))).otherwise(none) for n in lengths]  # noqa: B023
    held = candidates.select("candidate_id", F.explode(F.array_distinct(F.concat(none, *cut))).alias("motif"))
    return held.join(motifs, "motif").select("candidate_id", "motif", "flag")

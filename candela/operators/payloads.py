"""Jobs over JSON payload tables: repair, contract evaluation, retries, content addressing, change sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields by treatment, contract kinds with required string fields and typed optional fields.
CONTEXT_IDS = ["target_id", "hypothesis_id", "candidate_id", "campaign_id", "run_id"]
SCORES = ["manufacturability_score", "overall_score", "affinity_score", "liability_score", "confidence"]
SHARES = ["confidence", "affinity_score"]
LISTS = ["risk_flags", "evidence_required", "failure_hypotheses", "acceptance_criteria", "rejection_criteria", "controls"]
CONTRACTS = {
    "target_dossier": (["target_id", "use_case", "rationale"], ["key_constraints", "assay_options", "risks", "unknowns"]),
    "candidate_card": (["candidate_id", "sequence", "target_id", "hypothesis_id", "modality"], ["risk_flags"]),
    "red_team_review": (["candidate_id", "target_id", "hypothesis_id", "critique"], ["risk_flags", "evidence_required", "failure_hypotheses"]),
    "assay_pack": (["candidate_id", "target_id", "hypothesis_id"], ["assay_types", "acceptance_criteria", "rejection_criteria", "controls"]),
    "active_learning_scoring_summary": (["campaign_id", "run_id"], ["selected_candidate_ids", "uncertainty_notes"]),
}
AUDITS = {
    "target_dossier": [("unknowns", "target_dossier should record unknowns or unresolved evidence gaps."), ("risks", "target_dossier should record risks.")],
    "candidate_card": [("risk_flags", "candidate_card has no risk flags; verify this is intentional."), ("manufacturability_score", "candidate_card omitted manufacturability_score.")],
    "red_team_review": [("failure_hypotheses", "red_team_review should include failure_hypotheses."), ("evidence_required", "red_team_review should include evidence_required.")],
    "assay_pack": [("controls", "assay_pack should include controls."), ("rejection_criteria", "assay_pack should include rejection_criteria.")],
    "active_learning_scoring_summary": [("uncertainty_notes", "active_learning_scoring_summary should include uncertainty_notes.")],
}
RETRYABLE = ["EMPTY_OUTPUT", "NON_JSON_OUTPUT", "NON_OBJECT_OUTPUT", "UNSUPPORTED_ARTIFACT_CONTRACT", "SCHEMA_VALIDATION_FAILED", "CONTEXT_ID_MISMATCH"]


def clamped(value: Column, share: bool) -> Column:
    """A score within bounds: negatives become 0, percentages of shares become shares, the rest at most 100."""
    out = F.when(value < 0.0, 0.0)
    if share:
        out = out.when((value > 1.0) & (value <= 100.0), value / 100.0)
    return out.when(value > 100.0, 100.0).otherwise(value)


def clamp_log(name: str, value: Column, share: bool) -> Column:
    """What clamping did, in order: a warning beyond [-10, 150], then the change."""
    text = value.cast("string")
    change = F.when(value < 0.0, F.concat(F.lit(f"Clamped negative '{name}' "), text, F.lit(" to 0.0")))
    if share:
        change = change.when((value > 1.0) & (value <= 100.0), F.concat(F.lit(f"Normalised percentage '{name}' "), text, F.lit(" to "), (value / 100.0).cast("string")))
    change = change.when(value > 100.0, F.concat(F.lit(f"Clamped ceiling on '{name}' "), text, F.lit(" to 100.0")))
    extreme = F.when((value < -10.0) | (value > 150.0), F.concat(F.lit("WARNING: Extreme out-of-bounds value "), text, F.lit(f" detected on '{name}' (potential hallucination)")))
    return F.array_compact(F.array(extreme, change))


def listed(text: Column) -> Column:
    """A comma-separated string as a list, blanks left out."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def repaired(payloads: DataFrame, json_col: str = "payload", expected: dict[str, Column] | None = None) -> DataFrame:
    """Normalised fields of JSON payloads, ``repairs`` and, for scores that are no numbers, ``invalid_fields``.

    ``expected`` maps context ids to columns; a non-null expectation replaces what the payload says.
    """
    d = payloads.withColumn("__v", F.try_parse_json(json_col))
    raw = {k: F.try_variant_get("__v", f"$.{k}", "string").alias(f"__text_{k}") for k in [*CONTEXT_IDS, "sequence", *SCORES, *LISTS]}
    kinds = {k: F.schema_of_variant(F.try_variant_get("__v", f"$.{k}", "variant")).alias(f"__kind_{k}") for k in [*SCORES, *LISTS]}
    lists = {k: F.try_variant_get("__v", f"$.{k}", "array<string>").alias(f"__list_{k}") for k in LISTS}
    wanted = [(expected or {}).get(k, F.lit(None).cast("string")).alias(f"__want_{k}") for k in CONTEXT_IDS]
    # Every field is read once; what follows names columns only.
    d = d.select(*payloads.columns, *raw.values(), *kinds.values(), *lists.values(), *wanted)
    d = d.select("*", *(F.trim(f"__text_{k}").try_cast("double").alias(f"__number_{k}") for k in SCORES))
    get = lambda k: F.col(f"__text_{k}")
    cols, log, bad = {}, [], []
    for k in CONTEXT_IDS:
        want = F.col(f"__want_{k}")
        differs = want.isNotNull() & ~get(k).eqNullSafe(want)
        cols[k] = F.coalesce(want, get(k))
        log.append(F.when(differs, F.array(F.concat(F.lit(f"Injected/aligned context field '{k}' = '"), want, F.lit("'")))))
    seq = F.upper(F.trim(get("sequence")))
    cols["sequence"] = seq
    log.append(F.when(seq != get("sequence"), F.array(F.lit("Normalized sequence (stripped whitespace and uppercased)"))))
    for k in SCORES:
        text, kind, number = get(k), F.col(f"__kind_{k}"), F.col(f"__number_{k}")
        cols[k] = clamped(number, k in SHARES)
        log += [F.when((kind == "STRING") & number.isNotNull(), F.array(F.concat(F.lit(f"Coerced '{k}' from string to float "), number.cast("string")))), F.when(number.isNotNull(), clamp_log(k, number, k in SHARES))]
        bad.append(F.when(text.isNotNull() & number.isNull(), F.lit(k)))
    for k in LISTS:
        kind, as_list = F.col(f"__kind_{k}"), F.col(f"__list_{k}")
        cols[k] = F.when(kind == "STRING", listed(get(k))).when(kind.isNotNull(), F.coalesce(as_list, F.array().cast("array<string>")))
        log.append(F.when(kind == "STRING", F.array(F.concat(F.lit(f"Coerced comma-delimited string '{k}' into list of "), F.size(listed(get(k))).cast("string"), F.lit(" items")))))
    nothing = F.array().cast("array<string>")
    out = d.withColumns(cols | {"repairs": F.flatten(F.array(*(F.coalesce(x, nothing) for x in log))), "invalid_fields": F.array_compact(F.array(*bad))}).withColumn("requires_repair", F.size("invalid_fields") > 0)
    return out.drop(*(c for c in d.columns if c.startswith("__")))


def evaluated(outputs: DataFrame, *, json_col: str = "output", kind_col: str = "artifact", expected: dict[str, Column] | None = None, allowed_ids: Column | None = None, attempt: Column | int = 1, max_attempts: int = 3) -> DataFrame:
    """failure_codes, warnings, passed and retry_recommended of each output against its kind's contract."""
    v, text = F.try_parse_json(F.trim(F.col(json_col))), F.trim(F.coalesce(F.col(json_col), F.lit("")))
    d = outputs.withColumn("__v", v)
    root = F.schema_of_variant("__v")
    is_object = F.coalesce(root.startswith("OBJECT"), F.lit(False))
    get = lambda k, t="string": F.try_variant_get("__v", f"$.{k}", t)
    kind_of = lambda k: F.schema_of_variant(F.try_variant_get("__v", f"$.{k}", "variant"))
    absent = lambda k: F.coalesce(kind_of(k), F.lit("VOID")) == "VOID"
    schema, audit = F.lit(False), F.array().cast("array<string>")
    for kind, (required, lists) in CONTRACTS.items():
        wrong = F.lit(False)
        for k in required:
            wrong = wrong | absent(k) | (kind_of(k) != "STRING")
        for k in lists:
            wrong = wrong | (~absent(k) & ~kind_of(k).startswith("ARRAY"))
        schema = F.when(F.col(kind_col) == kind, wrong).otherwise(schema)
        missing = lambda k: absent(k) | (get(k) == "") | F.coalesce(F.size(get(k, "array<string>")) == 0, F.lit(False))
        audit = F.when(F.col(kind_col) == kind, F.array_compact(F.array(*(F.when(missing(k), F.lit(m)) for k, m in AUDITS[kind])))).otherwise(audit)
    mismatch = F.lit(False)
    for k, want in (expected or {}).items():
        mismatch = mismatch | F.coalesce(get(k) != want, F.lit(False))
    if allowed_ids is not None:
        seen = F.coalesce(get("selected_candidate_ids", "array<string>"), F.array().cast("array<string>"))
        mismatch = mismatch | ((F.col(kind_col) == "active_learning_scoring_summary") & (F.size(F.array_except(seen, allowed_ids)) > 0))
    supported = F.col(kind_col).isin(list(CONTRACTS))
    codes = F.array_compact(F.array(
        F.when(text == "", F.lit("EMPTY_OUTPUT")), F.when((text != "") & F.col("__v").isNull(), F.lit("NON_JSON_OUTPUT")), F.when(F.col("__v").isNotNull() & ~is_object, F.lit("NON_OBJECT_OUTPUT")),
        F.when(is_object & ~supported, F.lit("UNSUPPORTED_ARTIFACT_CONTRACT")), F.when(is_object & supported & schema, F.lit("SCHEMA_VALIDATION_FAILED")), F.when(is_object & mismatch, F.lit("CONTEXT_ID_MISMATCH")),
    ))
    d = d.withColumn("failure_codes", codes).withColumn("warnings", F.when(is_object, audit).otherwise(F.array().cast("array<string>")))
    tries = attempt if isinstance(attempt, Column) else F.lit(attempt)
    return d.withColumn("passed", F.size("failure_codes") == 0).withColumn("retry_recommended", (tries < max_attempts) & F.arrays_overlap("failure_codes", F.array(*(F.lit(x) for x in RETRYABLE)))).drop("__v")


def retry_packets(evaluations: DataFrame, packet_col: str = "packet_id", attempt_col: str = "attempt") -> DataFrame:
    """New packets for the outputs worth another try."""
    n = (F.col(attempt_col) + 1).cast("string")
    return evaluations.where("retry_recommended").select(F.concat(packet_col, F.lit("-retry-"), n).alias("packet_id"), F.col(packet_col).alias("previous_packet_id"), (F.col(attempt_col) + 1).alias("retry_attempt"), "failure_codes", "warnings")


def canonical(json: Column) -> Column:
    """JSON with sorted keys and no blanks; numbers in Spark's own spelling."""
    return F.to_json(F.parse_json(json))


def content_hash(json: Column) -> Column:
    return F.sha2(canonical(json), 256)


def put(objects: DataFrame, store: DataFrame | None, json_col: str = "body") -> DataFrame:
    """(hash, uri, body) of the objects that ``store`` (hash, body) does not hold yet, each once: append them."""
    new = objects.select(content_hash(F.col(json_col)).alias("hash"), canonical(F.col(json_col)).alias("body")).dropDuplicates(["hash"])
    if store is not None:
        new = new.join(store.select("hash"), "hash", "left_anti")
    return new.select("hash", F.concat(F.lit("cas://sha256/"), "hash").alias("uri"), "body")


def get(references: DataFrame, store: DataFrame, uri_col: str = "uri") -> tuple[DataFrame, DataFrame]:
    """(found, missing): references with their bodies; references of another scheme or without an object."""
    r = references.withColumn("hash", F.when(F.col(uri_col).startswith("cas://sha256/"), F.substring_index(uri_col, "/", -1)))
    return r.join(store.select("hash", "body"), "hash"), r.join(store.select("hash"), "hash", "left_anti")


def changes(source: DataFrame, target: DataFrame, key: str = "doc_id", fields: str = "fields") -> DataFrame:
    """Change sets of two snapshots (key, fields map): key, op, path, value of top-level fields added, replaced or removed."""
    a = source.select(key, F.explode(fields).alias("k", "old")).withColumn("in_old", F.lit(True))
    b = target.select(key, F.explode(fields).alias("k", "new")).withColumn("in_new", F.lit(True))
    j = a.join(b, [key, "k"], "full")
    op = F.when(F.col("in_old").isNull(), "add").when(F.col("in_new").isNull(), "remove").when(~F.col("old").eqNullSafe(F.col("new")), "replace")
    return j.withColumn("op", op).where("op is not null").select(key, "op", F.concat(F.lit("/"), "k").alias("path"), F.col("new").alias("value"))


def applied(source: DataFrame, ops: DataFrame, key: str = "doc_id", fields: str = "fields", order_col: str = "pos") -> DataFrame:
    """Snapshots after ordered change sets: of several changes of a path the last wins."""
    last = ops.groupBy(key, F.regexp_extract("path", "^/([^/]+)", 1).alias("k")).agg(F.max_by(F.struct("op", "value"), order_col).alias("c"))
    sets = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.when(F.col("c.op") != "remove", F.struct("k", F.col("c.value"))))).alias("put"), F.collect_list("k").alias("touched"))
    d = source.join(sets, key, "left")
    kept = F.map_filter(fields, lambda k, _: ~F.array_contains(F.coalesce("touched", F.array().cast("array<string>")), k))
    return d.select(*source.columns[: source.columns.index(fields)], F.map_concat(kept, F.coalesce("put", F.create_map().cast(source.schema[fields].dataType))).alias(fields))

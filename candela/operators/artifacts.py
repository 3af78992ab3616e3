"""Artifact files: kind inference, validation against the declared schemas, counts, and packets of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds in the order they are tried with the id and the keys that tell them; required fields; statuses and modalities.
KINDS = {
    "candidate": ("candidate_id", ["sequence", "target_id", "hypothesis_id", "candidate_id"]),
    "hypothesis": ("hypothesis_id", ["hypothesis_id", "target_id", "claim"]),
    "target": ("target_id", ["target_id", "use_case", "rationale"]),
    "experimental_result": ("result_id", ["result_id", "candidate_id", "result_type"]),
    "decision_record": ("decision_id", ["decision_id", "campaign_id", "decision"]),
}
REQUIRED = {
    "target": ["target_id", "name", "organism", "use_case", "rationale"],
    "hypothesis": ["hypothesis_id", "target_id", "claim", "rejection_criteria"],
    "candidate": ["candidate_id", "sequence", "target_id", "hypothesis_id", "modality"],
    "experimental_result": ["result_id", "candidate_id", "result_type"],
    "decision_record": ["decision_id", "campaign_id", "decision", "rationale"],
}
#: The record models are laxer than the schemas: these fields have defaults there, these have none.
DEFAULTED = {"target": ["organism"], "hypothesis": ["rejection_criteria"], "candidate": ["modality"], "experimental_result": [], "decision_record": []}
DEMANDED = {"experimental_result": ["summary", "interpretation"]}
STATUSES = ["draft", "scored", "selected", "tested", "rejected", "advanced", "archived"]
MODALITIES = ["linear", "cyclic", "stapled", "modified", "unknown"]


def _type(v: str | Column, k: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")), F.lit("ABSENT"))


def inferred_kind(v: Column) -> Column:
    """The first kind all of whose keys are there and whose id is a string."""
    out = F.lit(None).cast("string")
    for kind, (ident, keys) in reversed(KINDS.items()):
        cond = _type(v, ident) == "STRING"
        for k in keys:
            cond = cond & (_type(v, k) != "ABSENT")
        out = F.when(cond, kind).otherwise(out)
    return out


def validated(payloads: DataFrame, *, json_col: str = "payload", kind: str | None = None, mode: str = "reference") -> DataFrame:
    """artifact_type, artifact_id, messages and valid of each JSON payload.

    ``reference`` accepts what the record models accept: a field that only the schema requires may be missing. ``schema``
    rejects it.
    """
    d = payloads.withColumn("__v", F.try_parse_json(json_col))
    v = F.col("__v")
    d = d.withColumn("artifact_type", F.lit(kind) if kind else inferred_kind(v))
    ident, messages = F.lit(None).cast("string"), F.array().cast("array<string>")
    for k, fields in REQUIRED.items():
        needed = [f for f in fields if mode == "schema" or f not in DEFAULTED[k]] + (DEMANDED.get(k, []) if mode == "reference" else [])
        found = F.array_compact(F.array(
            *(F.when(_type(v, f) == "ABSENT", F.lit(f"{f}: field required")) for f in needed),
            *(F.when(~_type(v, f).isin("ABSENT", "STRING") & F.lit(f != "rejection_criteria"), F.lit(f"{f}: must be a string")) for f in fields),
            *([F.when(~F.coalesce(F.try_variant_get(v, "$.modality", "string"), F.lit("unknown")).isin(MODALITIES), F.lit("modality: not an allowed value")), F.when(~F.coalesce(F.try_variant_get(v, "$.status", "string"), F.lit("draft")).isin(STATUSES), F.lit("status: not an allowed value"))] if k == "candidate" else []),
        ))
        ident = F.when(F.col("artifact_type") == k, F.try_variant_get(v, f"$.{KINDS[k][0]}", "string")).otherwise(ident)
        messages = F.when(F.col("artifact_type") == k, found).otherwise(messages)
    messages = F.when(v.isNull(), F.array(F.lit("invalid JSON"))).when(F.col("artifact_type").isNull(), F.array(F.lit("unknown artifact kind"))).otherwise(messages)
    return d.withColumn("artifact_id", ident).withColumn("messages", messages).withColumn("valid", F.size("messages") == 0).drop("__v")


def counts(validated_: DataFrame) -> DataFrame:
    return validated_.groupBy("artifact_type").agg(F.count_if("valid").alias("valid_count"), F.count_if(~F.col("valid")).alias("invalid_count"))


def template_table(spark: SparkSession) -> DataFrame:
    """The packets a candidate gets: (agent, artifact)."""
    return spark.createDataFrame([("candidate_generation_agent", "candidate_card"), ("red_team_agent", "red_team_review"), ("assay_planning_agent", "assay_pack")], "agent string, artifact string")


def packets(target: DataFrame, candidates: DataFrame, run_id: str) -> DataFrame:
    """One dossier packet a target and three packets a candidate: (packet_id, agent, artifact, input_payload)."""
    spark = candidates.sparkSession
    dossier = target.select(F.concat(F.lit(f"{run_id}-"), "target_id", F.lit("-target_dossier")).alias("packet_id"), F.lit("target_biology_agent").alias("agent"), F.lit("target_dossier").alias("artifact"), F.to_json(F.struct(F.struct(*target.columns).alias("target"))).alias("input_payload"))
    each = candidates.crossJoin(F.broadcast(template_table(spark)))  # three templates
    payload = F.to_json(F.struct(F.struct(*candidates.columns).alias("candidate")))
    return dossier.unionByName(each.select(F.concat(F.lit(f"{run_id}-"), "candidate_id", F.lit("-"), "artifact").alias("packet_id"), "agent", "artifact", payload.alias("input_payload")))


def packet_manifest(packets_: DataFrame) -> DataFrame:
    return packets_.agg(F.count("*").alias("packet_count"), F.array_sort(F.collect_set("agent")).alias("agents"))

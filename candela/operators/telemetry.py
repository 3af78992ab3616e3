"""Staged laboratory telemetry: header canonicalisation, the three stage gates, and card transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.binding import let

# Canonical fields and the vendor headers that mean them.
ALIASES = {
    "candidate_id": ["candidate_id", "candidateid", "id", "peptide_id", "name", "sample_id"],
    "crude_purity_pct": ["crude_purity", "crude_purity_pct", "crude_purity_%", "crude_purity(%)", "purity_crude"],
    "purified_purity_pct": ["purified_purity", "purified_purity_pct", "purity", "purity_%", "hplc_purity", "purity_pct"],
    "yield_mg": ["yield", "yield_mg", "yield_(mg)", "mass_yield_mg"],
    "mass_observed_da": ["mass_obs", "mass_observed", "observed_mass", "mw_obs", "m_obs"],
    "mass_expected_da": ["mass_exp", "mass_expected", "expected_mass", "mw_exp", "calc_mw", "m_exp"],
    "solubility_mg_ml": ["solubility", "solubility_mg_ml", "solubility_(mg/ml)", "sol_mg_ml"],
    "aggregation_index": ["aggregation", "aggregation_index", "agg_index", "agg_score"],
    "dls_polydispersity": ["dls_pdi", "pdi", "polydispersity", "dls_polydispersity"],
    "kd_nm": ["kd", "kd_nm", "kd_(nm)", "affinity_kd_nm"],
    "kon_1_ms": ["kon", "kon_1_ms", "k_on", "kon_(1/ms)"],
    "koff_1_s": ["koff", "koff_1_s", "k_off", "koff_(1/s)"],
    "ic50_nm": ["ic50", "ic50_nm", "ic50_(nm)"],
    "censored": ["censored", "is_censored", "above_detection_limit", "censored_above_limit"],
}
STAGES = ("stage_1_crude_lcms", "stage_2_purified_qc", "stage_3_bioassay")
# What a field counts as where a record lacks it; the expected mass falls back to the observed one.
DEFAULTS = {"crude_purity_pct": 50.0, "yield_mg": 5.0, "mass_observed_da": 1000.0, "purified_purity_pct": 95.0, "solubility_mg_ml": 2.0, "aggregation_index": 0.05, "dls_polydispersity": 0.12}


def canonical_keys(fields: Column) -> Column:
    """A map of raw headers to values with canonical keys: headers trimmed, lower-cased, spaces as underscores, known ones
    renamed, blank values dropped; of two headers for one field the later wins."""
    to = F.create_map(*(F.lit(x) for k, names in ALIASES.items() for a in names for x in (a, k)))
    entries = F.filter(F.map_entries(fields), lambda e: F.coalesce(F.trim(e["value"].cast("string")), F.lit("")) != "")
    named = F.transform(entries, lambda e: F.struct(F.replace(F.lower(F.trim(e["key"])), F.lit(" "), F.lit("_")).alias("key"), e["value"].alias("value")))
    named = F.transform(named, lambda e: F.struct(F.coalesce(F.try_element_at(to, e["key"]), e["key"]).alias("key"), e["value"].alias("value")))
    return let(named, lambda all_: F.map_from_entries(F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda o: o["key"] == e["key"]))))


def records(drop: DataFrame, fields_col: str = "fields") -> DataFrame:
    """A drop's rows as canonical columns, numbers as doubles, with ``defaulted_fields``."""
    m = canonical_keys(F.col(fields_col))
    d = drop.withColumn("__m", m)
    value = lambda k: F.try_element_at("__m", F.lit(k))
    numbers = [k for k in ALIASES if k not in ("candidate_id", "censored")]
    keep = [c for c in drop.columns if c != fields_col and c not in ALIASES]
    missing = F.array_compact(F.array(*(F.when(value(k).isNull(), F.lit(k)) for k in [*DEFAULTS, "mass_expected_da"])))
    return d.select(*keep, value("candidate_id").alias("candidate_id"), *(value(k).try_cast("double").alias(k) for k in numbers), value("censored").alias("censored"), missing.alias("defaulted_fields"))


def _codes(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(cond, F.lit(code)) for cond, code in rules)))


def _or_default(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(DEFAULTS[name]))


def stage1(tolerance_da: float | Column = 1.0) -> dict[str, Column]:
    """Mass error and match, failure codes and verdict of crude material. ``tolerance_da`` may depend on the row."""
    observed = _or_default("mass_observed_da")
    expected = F.coalesce(F.col("mass_expected_da"), observed)
    error = F.abs(observed - expected)
    matched = (error <= tolerance_da) | (error / F.greatest(F.lit(1.0), expected) < 0.0005)
    codes = _codes((~matched, "SYN_WRONG_MASS"), (_or_default("crude_purity_pct") < 40.0, "SYN_CRUDE_PURITY_LOW"), (_or_default("yield_mg") < 1.0, "SYN_YIELD_LOW"))
    return {"mass_error_da": F.round(error, 3), "is_mass_matched": matched, "failure_codes": codes, "passed": F.size(codes) == 0}


def stage2() -> dict[str, Column]:
    codes = _codes(
        (_or_default("purified_purity_pct") < 90.0, "SYN_PURITY_FAIL"),
        (_or_default("solubility_mg_ml") < 0.5, "SOLUBILITY_LOW"),
        ((_or_default("aggregation_index") > 0.30) | (_or_default("dls_polydispersity") > 0.30), "AGGREGATION_HIGH"),
    )
    return {"failure_codes": codes, "passed": F.size(codes) == 0}


def stage3() -> dict[str, Column]:
    """Binder verdict and potency; passed means a binder with a measured Kd."""
    kd, censored = F.col("kd_nm"), F.coalesce(F.lower(F.col("censored").cast("string")).isin("true", "1", "yes"), F.lit(False))
    beyond = censored | F.coalesce(kd > 10000.0, F.lit(False))
    none = ~beyond & kd.isNull() & F.col("ic50_nm").isNull()
    binder = ~beyond & ~none
    passed = binder & kd.isNotNull()
    potency = F.when(passed, F.round(-F.log10(F.greatest(F.lit(1e-12), kd * 1e-9)) * 10.0, 2)).otherwise(0.0)
    return {"is_binder": binder, "potency": potency, "failure_codes": _codes((beyond, "ASSAY_NON_BINDER"), (none, "ASSAY_NO_ACTIVITY")), "passed": passed}


def gate(stage: str) -> dict[str, Column]:
    return {STAGES[0]: stage1, STAGES[1]: stage2, STAGES[2]: stage3}[stage]()


def last_of_each(records_: DataFrame, order_col: str) -> DataFrame:
    """The last record of each candidate in a drop."""
    w = Window.partitionBy("candidate_id").orderBy(F.desc(order_col))
    return records_.where("candidate_id is not null").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def apply_drop(cards: DataFrame, drop: DataFrame, stage: str, *, order_col: str = "ingest_order", enforce_order: bool = False) -> DataFrame:
    """Cards (candidate_id, experiment_state, status, potency, risk_flags, ...) after a drop of canonical records; cards
    without a record stay, records without a card are ignored. ``log`` tells what happened to a card, else null.

    With ``enforce_order`` a failed card takes no later stage.
    """
    g = gate(stage)
    r = last_of_each(drop, order_col)
    r = r.select(F.col("candidate_id").alias("__id"), g["passed"].alias("__ok"), g["failure_codes"].alias("__codes"), (g["potency"] if stage == STAGES[2] else F.lit(None).cast("double")).alias("__potency"))
    d = cards.join(r, F.col("candidate_id") == F.col("__id"), "left")
    hit = F.col("__id").isNotNull()
    if enforce_order:
        hit = hit & ~F.coalesce(F.col("experiment_state") == "failed", F.lit(False))
    ok, third = F.col("__ok"), stage == STAGES[2]
    state = F.lit("measured") if third else F.when(ok, "in_flight_assay").otherwise("failed")
    status = F.when(~ok, "rejected").otherwise("evaluated" if third else F.col("status"))
    flags = F.array_distinct(F.concat(F.coalesce("risk_flags", F.array().cast("array<string>")), F.when(ok, F.array().cast("array<string>")).otherwise(F.col("__codes"))))
    out = {
        "experiment_state": F.when(hit, state).otherwise(F.col("experiment_state")),
        "status": F.when(hit, status).otherwise(F.col("status")),
        "potency": F.when(hit, F.col("__potency") if third else F.col("potency")).otherwise(F.col("potency")),
        "risk_flags": F.when(hit, flags).otherwise(F.col("risk_flags")),
        "log": F.when(hit, F.concat(F.lit("["), "candidate_id", F.lit(f"] {stage} "), F.when(ok, F.lit("passed")).otherwise(F.concat(F.lit("failed: "), F.array_join("__codes", ", "))))),
    }
    return d.withColumns(out).drop("__id", "__ok", "__codes", "__potency")


def counts(applied: DataFrame) -> DataFrame:
    """passed_count and failed_count of the cards a drop touched."""
    return applied.where("log is not null").agg(F.count_if(F.col("status") != "rejected").alias("passed_count"), F.count_if(F.col("status") == "rejected").alias("failed_count"))


def conversion_rate(records1: DataFrame, records2: DataFrame, by: str, alert_below: float = 0.70) -> DataFrame:
    """Share of crude-stage candidates that reached a passing purified stage, a row a group, with an alert."""
    a = records1.select(by, "candidate_id").distinct()
    b = records2.where(stage2()["passed"]).select(F.col("candidate_id").alias("__id")).distinct()
    g = a.join(b, F.col("candidate_id") == F.col("__id"), "left").groupBy(by).agg(F.avg(F.col("__id").isNotNull().cast("double")).alias("rate"))
    return g.withColumn("alert", F.col("rate") < alert_below)


def plate_failures(measured: DataFrame, plate_col: str, failed: Column, most: float = 0.5) -> DataFrame:
    """Failure rate a plate, and whether more than ``most`` of it failed."""
    return measured.groupBy(plate_col).agg(F.avg(failed.cast("double")).alias("failure_rate"), F.count("*").alias("n")).withColumn("alert", F.col("failure_rate") > most)


def control_normalised(measured: DataFrame, controls: DataFrame, batch_col: str, value_col: str) -> DataFrame:
    """``ratio`` of each value to the mean of its batch's controls."""
    c = controls.groupBy(batch_col).agg(F.avg(value_col).alias("__control"))
    return measured.join(c, batch_col, "left").withColumn("ratio", F.col(value_col) / F.nullif(F.col("__control"), F.lit(0.0))).drop("__control")

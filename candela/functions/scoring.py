"""Manufacturability scoring and selection scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from candela.functions import sequence as S


def flags_and_score(seq: Column, modality: Column | None = None) -> tuple[Column, Column]:
    """(risk_flags, overall_score): points come off 100 for each flag that applies, in a fixed order; within [0, 100]."""
    f = S.basic_features(seq)
    length, hydro, charge = f["length"], f["hydrophobic_fraction"], F.abs(f["net_charge_proxy"])
    # Flag, points, condition
    rules = [
        ("SEQUENCE_LENGTH_RISK", 15, length > 35),
        ("LONG_PEPTIDE_HIGH_COMPLEXITY", 20, length > 50),
        ("HYDROPHOBIC_AGGREGATION_RISK", 20, hydro > 0.45),
        ("VERY_LOW_HYDROPHOBICITY_CHECK_BINDING_PLAUSIBILITY", 5, hydro < 0.15),
        ("HIGH_NET_CHARGE_RISK", 10, charge > 6),
        ("OXIDATION_LIABILITY", 8, f["oxidation_count"] >= 3),
        ("DEAMIDATION_LIABILITY", 8, f["deamidation_count"] >= 3),
        ("CYSTEINE_PAIRING_COMPLEXITY", 10, ~f["cysteine_count"].isin(0.0, 2.0, 4.0)),
        ("MODIFICATION_COMPLEXITY_REVIEW", 5, (F.lit("linear") if modality is None else modality).isin("cyclic", "stapled", "modified")),
    ]
    score = F.lit(100.0)
    for _, points, when in rules:
        score = score - F.when(when, float(points)).otherwise(0.0)
    flags = F.array_compact(F.array(*(F.when(when, F.lit(name)) for name, _, when in rules)))
    some = F.length(S.clean(seq)) > 0
    return F.when(some, flags), F.when(some, F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))


def recommendation(score: Column) -> Column:
    return F.when(score >= 80, "test_or_keep").when(score >= 60, "revise_or_test_with_caution").when(score.isNotNull(), "revise_before_testing")


def dimension_scores(seq: Column) -> dict[str, Column]:
    f = S.basic_features(seq)
    least0 = lambda c: F.greatest(F.lit(0.0), c)
    return {
        "length_risk": least0(100.0 - least0(f["length"] - 35) * 2),
        "hydrophobicity_risk": least0(100.0 - least0(f["hydrophobic_fraction"] - 0.45) * 200),
        "charge_risk": least0(100.0 - least0(F.abs(f["net_charge_proxy"]) - 6) * 8),
        "oxidation_risk": least0(100.0 - f["oxidation_count"] * 5),
        "deamidation_risk": least0(100.0 - f["deamidation_count"] * 5),
        "cysteine_complexity_risk": least0(100.0 - f["cysteine_count"] * 4),
    }


def novelty(max_similarity: Column) -> Column:
    """100 where there is nothing to compare with (null)."""
    return F.when(max_similarity.isNull(), 100.0).otherwise(F.round((1.0 - max_similarity) * 100.0, 3))


def uncertainty(score: Column, flags: Column) -> Column:
    """Highest near the decision boundary of 70, with a bonus for flags."""
    return F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 - F.abs(score - 70.0) * 2.0) + F.least(F.lit(15.0), F.size(flags) * 5.0)), 3)


def risk_penalty(flags: Column) -> Column:
    return F.least(F.lit(35.0), F.size(flags) * 7.0)


def priority(score: Column, novelty_score: Column, uncertainty_score: Column, penalty: Column, weights: tuple[float, float, float] = (0.55, 0.30, 0.15)) -> Column:
    if min(weights) < 0:
        raise ValueError("selection weights must not be negative")
    a, b, c = weights
    return F.round(a * score + b * novelty_score + c * uncertainty_score - penalty, 3)


def weighted_profile(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of the dimension scores that have a weight."""
    out = F.lit(0.0)
    for k, w in weights.items():
        out = out + scores[k] * w
    return out / sum(weights.values())

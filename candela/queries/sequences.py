"""Sequence descriptors, scores, design rules and verdicts over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from candela.functions import design_rules as D
from candela.functions import scoring as C
from candela.functions import sequence as S
from candela.operators.staging import staged
from candela.queries.tables import SEQ_HASH, SEQ_RAW, SEQ_TEXT, count_sql, seq_hash, seq_raw, seq_text


def flagship(spark, sf_dir):
    """Score, flags and design-rule stops of every candidate, best first."""
    d = screened(spark, sf_dir)
    flags, score = C.flags_and_score(F.col("sequence"))
    d = d.select("doc_id", "sequence", score.alias("overall_score"), F.array_join(flags, ";").alias("risk_flags"), "passed_hard_drc", F.when(F.col("passed_hard_drc"), C.recommendation(score)).otherwise("reject_or_redesign_drc_failure").alias("recommendation"))
    d = staged(d, "flagship")  # the sort samples its input: the scores are not computed twice
    return d.orderBy(F.desc("passed_hard_drc"), F.desc("overall_score"), "doc_id")


def basic_features(spark, sf_dir):
    f = S.basic_features(F.col("sequence"))
    f["hydrophobic_fraction"] = F.round(f["hydrophobic_fraction"], 6)
    return seq_text(spark, sf_dir).select("doc_id", *(v.alias(k) for k, v in f.items()))


def curation_features(spark, sf_dir):
    return seq_text(spark, sf_dir).select("doc_id", *(v.alias(k) for k, v in S.curation_features(F.col("sequence")).items()))


def manufacturability_score(spark, sf_dir):
    flags, score = C.flags_and_score(F.col("sequence"))
    return seq_hash(spark, sf_dir).select("doc_id", F.array_join(flags, ";").alias("risk_flags"), score.alias("overall_score"), C.recommendation(score).alias("recommendation"))


def dimension_scores(spark, sf_dir):
    return seq_hash(spark, sf_dir).select("doc_id", *(F.round(v, 5).alias(k) for k, v in C.dimension_scores(F.col("sequence")).items()))


def net_charge_gravy(spark, sf_dir):
    s = F.col("sequence")
    return seq_hash(spark, sf_dir).select("doc_id", F.round(S.net_charge(s), 5).alias("net_charge"), F.round(S.gravy(s), 8).alias("gravy"))


def _violations(violations):
    out = F.transform(violations, lambda v: F.concat_ws("|", v["rule_id"], v["severity"], v["culprit_motif"], F.array_join(v["positions"], ",")))
    return F.array_join(out, ";")


def drc_motifs(spark, sf_dir):
    s = F.col("sequence")
    return seq_hash(spark, sf_dir).select("doc_id", F.explode(D.motif_violations(s)).alias("v")).select("doc_id", F.col("v.culprit_motif").alias("motif"), F.col("v.severity").alias("severity"), F.col("v.positions")[0].alias("position"))


def drc_runs(spark, sf_dir):
    s = F.col("sequence")
    return seq_hash(spark, sf_dir).select("doc_id", F.explode(F.concat(D.run_violations(s), D.proline_violations(s))).alias("v")).select("doc_id", F.col("v.rule_id").alias("rule_id"), F.col("v.culprit_motif").alias("motif"))


def screened(spark, sf_dir):
    return D.screened(seq_hash(spark, sf_dir))


def drc_summary(spark, sf_dir):
    v = F.col("violations")
    n = lambda level: F.size(F.filter(v, lambda x: x["severity"] == level)).alias(f"n_{level}")
    return screened(spark, sf_dir).select("doc_id", "passed_hard_drc", n("fatal"), n("high_risk"), n("warning"), F.size("suggested_remediations").alias("n_remediations"), F.round("net_charge_ph74", 3).alias("net_charge_ph74"), F.round("gravy_index", 8).alias("gravy_index"))


def rule_screening(spark, sf_dir):
    """Design rules over a sequence of every lineitem: how many pass, by findings."""
    from candela.queries.tables import hashed, table

    d = D.counted(table(spark, sf_dir, "lineitem").select(hashed(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sequence")))
    return d.groupBy("passed_hard_drc", "n_fatal", "n_high_risk", "n_warning").agg(F.count("*").alias("n"))


def drc_violations(spark, sf_dir):
    """Every violation with its motif and positions, as text."""
    return screened(spark, sf_dir).select("doc_id", _violations(F.col("violations")).alias("violations"), F.array_join("hard_stop_reasons", "; ").alias("hard_stop_reasons"))


def dialectic_verdict(spark, sf_dir):
    d = screened(spark, sf_dir).withColumn("advocate_score", F.round(D.advocate_score(F.col("sequence")), 6)).withColumn("sceptic_score", D.liability_score(F.col("violations")))
    return d.select("doc_id", "advocate_score", "sceptic_score", F.round(F.abs(F.col("advocate_score") - (1.0 - F.col("sceptic_score"))), 6).alias("dissensus_delta"), D.verdict(F.col("advocate_score"), F.col("sceptic_score"), F.col("passed_hard_drc")).alias("decision"))


def feature_vectors(spark, sf_dir):
    d = seq_hash(spark, sf_dir).select("doc_id", F.posexplode(S.feature_vector(F.col("sequence"))).alias("dim", "value"))
    return d.select("doc_id", "dim", F.round("value", 6).alias("value"))


def selection_scores(spark, sf_dir):
    flags, score = C.flags_and_score(F.col("sequence"))
    d = seq_hash(spark, sf_dir).select("doc_id", flags.alias("f"), score.alias("s"))
    u, p = C.uncertainty(F.col("s"), F.col("f")), C.risk_penalty(F.col("f"))
    return d.select("doc_id", F.col("s").alias("manufacturability_score"), u.alias("uncertainty_score"), p.alias("risk_penalty"), C.priority(F.col("s"), F.lit(100.0), u, p).alias("priority_score"))


def weighted_profile(spark, sf_dir):
    w = {"length_risk": 0.2, "hydrophobicity_risk": 0.3, "charge_risk": 0.2, "oxidation_risk": 0.15, "deamidation_risk": 0.15}
    return seq_hash(spark, sf_dir).select("doc_id", F.round(C.weighted_profile(C.dimension_scores(F.col("sequence")), w), 5).alias("profile"))


def residue_validation(spark, sf_dir):
    from candela.operators.governance import sequence_verdict

    v = sequence_verdict(F.col("sequence"))
    return seq_raw(spark, sf_dir).select("doc_id", v["ambiguous"].alias("ambiguous"), v["invalid"].alias("invalid"), v["ok"].alias("ok"))


def curation_gates(spark, sf_dir):
    f = S.curation_features(F.col("sequence"))
    gates = [("AROMATIC", f["aromatic_count"] > 8), ("HYDROPHOBIC", f["hydrophobic_fraction"] > 0.6), ("CYSTEINE", f["cysteine_count"] >= 4)]
    return seq_hash(spark, sf_dir).select("doc_id", F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in gates))), ";").alias("gates"))


_N = "length(sequence)"
_H = f"({count_sql(S.HYDROPHOBIC)} / nullif({_N}, 0)::DOUBLE)"
_CH = f"({count_sql('KRH')} - {count_sql('DE')})"
_OX, _DE, _CY = count_sql("MWC"), count_sql("NQ"), count_sql("C")
_RULES = [
    ("SEQUENCE_LENGTH_RISK", 15, f"{_N} > 35"),
    ("LONG_PEPTIDE_HIGH_COMPLEXITY", 20, f"{_N} > 50"),
    ("HYDROPHOBIC_AGGREGATION_RISK", 20, f"{_H} > 0.45"),
    ("VERY_LOW_HYDROPHOBICITY_CHECK_BINDING_PLAUSIBILITY", 5, f"{_H} < 0.15"),
    ("HIGH_NET_CHARGE_RISK", 10, f"abs({_CH}) > 6"),
    ("OXIDATION_LIABILITY", 8, f"{_OX} >= 3"),
    ("DEAMIDATION_LIABILITY", 8, f"{_DE} >= 3"),
    ("CYSTEINE_PAIRING_COMPLEXITY", 10, f"{_CY} NOT IN (0, 2, 4)"),
]
_FLAGS = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, _, c in _RULES) + "], lambda x: x IS NOT NULL)"
_SCORE = "(100.0::DOUBLE" + "".join(f" - CASE WHEN {c} THEN {p} ELSE 0 END" for _, p, c in _RULES) + ")"
_DIMS = {
    "length_risk": f"greatest(0, 100 - greatest(0, {_N} - 35) * 2)::DOUBLE",
    "hydrophobicity_risk": f"greatest(0.0, 100.0 - greatest(0.0, {_H} - 0.45) * 200)",
    "charge_risk": f"greatest(0, 100 - greatest(0, abs({_CH}) - 6) * 8)::DOUBLE",
    "oxidation_risk": f"greatest(0, 100 - {_OX} * 5)::DOUBLE",
    "deamidation_risk": f"greatest(0, 100 - {_DE} * 5)::DOUBLE",
    "cysteine_complexity_risk": f"greatest(0, 100 - {_CY} * 4)::DOUBLE",
}
_ENDS, _EACH = S.charge_terms(7.4)
_CHARGE = f"({_ENDS!r}::DOUBLE" + "".join(f" + {count_sql(a)} * ({w!r}::DOUBLE)" for a, w in _EACH.items()) + ")"
_GRAVY = "(CASE WHEN length(sequence) > 0 THEN (0.0::DOUBLE" + "".join(f" + {count_sql(a)} * ({w!r}::DOUBLE)" for a, w in S.HYDROPATHY.items()) + ") / length(sequence) ELSE 0.0 END)"
_MOTIFS = "list_filter(range(1, length(sequence)), lambda i: regexp_full_match(substr(sequence, i, 2), 'D[GSN]'))"
_COUNTED = f"""(SELECT doc_id, sequence, {_CHARGE} AS charge, {_GRAVY} AS gravy,
  len(list_filter({_MOTIFS}, lambda i: substr(sequence, i, 2) = 'DG')) AS dg, len({_MOTIFS}) AS motifs,
  len(regexp_extract_all(sequence, '[VILFYW]{{5,}}')) AS runs, len(regexp_extract_all(sequence, 'P{{3,}}')) AS pro, {_CY} % 2 AS odd
  FROM {SEQ_HASH} AS t)"""
_DRC = f"""(SELECT doc_id, sequence, charge, gravy, dg + runs + CASE WHEN prec AND gravy > 0.6 THEN 1 ELSE 0 END AS n_fatal,
  motifs - dg + CASE WHEN prec AND gravy <= 0.6 THEN 1 ELSE 0 END + odd AS n_high_risk, pro AS n_warning,
  (motifs > 0)::INT + (runs > 0)::INT + prec::INT + odd AS n_remediations
  FROM (SELECT *, abs(charge) < 0.5 AND gravy > 0.3 AS prec FROM {_COUNTED} AS c))"""
_FEATS = "[" + ", ".join(f"{count_sql(a)} / {_N}::DOUBLE" for a in S.STANDARD) + f", least({_N}, 50) / 50.0::DOUBLE, least(1.0, greatest(0.0, ({_GRAVY} + 4.5) / 9.0)), least(1.0, greatest(0.0, ({_CHARGE} + 10.0) / 20.0)), {count_sql('FWY')} / {_N}::DOUBLE]"
_SORTED = "array_to_string(list_sort(list_distinct(regexp_extract_all(sequence, '{}'))), '')"
_UNC = "round(least(100.0, greatest(0.0, 100.0 - abs(s - 70.0) * 2.0) + least(15.0, len(f) * 5.0)), 3)"

QUERIES = {f.__name__: f for f in (flagship, basic_features, curation_features, manufacturability_score, dimension_scores, net_charge_gravy, drc_motifs, drc_runs, drc_summary, rule_screening, drc_violations, dialectic_verdict, feature_vectors, selection_scores, weighted_profile, residue_validation, curation_gates)}
SQL = {
    "flagship": f"SELECT d.doc_id, d.sequence, s AS overall_score, array_to_string(f, ';') AS risk_flags, n_fatal = 0 AS passed_hard_drc, CASE WHEN n_fatal > 0 THEN 'reject_or_redesign_drc_failure' WHEN s >= 80 THEN 'test_or_keep' WHEN s >= 60 THEN 'revise_or_test_with_caution' ELSE 'revise_before_testing' END AS recommendation FROM {_DRC} AS d JOIN (SELECT doc_id, {_FLAGS} AS f, greatest(0.0, least(100.0, {_SCORE})) AS s FROM {SEQ_HASH} AS t) USING (doc_id)",
    "basic_features": f"SELECT doc_id, nullif({_N}, 0)::DOUBLE AS length, round({_H}, 6) AS hydrophobic_fraction, {_CH}::DOUBLE AS net_charge_proxy, {_OX}::DOUBLE AS oxidation_count, {_DE}::DOUBLE AS deamidation_count, {_CY}::DOUBLE AS cysteine_count FROM {SEQ_TEXT} AS t",
    "curation_features": f"SELECT doc_id, nullif({_N}, 0)::INT AS length, round({count_sql('KR')} + 0.1::DOUBLE * {count_sql('H')} - {count_sql('DE')}, 2) AS net_charge, round({count_sql(S.HYDROPHOBIC_WIDE)} / nullif({_N}, 0)::DOUBLE, 4) AS hydrophobic_fraction, {count_sql('FWY')}::INT AS aromatic_count, {_CY}::INT AS cysteine_count, {count_sql('M')}::INT AS methionine_count, {_DE}::INT AS asparagine_glutamine_count FROM {SEQ_TEXT} AS t",
    "manufacturability_score": f"SELECT doc_id, array_to_string(f, ';') AS risk_flags, s AS overall_score, CASE WHEN s >= 80 THEN 'test_or_keep' WHEN s >= 60 THEN 'revise_or_test_with_caution' ELSE 'revise_before_testing' END AS recommendation FROM (SELECT doc_id, {_FLAGS} AS f, greatest(0.0, least(100.0, {_SCORE})) AS s FROM {SEQ_HASH} AS t)",
    "dimension_scores": "SELECT doc_id, " + ", ".join(f"round({v}, 5) AS {k}" for k, v in _DIMS.items()) + f" FROM {SEQ_HASH} AS t",
    "net_charge_gravy": f"SELECT doc_id, round({_CHARGE}, 5) AS net_charge, round({_GRAVY}, 8) AS gravy FROM {SEQ_HASH} AS t",
    "drc_motifs": f"SELECT doc_id, substr(sequence, i, 2) AS motif, CASE WHEN substr(sequence, i, 2) = 'DG' THEN 'fatal' ELSE 'high_risk' END AS severity, i::INT AS position FROM (SELECT doc_id, sequence, unnest({_MOTIFS}) AS i FROM {SEQ_HASH} AS t)",
    "drc_runs": f"SELECT doc_id, 'DRC-002' AS rule_id, unnest(regexp_extract_all(sequence, '[VILFYW]{{5,}}')) AS motif FROM {SEQ_HASH} AS t UNION ALL SELECT doc_id, 'DRC-005', unnest(regexp_extract_all(sequence, 'P{{3,}}')) FROM {SEQ_HASH} AS t",
    "rule_screening": "SELECT n_fatal = 0 AS passed_hard_drc, n_fatal::INT AS n_fatal, n_high_risk::INT AS n_high_risk, n_warning::INT AS n_warning, count(*) AS n FROM " + _DRC.replace(SEQ_HASH, SEQ_HASH.replace("doc_id, substr", "k AS doc_id, substr").replace("|| doc_id", "|| k").replace("doc_id % 63", "k % 63").replace("FROM documents", "FROM (SELECT l_orderkey * 10 + l_linenumber AS k FROM lineitem)")) + " AS d GROUP BY ALL",
    "drc_summary": f"SELECT doc_id, n_fatal = 0 AS passed_hard_drc, n_fatal::INT AS n_fatal, n_high_risk::INT AS n_high_risk, n_warning::INT AS n_warning, n_remediations::INT AS n_remediations, round(charge, 3) AS net_charge_ph74, round(gravy, 8) AS gravy_index FROM {_DRC} AS d",
    "dialectic_verdict": f"""SELECT doc_id, a AS advocate_score, s AS sceptic_score, round(abs(a - (1.0 - s)), 6) AS dissensus_delta,
        CASE WHEN n_fatal > 0 THEN 'REJECT' WHEN s >= 0.70 THEN 'REJECT' WHEN abs(a - (1.0 - s)) > 0.35 THEN 'DISCRIMINATIVE_ASSAY' WHEN a >= 0.75 AND s <= 0.30 THEN 'PASS' WHEN a >= 0.60 THEN 'PASS' ELSE 'REJECT' END AS decision
        FROM (SELECT *, round(greatest(0.0, least(1.0, 0.70::DOUBLE + least(0.25::DOUBLE, {count_sql('KRH')} / {_N}::DOUBLE * 0.5))), 6) AS a, least(1.0::DOUBLE, n_fatal * 0.5::DOUBLE + n_high_risk * 0.25::DOUBLE) AS s FROM {_DRC} AS d)""",
    "feature_vectors": f"SELECT doc_id, (i - 1)::INT AS dim, round(v[i], 6) AS value FROM (SELECT doc_id, {_FEATS} AS v, unnest(range(1, 25)) AS i FROM {SEQ_HASH} AS t)",
    "selection_scores": f"SELECT doc_id, s AS manufacturability_score, {_UNC}::DOUBLE AS uncertainty_score, least(35.0, len(f) * 7.0)::DOUBLE AS risk_penalty, round(0.55::DOUBLE * s + 0.30::DOUBLE * 100 + 0.15::DOUBLE * {_UNC} - least(35.0, len(f) * 7.0), 3) AS priority_score FROM (SELECT doc_id, {_FLAGS} AS f, greatest(0.0, least(100.0, {_SCORE})) AS s FROM {SEQ_HASH} AS t)",
    "weighted_profile": "SELECT doc_id, round((" + " + ".join(f"({_DIMS[k]}) * {w}::DOUBLE" for k, w in {"length_risk": 0.2, "hydrophobicity_risk": 0.3, "charge_risk": 0.2, "oxidation_risk": 0.15, "deamidation_risk": 0.15}.items()) + f") / 1.0, 5) AS profile FROM {SEQ_HASH} AS t",
    "residue_validation": f"SELECT doc_id, {_SORTED.format('[BJOUXZ]')} AS ambiguous, {_SORTED.format('[^' + S.STANDARD + S.AMBIGUOUS + ']')} AS invalid, sequence <> '' AS ok FROM {SEQ_RAW} AS t",
    "curation_gates": f"SELECT doc_id, array_to_string(list_filter([CASE WHEN {count_sql('FWY')} > 8 THEN 'AROMATIC' END, CASE WHEN round({count_sql(S.HYDROPHOBIC_WIDE)} / {_N}::DOUBLE, 4) > 0.6 THEN 'HYDROPHOBIC' END, CASE WHEN {_CY} >= 4 THEN 'CYSTEINE' END], lambda x: x IS NOT NULL), ';') AS gates FROM {SEQ_HASH} AS t",
}
QUERIES |= {f"{n}_whole": QUERIES[n] for n in ("basic_features", "curation_features", "residue_validation")}  # the names of the round before
SQL |= {f"{n}_whole": SQL[n] for n in ("basic_features", "curation_features", "residue_validation")}

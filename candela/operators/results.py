"""Experimental result documents: parsing, failure-mode classification by a rule table, batch ingest."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions.binding import let

# The ontology of failure codes.
ONTOLOGY = [
    "SYN_FAIL_UNKNOWN", "SYN_LOW_CRUDE_PURITY", "SYN_SEQUENCE_LENGTH_RISK", "SYN_HYDROPHOBIC_SEQUENCE", "SYN_CYCLISATION_FAILED",
    "SYN_MODIFICATION_FAILED", "SYN_LOW_YIELD", "SYN_SCALE_UP_FAILED", "PURIFICATION_DIFFICULT", "COELUTING_IMPURITIES", "ANALYTICAL_AMBIGUITY",
    "LCMS_MISMATCH", "OXIDATION_PRODUCT", "DEAMIDATION_PRODUCT", "AGGREGATED_PRODUCT", "LOW_AQUEOUS_SOLUBILITY", "PRECIPITATION", "AGGREGATION",
    "STORAGE_INSTABILITY", "FREEZE_THAW_INSTABILITY", "BUFFER_INCOMPATIBILITY", "NO_BINDING", "WEAK_BINDING", "NON_SPECIFIC_BINDING",
    "POOR_SELECTIVITY", "NO_FUNCTIONAL_EFFECT", "ASSAY_INTERFERENCE", "OFF_TARGET_SIGNAL", "PROTEASE_LABILE", "SERUM_INSTABILITY",
    "OXIDATION_LIABILITY", "DEAMIDATION_LIABILITY", "HYDROLYSIS_LIABILITY", "CYTOTOXICITY", "IMMUNOGENICITY_RISK", "HEMOLYSIS_RISK",
    "POOR_PERMEABILITY", "DELIVERY_FAILURE", "MODEL_OVERCONFIDENCE", "BAD_TARGET_ASSUMPTION", "WRONG_BINDING_SITE", "DOCKING_ARTEFACT",
    "STRUCTURE_PREDICTION_ARTEFACT", "DATA_LEAKAGE", "INSUFFICIENT_CONTROLS", "AGENT_ORCHESTRATION_FAILURE", "MISSING_REPRODUCIBILITY_CONTEXT",
]
# Narrative rules in order; a code applies if the lower-cased text holds any phrase of every list.
RULES = [
    ("NO_BINDING", ["no measurable activity", "no antimicrobial activity", "no binding"]),
    ("WEAK_BINDING", ["weak activity", "low activity", "modest activity"]),
    ("NON_SPECIFIC_BINDING", ["non-specific", "nonspecific"]),
    ("POOR_SELECTIVITY", ["poor selectivity"]),
    ("OFF_TARGET_SIGNAL", ["off-target"]),
    ("NO_FUNCTIONAL_EFFECT", ["no functional effect"]),
    ("ASSAY_INTERFERENCE", ["assay interference", "high background", "interference"]),
    ("SYN_FAIL_UNKNOWN", ["synthesis failed"]),
    ("SYN_HYDROPHOBIC_SEQUENCE", ["hydrophobic sequence", "hydrophobicity"]),
    ("SYN_CYCLISATION_FAILED", ["cyclisation", "cyclization"]),
    ("SYN_MODIFICATION_FAILED", ["modification failed"]),
    ("SYN_SCALE_UP_FAILED", ["scale-up"]),
    ("PURIFICATION_DIFFICULT", ["difficult purification", "difficult to purify"]),
    ("COELUTING_IMPURITIES", ["co-eluting", "coeluting"]),
    ("ANALYTICAL_AMBIGUITY", ["analytical ambiguity", "lcm sm ambiguous"]),
    ("LCMS_MISMATCH", ["lcm s mismatch", "lcms mismatch"]),
    ("OXIDATION_PRODUCT", ["oxidized", "oxidation"]),
    ("DEAMIDATION_PRODUCT", ["deamidated", "deamidation"]),
    ("AGGREGATED_PRODUCT", ["aggregated product", "aggregate"]),
    ("AGGREGATION", ["aggregated product", "aggregate"]),
    ("PRECIPITATION", ["precipitation", "precipitated"]),
    ("STORAGE_INSTABILITY", ["storage instability"]),
    ("FREEZE_THAW_INSTABILITY", ["freeze-thaw", "freeze thaw"]),
    ("BUFFER_INCOMPATIBILITY", ["buffer"], ["incompatibility", "failed condition"]),
    ("PROTEASE_LABILE", ["protease"]),
    ("SERUM_INSTABILITY", ["serum instability", "serum degradation"]),
    ("CYTOTOXICITY", ["cytotoxic"]),
    ("HEMOLYSIS_RISK", ["hemolysis"]),
    ("IMMUNOGENICITY_RISK", ["immunogenic"]),
    ("POOR_PERMEABILITY", ["permeability"]),
    ("DELIVERY_FAILURE", ["delivery failure"]),
    ("MODEL_OVERCONFIDENCE", ["model overpredict", "model over-confident", "overconfident"]),
    ("WRONG_BINDING_SITE", ["wrong target", "target mismatch"]),
    ("DOCKING_ARTEFACT", ["docking artefact", "docking artifact"]),
    ("STRUCTURE_PREDICTION_ARTEFACT", ["structure prediction artefact", "structure prediction artifact"]),
    ("DATA_LEAKAGE", ["data leakage"]),
    ("INSUFFICIENT_CONTROLS", ["insufficient controls", "control was missing"]),
    ("AGENT_ORCHESTRATION_FAILURE", ["agent orchestration"]),
    ("MISSING_REPRODUCIBILITY_CONTEXT", ["inconsistent", "not reproducible", "bad controls"]),
    ("INSUFFICIENT_CONTROLS", ["no controls"]),
    ("SYN_SEQUENCE_LENGTH_RISK", ["bad sequence length", "length risk"]),
]
# Metric aliases (normalised), the bound below which a code applies.
METRICS = [
    ("SYN_LOW_YIELD", ["yield", "crude_yield", "recovery", "synthesis_yield"], 20.0),
    ("SYN_LOW_CRUDE_PURITY", ["purity", "crude_purity", "final_purity"], 90.0),
    ("LOW_AQUEOUS_SOLUBILITY", ["solubility", "aqueous_solubility", "solubility_mg_ml", "solubility_mgml"], 0.5),
]
# Header lines and sections of a result document, and its line patterns.
META = {"result id": "result_id", "candidate id": "candidate_id", "campaign id": "campaign_id", "vendor or lab": "vendor_or_lab", "result type": "result_type"}
SECTION_LINE, META_LINE, BULLET = r"^\s*##\s*(.+?)\s*$", r"^\s*([A-Za-z0-9 /_-]+)\s*:\s*(.*)\s*$", r"^[-*]\s+"


def plain_key(c: Column) -> Column:
    """Lower case, other than letters and digits as single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def plain_code(c: Column) -> Column:
    """A failure code in upper case without anything but letters, digits and underscores."""
    kept = F.regexp_replace(F.replace(F.upper(F.trim(c)), F.lit("-"), F.lit("_")), "[^A-Za-z0-9_]", "")
    return F.replace(kept, F.lit("__"), F.lit("_"))


def first_number(c: Column) -> Column:
    return F.regexp_extract(c, r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def scalar(c: Column) -> Column:
    """A cell as text, null for blanks and the words that mean nothing."""
    t = F.trim(c)
    return F.when((t == "") | F.lower(t).isin("na", "n/a", "-", "none", "null"), None).otherwise(t)


def code_lines(lines: Column) -> dict[str, Column]:
    """The known and the unknown codes among a section's lines; prose that reads like a code once cleaned is unknown."""
    bare = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.trim(x), BULLET, "")))
    bare = F.filter(bare, lambda x: (x != "") & plain_code(x).rlike("^[A-Z0-9_]{6,}$") & ~F.lower(x).startswith("to be populated"))
    codes = F.transform(bare, plain_code)
    return {"known": F.filter(codes, lambda x: x.isin(ONTOLOGY)), "unknown": F.filter(codes, lambda x: ~x.isin(ONTOLOGY))}


def key_values(lines: Column) -> Column:
    """A pipe table's first two cells as a map of text; header and rule rows are left out, later rows win."""
    rows = F.transform(F.filter(lines, lambda x: x.contains("|")), lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\|+|\|+$", ""), r"\|", -1), lambda x: F.trim(x)))
    rows = F.filter(rows, lambda r: (F.size(r) >= 2) & (r[0] != "") & ~F.replace(F.lower(r[0]), F.lit(" "), F.lit("")).isin("metric", "value", "notes", "---") & ~r[0].rlike("^-+$"))
    rows = F.filter(F.transform(rows, lambda r: F.struct(r[0].alias("key"), scalar(r[1]).alias("value"))), lambda e: e["value"].isNotNull())
    return let(rows, lambda all_: F.map_from_entries(F.filter(all_, lambda e, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda o: o["key"] == e["key"]))))


def metric(values: Column, aliases: list[str]) -> Column:
    """The first number among the entries whose key is one of the aliases."""
    hits = F.filter(F.transform(F.filter(F.map_entries(values), lambda e: plain_key(e["key"]).isin(aliases)), lambda e: first_number(e["value"].cast("string"))), lambda x: x.isNotNull())
    return F.get(hits, 0)


def parse(docs: DataFrame, text_col: str = "text", source_col: str | None = None) -> DataFrame:
    """Documents of ``Key: value`` lines and ``##`` sections as result records, with ``error`` where a required field lacks.

    Sections are read off each document's array of lines, so nothing is shuffled.
    """
    text = F.trim(F.coalesce(F.col(text_col), F.lit("")))
    d = docs.withColumn("__lines", F.split(text, r"\r\n|\r|\n"))
    head = lambda x: x.rlike(SECTION_LINE)
    empty = F.struct(F.lit(None).cast("string").alias("section"), F.array().cast("array<struct<section:string,line:string>>").alias("out"))
    folded = F.aggregate(
        "__lines", empty,
        lambda acc, x: F.when(head(x), F.struct(plain_key(F.regexp_extract(x, SECTION_LINE, 1)).alias("section"), acc["out"].alias("out"))).otherwise(F.struct(acc["section"].alias("section"), F.concat(acc["out"], F.array(F.struct(acc["section"].alias("section"), x.alias("line")))).alias("out"))),
        lambda acc: acc["out"],
    )
    d = d.withColumn("__all", folded)
    meta = F.transform(F.filter("__all", lambda e: e["section"].isNull() & e["line"].rlike(META_LINE)), lambda e: F.struct(F.lower(F.trim(F.regexp_extract(e["line"], META_LINE, 1))).alias("key"), F.trim(F.regexp_extract(e["line"], META_LINE, 2)).alias("value")))
    d = d.withColumn("__meta", meta)
    field = lambda k: F.element_at(F.filter("__meta", lambda e: e["key"] == k), -1)["value"]
    d = d.withColumns({v: F.when(F.exists("__meta", lambda e: e["key"] == k), field(k)) for k, v in META.items()})
    lines = lambda s: F.filter(F.transform(F.filter("__all", lambda e: e["section"] == s), lambda e: F.trim(e["line"])), lambda x: x != "")
    codes = code_lines(lines("failure_modes"))
    joined = lambda s, default: F.coalesce(F.nullif(F.trim(F.array_join(lines(s), "\n")), F.lit("")), F.lit(default))
    missing = F.when(text == "", "Result text is empty.")
    for name, label in (("result_id", "Result ID"), ("candidate_id", "Candidate ID"), ("result_type", "Result type")):
        missing = F.coalesce(missing, F.when(F.col(name).isNull(), f"Result metadata missing required field: {label}."))
    out = d.withColumns({
        "summary": joined("summary", "No summary provided."), "interpretation": joined("interpretation", "No interpretation provided."), "next_action": joined("next_design_recommendation", ""),
        "key_values": key_values(lines("key_values")), "failure_modes": codes["known"], "unknown_modes": codes["unknown"], "vendor_or_lab": F.nullif(F.col("vendor_or_lab"), F.lit("")), "error": missing,
        "raw_file_refs": F.array(F.col(source_col)) if source_col else F.array().cast("array<string>"),
    })
    return out.drop("__lines", "__all", "__meta")


def narrative_codes(rules: list[tuple] = RULES) -> Callable[[Column], Column]:
    """A function of lower-cased text: the codes, in order of the rules, whose every list has a phrase in it. All phrases are sought in
    one pass over the text, by an automaton that a task builds once; texts come and codes go in Arrow batches."""
    made: list = []

    def automaton():
        if not made:
            import ahocorasick

            found, bit = ahocorasick.Automaton(), 0
            phrases: dict[str, int] = {}
            need = []
            for _, *lists in rules:
                need.append(0)
                for phrase_list in lists:
                    need[-1] |= 1 << bit
                    for p in phrase_list:
                        phrases[p] = phrases.get(p, 0) | 1 << bit
                    bit += 1
            for p, mask in phrases.items():
                found.add_word(p, mask)
            found.make_automaton()
            made.append((found, need, {}))
        return made[0]

    @F.arrow_udf("array<string>")
    def codes(texts: pa.Array) -> pa.Array:
        found, need, known = automaton()
        out = []
        for text in texts.to_pylist():
            mask = 0
            for _, bits in found.iter(text or ""):
                mask |= bits
            if mask not in known:
                known[mask] = [code for (code, *_), n in zip(rules, need, strict=True) if mask & n == n]
            out.append(known[mask])
        return pa.array(out, pa.list_(pa.string()))

    return codes


def classify(narrative: Column, values: Column | None = None, explicit: Column | None = None, rules: list[tuple] = RULES) -> Column:
    """Failure codes in order of discovery: given codes, measured values below their bounds, then the narrative's phrases."""
    found = narrative_codes(rules)(F.lower(F.coalesce(narrative, F.lit(""))))
    if values is not None:
        found = F.concat(F.array_compact(F.array(*(F.when(metric(values, names) < bound, F.lit(code)) for code, names, bound in METRICS))), found)
    if explicit is not None:
        known = F.filter(F.transform(F.coalesce(explicit, F.array().cast("array<string>")), plain_code), lambda x: x.isin(ONTOLOGY))
        found = F.concat(known, found)
    return F.array_distinct(found)


def ingest(docs: DataFrame, order_col: str, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(results, errors): parsed and classified, the first of each result id kept, the rest and the unreadable as errors."""
    p = parse(docs, text_col)
    p = p.withColumn("failure_modes", classify(F.concat_ws(" ", "summary", "interpretation"), F.col("key_values"), F.col("failure_modes")))
    w = Window.partitionBy("result_id", F.col("error").isNull()).orderBy(order_col)
    p = p.withColumn("__n", F.row_number().over(w))
    good = p.where("error is null and __n = 1").drop("__n", "error")
    bad = p.where("error is not null or __n > 1").select(order_col, "result_id", F.coalesce("error", F.concat(F.lit("Duplicate result_id encountered: "), "result_id")).alias("error"))
    return good, bad


def mode_counts(results: DataFrame) -> DataFrame:
    """Results by failure mode. Exploded with its empty rows: Spark would else push a filter on the array, and so a second classification, to the scan."""
    return results.select(F.explode_outer("failure_modes").alias("failure_mode")).where("failure_mode is not null").groupBy("failure_mode").agg(F.count("*").alias("n"))

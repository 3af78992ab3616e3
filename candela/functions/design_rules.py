"""Design-rule checks over sequences: five rules, each a column of violation structs, and their suite."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.functions import sequence as S
from candela.functions.binding import let

VIOLATION = "array<struct<rule_id:string,rule_name:string,severity:string,failure_code:string,message:string,culprit_motif:string,positions:array<int>>>"

# Rule names, failure codes and texts of findings and remedies.
REMEDIES = {
    "DRC-001": "Replace Gly/Ser with Ala, or utilize alpha-methyl aspartate to block aspartimide cyclization.",
    "DRC-002": "Insert pseudoproline dipeptides (e.g., Fmoc-Ser(tBu)-Thr(psiMe,Mepro)-OH) or PEG spacers to break on-resin aggregation.",
    "DRC-003": "Incorporate basic (Lys/Arg) or acidic (Glu) capping residues at termini to shift pI away from pH 7.4.",
    "DRC-004": "Cap free cysteine or replace with Ser/Ala to prevent oxidation scrambling.",
}


def _violation(rule: str, name: str, severity: Column, code: str, message: Column, motif: Column, positions: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule_id"), F.lit(name).alias("rule_name"), severity.alias("severity"), F.lit(code).alias("failure_code"), message.alias("message"), motif.cast("string").alias("culprit_motif"), positions.cast("array<int>").alias("positions"))


def _found(seq: Column, pattern: str, build) -> Column:
    """``build(motif, start)`` for every match of ``pattern``, starts from 1: one search each for the matches and for what is
    between them; sequences without a match are passed over at the cost of one."""

    def place(hits: Column) -> Column:
        pairs = F.zip_with(hits, F.slice(F.split(seq, pattern, -1), F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("motif"), F.length(g).alias("gap")))
        start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<motif:string,start:int>>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            at = acc["at"] + x["gap"]
            return F.struct((at + F.length(x["motif"])).alias("at"), F.concat(acc["out"], F.array(F.struct(x["motif"].alias("motif"), at.alias("start")))).alias("out"))

        return F.transform(F.aggregate(pairs, start, step)["out"], lambda f: build(f["motif"], f["start"]))

    return F.when(seq.rlike(pattern), let(F.regexp_extract_all(seq, F.lit(pattern), F.lit(0)), place)).otherwise(F.array().cast(VIOLATION))


def motif_violations(seq: Column) -> Column:
    def one(motif: Column, i: Column) -> Column:
        text = F.concat(F.lit("High risk of base-catalyzed aspartimide formation at '"), motif, F.lit("' under piperidine Fmoc-deprotection."))
        return _violation("DRC-001", "Aspartimide Cyclization Liability", F.when(motif == "DG", "fatal").otherwise("high_risk"), "SYN_MODIFICATION_FAILED", text, motif, F.array(i, i + 1))

    return _found(seq, "D[GSN]", one)


def run_violations(seq: Column, most: int = 5) -> Column:
    def one(motif: Column, i: Column) -> Column:
        text = F.concat(F.lit("Severe SPPS coupling failure risk: run of "), F.length(motif).cast("string"), F.lit(" consecutive hydrophobic residues '"), motif, F.lit("' causes resin aggregation."))
        return _violation("DRC-002", "SPPS Interchain Beta-Sheet Collapse", F.lit("fatal"), "SYN_HYDROPHOBIC_SEQUENCE", text, motif, F.sequence(i, i + F.length(motif) - 1))

    return _found(seq, f"[VILFYW]{{{most},}}", one)


def precipitation_violations(charge: Column, hydropathy: Column) -> Column:
    text = F.format_string("Near-neutral net charge (z=%.2f) combined with positive GRAVY (%.2f) causes high precipitation risk at pH 7.4.", charge, hydropathy)
    one = _violation("DRC-003", "Isoelectric Precipitation Liability", F.when(hydropathy > 0.6, "fatal").otherwise("high_risk"), "LOW_AQUEOUS_SOLUBILITY", text, F.lit(None), F.array())
    return F.when((F.abs(charge) < 0.5) & (hydropathy > 0.3), F.array(one)).otherwise(F.array().cast(VIOLATION))


def cysteine_violations(seq: Column) -> Column:
    n = S.count_of(seq, "C")
    text = F.concat(F.lit("Odd number of cysteines ("), n.cast("string"), F.lit(") yields unpaired reactive thiol prone to air oxidation and oligomerization."))
    one = _violation("DRC-004", "Unpaired Cysteine Disulfide Scrambling", F.lit("high_risk"), "OXIDATION_LIABILITY", text, F.lit("C"), F.filter(F.sequence(F.lit(1), F.length(seq)), lambda i: F.substring(seq, i, F.lit(1)) == "C"))
    return F.when(n % 2 != 0, F.array(one)).otherwise(F.array().cast(VIOLATION))


def proline_violations(seq: Column) -> Column:
    def one(motif: Column, i: Column) -> Column:
        text = F.concat(F.lit("Consecutive proline run '"), motif, F.lit("' causes steric hindrance and reduced SPPS coupling efficiency."))
        return _violation("DRC-005", "Poly-Proline Steric Coupling Hindrance", F.lit("warning"), "SYN_LOW_YIELD", text, motif, F.sequence(i, i + F.length(motif) - 1))

    return _found(seq, "P{3,}", one)


def violations(s: Column, charge: Column, hydropathy: Column) -> Column:
    """All violations of a clean sequence, in rule order."""
    found = F.concat(motif_violations(s), run_violations(s), precipitation_violations(charge, hydropathy), cysteine_violations(s), proline_violations(s)).cast(VIOLATION)
    return found


def screened(df: DataFrame, sequence_col: str = "sequence") -> DataFrame:
    """``df`` with the suite's columns and its summary, each computed once: sequence, then charge and hydropathy, then violations."""
    d = df.withColumn("__clean", S.clean(F.col(sequence_col)))
    d = d.withColumns({"net_charge_ph74": S.net_charge(F.col("__clean")), "gravy_index": S.gravy(F.col("__clean"))})
    d = d.withColumn("violations", violations(F.col("__clean"), F.col("net_charge_ph74"), F.col("gravy_index"))).drop("__clean")
    return d.withColumns(summary(F.col("violations")))


def counted(df: DataFrame, sequence_col: str = "sequence") -> DataFrame:
    """``df`` with n_fatal, n_high_risk, n_warning and passed_hard_drc, net_charge_ph74 and gravy_index: the verdicts of ``screened``
    without its findings. Residues of a whole Arrow batch are counted at once, and findings are counted from them and from neighbours;
    no text is built. A null sequence has no finding and an empty one's charge."""
    names = df.columns
    clean, fields = "clean_", [("n_fatal", "int"), ("n_high_risk", "int"), ("n_warning", "int"), ("passed_hard_drc", "boolean"), ("net_charge_ph74", "double"), ("gravy_index", "double")]
    while clean in names:
        clean += "_"
    ends, each = S.charge_terms(7.4)

    def run(batches):
        for b in batches:
            if b.num_rows:
                made = _verdicts(b.column(clean).fill_null(""), ends, each)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *map(pa.array, made)], names=[*names, *(n for n, _ in fields)])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"{n} {t}" for n, t in fields])
    return df.withColumn(clean, S.clean(F.col(sequence_col))).mapInArrow(run, schema)


def _verdicts(texts: pa.StringArray, ends: float, each: dict[str, float]) -> list[np.ndarray]:
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    n, row = len(texts), np.repeat(np.arange(len(texts)), np.diff(bounds))
    count = np.bincount(row * 256 + data, minlength=256 * n).reshape(n, 256)
    length = count[:, :128].sum(1) + count[:, 192:].sum(1)  # characters: all bytes but those that go on with one
    of = lambda letters: sum(count[:, ord(x)] for x in letters)
    charge, total = np.full(n, ends), np.zeros(n)
    for a, w in each.items():  # in the order of the column form, so that sums are equal to the last bit
        charge = charge + of(a) * w
    for a, w in S.HYDROPATHY.items():
        total = total + of(a) * w
    gravy = np.where(length > 0, total / np.maximum(length, 1), 0.0)
    pair = np.flatnonzero((data[:-1] == ord("D")) & (row[:-1] == row[1:]))
    after = data[pair + 1] if len(pair) else pair
    per_row = lambda at: np.bincount(row[at], minlength=n)

    def runs(letters: str, least: int) -> np.ndarray:
        inside = np.isin(data, np.frombuffer(letters.encode(), np.uint8))
        begins = inside & np.concatenate(([True], ~inside[:-1] | (row[1:] != row[:-1])))[: len(data)]
        start = np.flatnonzero(begins)
        size = np.add.reduceat(inside & True, start, dtype=np.int64) if len(start) else start
        return per_row(start[size >= least])

    dull = (np.abs(charge) < 0.5) & (gravy > 0.3)
    fatal = per_row(pair[after == ord("G")]) + runs("VILFYW", 5) + (dull & (gravy > 0.6))
    high = per_row(pair[(after == ord("S")) | (after == ord("N"))]) + (dull & ~(gravy > 0.6)) + of("C") % 2
    return [fatal.astype(np.int32), high.astype(np.int32), runs("P", 3).astype(np.int32), fatal == 0, charge, gravy]


def summary(violations: Column) -> dict[str, Column]:
    stops = F.transform(F.filter(violations, lambda v: v["severity"] == "fatal"), lambda v: v["message"])
    remedy = F.create_map(*(F.lit(x) for kv in REMEDIES.items() for x in kv))
    return {
        "hard_stop_reasons": stops,
        "passed_hard_drc": F.size(stops) == 0,
        "suggested_remediations": F.array_distinct(F.filter(F.transform(violations, lambda v: F.try_element_at(remedy, v["rule_id"])), lambda r: r.isNotNull())),
    }


def liability_score(violations: Column) -> Column:
    """Half a point for each fatal and a quarter for each high-risk violation, at most 1."""
    count = lambda level: F.size(F.filter(violations, lambda v: v["severity"] == level))
    return F.least(F.lit(1.0), count("fatal") * 0.5 + count("high_risk") * 0.25)


def advocate_score(seq: Column) -> Column:
    """0.70 plus up to 0.25 for the share of basic residues."""
    s = S.clean(seq)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.70 + F.least(F.lit(0.25), S.count_of(s, "KRH") / F.nullif(F.length(s), F.lit(0)) * 0.5)))


def verdict(advocate: Column, sceptic: Column, passed: Column, threshold: float = 0.35) -> Column:
    """REJECT on a hard stop or a liability of 0.70; a discriminative assay where the two scores disagree; else by the advocate's score."""
    return (
        F.when(~passed, "REJECT")
        .when(sceptic >= 0.70, "REJECT")
        .when(F.abs(advocate - (1.0 - sceptic)) > threshold, "DISCRIMINATIVE_ASSAY")
        .when((advocate >= 0.75) & (sceptic <= 0.30), "PASS")
        .otherwise(F.when(advocate >= 0.60, "PASS").otherwise("REJECT"))
    )

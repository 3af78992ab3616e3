"""Sequence descriptors as column expressions: composition counts, charge, hydropathy, k-mers, similarities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from candela.functions.binding import let

# Residue classes, hydropathy (Kyte and Doolittle 1982) and side-chain pKa.
STANDARD = "ACDEFGHIKLMNPQRSTVWY"
AMBIGUOUS = "BJOUXZ"
HYDROPHOBIC = "AILMFWYV"
HYDROPHOBIC_WIDE = "AILMFWYVCGP"
HYDROPATHY = {
    "A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8,
    "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8,
    "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5,
    "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3,
}
PKA_N_TERM, PKA_C_TERM = 9.69, 2.34
PKA_BASIC = {"K": 10.53, "R": 12.48, "H": 6.00}
PKA_ACIDIC = {"D": 3.86, "E": 4.25, "C": 8.33, "Y": 10.07}


def normalised(seq: Column) -> Column:
    """Trimmed, without spaces, upper case; null becomes empty."""
    return F.upper(F.replace(F.trim(F.coalesce(seq, F.lit(""))), F.lit(" "), F.lit("")))


def clean(seq: Column) -> Column:
    return F.upper(F.trim(seq))


def count_of(seq: Column, residues: str) -> Column:
    """How many characters of ``seq`` are in ``residues``."""
    return F.length(seq) - F.length(F.translate(seq, residues, ""))


def basic_features(seq: Column) -> dict[str, Column]:
    """length, hydrophobic_fraction, net_charge_proxy and the oxidation, deamidation and cysteine counts; null for an empty sequence."""
    s, n = clean(seq), F.nullif(F.length(clean(seq)), F.lit(0))
    return {
        "length": n.cast("double"),
        "hydrophobic_fraction": count_of(s, HYDROPHOBIC) / n,
        "net_charge_proxy": (count_of(s, "KRH") - count_of(s, "DE")).cast("double"),
        "oxidation_count": count_of(s, "MWC").cast("double"),
        "deamidation_count": count_of(s, "NQ").cast("double"),
        "cysteine_count": count_of(s, "C").cast("double"),
    }


def curation_features(seq: Column) -> dict[str, Column]:
    """The dataset's own feature columns, with its wider hydrophobic class and tenth-weighted histidine."""
    s, n = clean(seq), F.nullif(F.length(clean(seq)), F.lit(0))
    charge = count_of(s, "KR") + 0.1 * count_of(s, "H") - count_of(s, "DE")
    return {
        "length": n,
        "net_charge": F.round(charge, 2),
        "hydrophobic_fraction": F.round(count_of(s, HYDROPHOBIC_WIDE) / n, 4),
        "aromatic_count": count_of(s, "FWY"),
        "cysteine_count": count_of(s, "C"),
        "methionine_count": count_of(s, "M"),
        "asparagine_glutamine_count": count_of(s, "NQ"),
    }


def charge_terms(ph: float) -> tuple[float, dict[str, float]]:
    """The termini's charge and each ionisable residue's contribution at a pH (Henderson-Hasselbalch)."""
    ends = 1 / (1 + 10 ** (ph - PKA_N_TERM)) - 1 / (1 + 10 ** (PKA_C_TERM - ph))
    return ends, {a: 1 / (1 + 10 ** (ph - k)) for a, k in PKA_BASIC.items()} | {a: -1 / (1 + 10 ** (k - ph)) for a, k in PKA_ACIDIC.items()}


def net_charge(seq: Column, ph: float = 7.4) -> Column:
    ends, each = charge_terms(ph)
    out = F.lit(ends)
    for a, w in each.items():
        out = out + count_of(seq, a) * F.lit(w)
    return out


def gravy(seq: Column) -> Column:
    """Mean hydropathy; unknown residues count 0, an empty sequence is 0."""
    total = F.lit(0.0)
    for a, w in HYDROPATHY.items():
        total = total + count_of(seq, a) * F.lit(w)
    return F.when(F.length(seq) > 0, total / F.length(seq)).otherwise(0.0)


def identity(a: Column, b: Column) -> Column:
    """Share of equal positions of two sequences of one length; 0 if the lengths differ by more than one or one is empty,
    and the best one-indel alignment if they differ by one."""
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda x: x))
    one = F.when(F.length(a) > F.length(b), one_indel(a, b)).otherwise(one_indel(b, a))
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(F.length(a) == F.length(b), F.when(a == b, F.lit(1.0)).otherwise(same / F.length(a))).when(F.abs(F.length(a) - F.length(b)) == 1, one).otherwise(F.lit(0.0))


def one_indel(longer: Column, shorter: Column) -> Column:
    """The better of aligning ``shorter`` at either end of ``longer``, over the longer length."""
    def hits(x: Column) -> Column:
        return F.size(F.filter(F.zip_with(F.split(x, ""), F.split(shorter, ""), lambda p, q: p == q), lambda p: p))

    n = F.length(shorter)
    return F.greatest(hits(F.substring(longer, F.lit(1), n)), hits(F.substring(longer, F.lit(2), n))) / F.length(longer)


def kmers(seq: Column, k: int = 3) -> Column:
    """Distinct k-mers; the set of characters for a sequence shorter than ``k``."""
    def grams(s: Column) -> Column:  # ``seq`` is worked out once, not once a k-mer
        n = F.length(s)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(k)))
        return F.array_distinct(F.when(n >= k, runs).when(n > 0, F.split(s, "")).otherwise(F.array().cast("array<string>")))

    return let(seq, grams)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets: 1 if both are empty, 0 if one is."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def feature_vector(seq: Column) -> Column:
    """24 numbers: residue frequencies, capped length, scaled hydropathy and charge, aromatic share; zeros for an empty sequence."""
    s = clean(F.coalesce(seq, F.lit("")))
    n = F.length(s)
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    parts = [count_of(s, a) / n for a in STANDARD] + [F.least(n, F.lit(50)) / 50.0, clip((gravy(s) + 4.5) / 9.0), clip((net_charge(s) + 10.0) / 20.0), count_of(s, "FWY") / n]
    return F.when(n > 0, F.array(*(p.cast("double") for p in parts))).otherwise(F.array_repeat(F.lit(0.0), len(parts)))

"""The sequence functions under SQL names, as SQL functions over built-ins: no Python runs when they are called."""

from __future__ import annotations

from pyspark.sql import SparkSession

from candela.functions import sequence as S


def _count(residues: str) -> str:
    return f"(length(s) - length(translate(s, '{residues}', '')))"


def definitions() -> dict[str, str]:
    ends, each = S.charge_terms(7.4)
    charge = f"{ends!r}D" + "".join(f" + {_count(a)} * {w!r}D" for a, w in each.items())
    total = "0D" + "".join(f" + {_count(a)} * {w!r}D" for a, w in S.HYDROPATHY.items())
    return {
        "seq_normalised(s STRING) RETURNS STRING": "upper(replace(trim(coalesce(s, '')), ' ', ''))",
        "seq_hydrophobic_fraction(s STRING) RETURNS DOUBLE": f"{_count(S.HYDROPHOBIC)} / nullif(length(s), 0)",
        "seq_charge_proxy(s STRING) RETURNS DOUBLE": f"{_count('KRH')} - {_count('DE')}",
        "seq_net_charge(s STRING) RETURNS DOUBLE": charge,
        "seq_gravy(s STRING) RETURNS DOUBLE": f"CASE WHEN length(s) > 0 THEN ({total}) / length(s) ELSE 0D END",
        "seq_kmers(s STRING, k INT) RETURNS ARRAY<STRING>": "array_distinct(transform(sequence(1, greatest(length(s) - k + 1, 1)), i -> substr(s, i, k)))",
        "seq_jaccard(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": "size(array_intersect(a, b)) / nullif(size(array_union(a, b)), 0)",
    }


def register(spark: SparkSession) -> None:
    for head, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

"""Dataset governance: row contracts, duplicate identifiers, domains, referential checks and the preflight job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions import sequence as S
from candela.operators import events as E
from candela.operators import leakage
from candela.operators.staging import staged

ID_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"
_AMBIGUOUS, _OTHER = f"[{S.AMBIGUOUS}]", f"[^{S.STANDARD}{S.AMBIGUOUS}]"

# Required columns and allowed values of the two dataset kinds.
SEED_COLUMNS = [
    "peptide_id", "name", "sequence", "length", "source_database", "source_organism", "target_microbe", "gram_status", "activity_type", "mic_value",
    "mic_unit", "assay_conditions", "haemolysis_value", "cytotoxicity_value", "modifications", "linear_or_cyclic", "net_charge",
    "hydrophobic_fraction", "aromatic_count", "cysteine_count", "methionine_count", "asparagine_glutamine_count", "known_stability_notes",
    "known_solubility_notes", "reference", "notes",
]
LIABILITY_COLUMNS = ["peptide_id", "name", "source_database", "source_organism", "liability_bucket", "liability_type", "sequence", "target_organism", "severity", "metric", "reference", "notes"]
TOPOLOGIES = ["cyclic", "linear"]
GRAM = ["Gram-positive", "Gram-negative", "Gram+/Gram-", "Fungal", "Unknown"]
BUCKETS = ["liability", "near-negative"]
SEVERITIES = ["high", "low", "medium"]


def trimmed(df: DataFrame) -> DataFrame:
    """Every string column trimmed."""
    return df.select(*(F.trim(f.name).alias(f.name) if f.dataType.typeName() == "string" else F.col(f.name) for f in df.schema))


def identifier_reason(c: Column) -> Column:
    """Null for a good identifier."""
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "identifier is empty").when(~F.trim(c).rlike(ID_PATTERN), "identifier has unsupported characters")


def residues_in(seq: Column, pattern: str) -> Column:
    """The distinct characters of ``seq`` that match, sorted, joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(seq, F.lit(f"({pattern})"), F.lit(1)))), "")


def sequence_verdict(seq: Column, allow_ambiguous: bool = True) -> dict[str, Column]:
    """invalid (unsupported residues), ambiguous (residues) and ok of a normalised sequence."""
    bad, vague = residues_in(seq, _OTHER), residues_in(seq, _AMBIGUOUS)
    ok = (seq != "") & (bad == "") & (F.lit(allow_ambiguous) | (vague == ""))
    return {"invalid": bad, "ambiguous": vague, "ok": ok}


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def with_first_row(df: DataFrame, id_col: str, row_col: str = "_row_number") -> DataFrame:
    """``first_row``: the least row number of the identifier."""
    return df.withColumn("first_row", F.min(row_col).over(Window.partitionBy(id_col)))


def duplicate_ids(df: DataFrame, id_col: str, row_col: str = "_row_number") -> DataFrame:
    """Rows after the first of their identifier: id, row, previous_row."""
    return with_first_row(df, id_col, row_col).where(F.col(row_col) > F.col("first_row")).select(F.col(id_col).alias("row_id"), F.col(row_col).alias("row"), F.col("first_row").alias("previous_row"))


def contract_events(rows: DataFrame, *, id_col: str = "peptide_id", sequence_col: str = "sequence", required: list[str] | None = None, allow_ambiguous: bool = True) -> DataFrame:
    """Events of a dataset's rows (with ``_row_number``): missing columns, duplicate and malformed identifiers, residues."""
    spark = rows.sparkSession
    required = [id_col, sequence_col] if required is None else required
    head = [{"severity": "error", "code": "DATASET_MISSING_REQUIRED_COLUMN", "message": f"missing required column: {c}", "location": "header"} for c in missing_columns(rows, required)]
    d = rows.select(F.col("_row_number").alias("r"), (F.trim(id_col) if id_col in rows.columns else F.lit("")).alias("i"), S.normalised(F.col(sequence_col) if sequence_col in rows.columns else F.lit("")).alias("s"))
    d = with_first_row(d, "i", "r")
    r, i, v, why = F.col("r"), F.col("i"), sequence_verdict(F.col("s"), allow_ambiguous), identifier_reason(F.col("i"))
    return E.union(
        E.fixed(spark, head),
        E.where_true(
            d,
            [
                (r > F.col("first_row"), E.event("error", "DATASET_DUPLICATE_ID", "duplicate row identifier", row=r, row_id=i, metadata={"previous_row": F.col("first_row")})),
                (why.isNotNull(), E.event("error", "DATASET_INVALID_ID", why, row=r, row_id=i)),
                (~v["ok"], E.event("error", "DATASET_INVALID_SEQUENCE", F.when(F.col("s") == "", "sequence is empty").otherwise("unsupported residues"), row=r, row_id=i, metadata={"sequence": F.col("s"), "details": v["invalid"]})),
                (v["ok"] & (v["ambiguous"] != ""), E.event("warning", "DATASET_AMBIGUOUS_RESIDUES", "ambiguous residues present", row=r, row_id=i, metadata={"residues": v["ambiguous"]})),
            ],
        ),
    )


def split_distribution(rows: DataFrame, split_col: str) -> DataFrame:
    """Rows a split value, blank included."""
    return rows.groupBy(F.coalesce(F.trim(F.col(split_col).cast("string")), F.lit("")).alias("split")).agg(F.count("*").alias("n"))


def split_events(rows: DataFrame, split_col: str, tags: list[str], required: bool) -> DataFrame:
    """A split column that is blank throughout; split values that the manifest doesn't list."""
    dist = split_distribution(rows, split_col)
    blank = dist.agg(F.max(F.col("split") != "").alias("some")).where(~F.coalesce("some", F.lit(False)))
    unlisted = dist.where((F.col("split") != "") & ~F.col("split").isin(tags))
    where = F.lit(split_col)
    return E.union(
        blank.select(E.event("error" if required else "warning", "DATASET_SPLIT_MISSING_VALUES", f"split column '{split_col}' present but empty for all rows", location=where).alias("e")).select("e.*"),
        unlisted.select(E.event("warning", "DATASET_UNLISTED_SPLIT_TAG", F.concat(F.lit("split value '"), "split", F.lit("' not listed in manifest split tags")), location=where, metadata={"manifest": F.lit(",".join(tags))}).alias("e")).select("e.*"),
    )


def _text(df: DataFrame, c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) if c in df.columns else F.lit("")


def _residue_error(seq: Column) -> Column:
    bad = residues_in(F.upper(seq), f"[^{S.STANDARD}]")
    return F.when(seq == "", "Sequence is required").when(bad != "", F.concat(F.lit("Invalid residues: "), bad))


def seed_rules(rows: DataFrame) -> DataFrame:
    """Events of the seed dataset's rows."""
    t = {c: _text(rows, c) for c in ("peptide_id", "sequence", "length", "name", "linear_or_cyclic", "gram_status", "target_microbe")}
    d = rows.select("_row_number", *(v.alias(k) for k, v in t.items()))
    d = with_first_row(d, "peptide_id")
    row, c, number = F.col("_row_number"), F.col, F.expr("try_cast(length as double)")
    as_int = number.cast("bigint")
    ev = lambda sev, code, msg: E.event(sev, code, msg, row=row, row_id=c("peptide_id"))
    return E.where_true(
        d,
        [
            (c("peptide_id") == "", ev("error", "SEED_ID_REQUIRED", "peptide_id is required")),
            ((c("peptide_id") != "") & (row > c("first_row")), ev("error", "SEED_DUPLICATE_ID", "duplicate peptide_id")),
            (_residue_error(c("sequence")).isNotNull(), ev("error", "SEED_SEQUENCE", _residue_error(c("sequence")))),
            (c("length") == "", ev("error", "SEED_LENGTH_REQUIRED", "length is required")),
            ((c("length") != "") & number.isNull(), ev("error", "SEED_LENGTH_NOT_INTEGER", "length is not an integer-like value")),
            (number.isNotNull() & (as_int != F.length("sequence")), ev("warning", "SEED_LENGTH_MISMATCH", F.concat(F.lit("length '"), as_int.cast("string"), F.lit("' does not match sequence length "), F.length("sequence").cast("string")))),
            (c("name") == "", ev("warning", "SEED_NAME_EMPTY", "name is empty")),
            (c("linear_or_cyclic") == "", ev("warning", "SEED_TOPOLOGY_MISSING", "linear_or_cyclic is missing")),
            ((c("linear_or_cyclic") != "") & ~F.lower("linear_or_cyclic").isin(TOPOLOGIES), ev("error", "SEED_TOPOLOGY", "linear_or_cyclic is not allowed")),
            ((c("gram_status") != "") & ~c("gram_status").isin(GRAM), ev("warning", "SEED_GRAM_STATUS", "gram_status is not in the standard set")),
            (c("gram_status") == "", ev("warning", "SEED_GRAM_STATUS_MISSING", "gram_status is missing")),
            (c("target_microbe") == "", ev("warning", "SEED_TARGET_MISSING", "target_microbe is missing")),
        ],
    )


def liability_rules(rows: DataFrame, seed_ids: DataFrame | None = None) -> DataFrame:
    """Events of the liability dataset's rows; ``seed_ids`` (peptide_id) turns on the referential check."""
    t = {c: _text(rows, c) for c in ("peptide_id", "name", "liability_bucket", "liability_type", "sequence", "severity", "metric", "reference")}
    d, c = rows.select("_row_number", *(v.alias(k) for k, v in t.items())), F.col
    if seed_ids is not None:
        d = d.join(seed_ids.select(F.trim("peptide_id").alias("seed_id")).distinct(), c("peptide_id") == c("seed_id"), "left")
    unknown = (c("peptide_id") != "") & c("seed_id").isNull() if seed_ids is not None else F.lit(False)
    ev = lambda sev, code, msg: E.event(sev, code, msg, row=c("_row_number"), row_id=c("peptide_id"))
    return E.where_true(
        d,
        [
            (c("peptide_id") == "", ev("warning", "LIABILITY_ID_EMPTY", "peptide_id is empty")),
            (unknown, ev("warning", "LIABILITY_ID_UNKNOWN", "peptide_id not found in seed dataset")),
            (c("name") == "", ev("warning", "LIABILITY_NAME_EMPTY", "name is empty")),
            ((c("liability_bucket") != "") & ~F.lower("liability_bucket").isin(BUCKETS), ev("warning", "LIABILITY_BUCKET", "liability_bucket is not allowed")),
            (c("liability_bucket") == "", ev("warning", "LIABILITY_BUCKET_MISSING", "liability_bucket is missing")),
            (c("liability_type") == "", ev("warning", "LIABILITY_TYPE_EMPTY", "liability_type is empty")),
            (_residue_error(c("sequence")).isNotNull(), ev("error", "LIABILITY_SEQUENCE", _residue_error(c("sequence")))),
            (~F.lower("severity").isin(SEVERITIES), ev("error", "LIABILITY_SEVERITY", "severity is not allowed")),
            (c("metric") == "", ev("warning", "LIABILITY_METRIC_EMPTY", "metric is empty")),
            (c("reference") == "", ev("warning", "LIABILITY_REFERENCE_EMPTY", "reference is empty")),
        ],
    )


def unmatched(rows: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    """Rows whose key is in no row of ``others``."""
    return rows.join(others.select(F.col(other_key).alias("__other")), F.col(key) == F.col("__other"), "left_anti")


def preflight(rows: DataFrame, manifest: dict | None = None, *, manifest_events: list[dict] | None = None, required: list[str] | None = None, strict: bool = True, allow_ambiguous: bool = True, threshold: float = 0.95, max_pairs: int | None = 25_000, grouped: bool = False) -> DataFrame:
    """All events of a dataset: manifest, contract, then leakage, as pairs of rows or ``grouped`` (see ``leakage_events``). ``rows`` come from ``sources.datasets.read_dataset``."""
    spark = rows.sparkSession
    rows = staged(rows, "preflight")  # every check reads them, and their texts may be costly
    split = manifest["split_column"] if manifest else None
    required = list(required or ["peptide_id", "sequence"])
    if manifest and manifest.get("split_required", True) and split not in required:
        required.append(split)
    parts = [E.fixed(spark, manifest_events or [])]
    d = rows if split is None or split in rows.columns else rows.withColumn(split, F.lit(""))
    if split:
        parts.append(split_events(d, split, manifest.get("split_tags", []), manifest.get("split_required", True)))
    else:
        parts.append(E.fixed(spark, [{"severity": "info", "code": "DATASET_NO_SPLIT_COLUMN", "message": "dataset has no configured split column; split-level leakage checks limited", "location": "preflight"}]))
    parts.append(contract_events(rows, required=required, allow_ambiguous=allow_ambiguous))
    if rows.isEmpty():
        parts.append(E.fixed(spark, [{"severity": "warning", "code": "DATASET_EMPTY", "message": "dataset loaded with no records"}]))
    s = d.select(F.col("_row_number").alias("row"), F.trim("peptide_id").alias("id"), S.normalised(F.col("sequence")).alias("sequence"), (F.coalesce(F.trim(F.col(split)), F.lit("")) if split else F.lit("")).alias("split"))
    parts.append(leakage.leakage_events(s, tags=manifest.get("split_tags", []) if manifest else [], threshold=threshold, max_pairs=max_pairs, strict=strict, grouped=grouped))
    out = E.union(*parts)
    return E.strict(out, "data governance preflight") if strict else out

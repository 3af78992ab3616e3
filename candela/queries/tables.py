"""Input tables and the sequence columns derived from them, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.functions.sequence import STANDARD


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream of its files; as a pattern, since a table may be a single file and a plain stream path a folder only."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def letters(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))


def seq_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as (doc_id, sequence): the standard residues of the whole text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(letters(F.col("text")), f"[^{STANDARD}]", "").alias("sequence"))


def seq_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as (doc_id, sequence): the letters of the whole text."""
    return table(spark, sf_dir, "documents").select("doc_id", letters(F.col("text")).alias("sequence"))


def hashed(key: Column) -> Column:
    """A sequence of 8 to 70 residues from an integer key, which meets every design rule and every length rule."""
    digest = F.concat(*(F.md5(F.concat(F.lit(x), key.cast("string"))) for x in "stu"))
    return F.substring(F.translate(digest, "0123456789abcdef", "ACDFGIKLNPRSVWYE"), F.lit(1), (F.lit(8) + key % 63).cast("int"))


def seq_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as (doc_id, sequence), the sequence hashed from the id."""
    return table(spark, sf_dir, "documents").select("doc_id", hashed(F.col("doc_id")).alias("sequence"))


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_text as (row, id, sequence, split) with three splits."""
    return seq_text(spark, sf_dir).select(F.col("doc_id").alias("row"), F.col("doc_id").cast("string").alias("id"), "sequence", F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")).alias("split"))


def repeated(key: Column, every: int) -> Column:
    """``key``, but one in ``every`` is that of the row before: ids that grow with the table, a few of them twice."""
    return key - F.when(key % every == 0, 1).otherwise(0)


def repeated_sql(key: str, every: int) -> str:
    return f"({key} - CASE WHEN {key} % {every} = 0 THEN 1 ELSE 0 END)"


SEQ_TEXT = f"(SELECT doc_id, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^{STANDARD}]', '', 'g') AS sequence FROM documents)"
SEQ_RAW = "(SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence FROM documents)"
SEQ_HASH = "(SELECT doc_id, substr(translate(md5('s' || doc_id) || md5('t' || doc_id) || md5('u' || doc_id), '0123456789abcdef', 'ACDFGIKLNPRSVWYE'), 1, CAST(8 + doc_id % 63 AS INT)) AS sequence FROM documents)"
SPLIT_ROWS = f"(SELECT doc_id AS row, CAST(doc_id AS VARCHAR) AS id, sequence, 's' || (doc_id % 3) AS split FROM {SEQ_TEXT} AS t)"


def count_sql(residues: str, s: str = "sequence") -> str:
    return f"(length({s}) - length(translate({s}, '{residues}', '')))"

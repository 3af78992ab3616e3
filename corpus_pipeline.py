"""The corpus pipeline: quality classifier, near duplicates, benchmark decontamination, secret scans, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm import decontaminate, ngram_quality, packing, secrets, simhash
from candela.llm.common import fresh, scratch, stored
from candela.llm.queries import vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the trusted-text model finds too surprising, or not surprising at all.

    Null, empty texts go; very long ones are judged whole; rows with null or repeated ids and repeated rows are judged each;
    without labels every text stays; no rows, no rows."""
    verdicts = ngram_quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good_id, good_owner = fresh(docs, "good_id"), fresh(docs, "good_owner")
    good = verdicts.where("kept").select(F.col("doc_id").alias(good_id), F.col("owner").alias(good_owner)).distinct()
    return docs.join(good, F.col("doc_id").eqNullSafe(F.col(good_id)) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col(good_owner)), "left_semi")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a similarity of five-word shingles of at least 0.8.

    The least id stays, null ids last; null, empty and blank texts are one group; very long texts are compared whole; rows
    that repeat in id and text count once; no rows, no rows."""
    return simhash.one_of_similar(docs)


def _aside(docs: DataFrame) -> tuple[DataFrame, list[str], str]:
    """The columns under plain names, so that none clashes with a result; their new names; the text's."""
    plain = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*plain), plain, plain[docs.columns.index("text")]


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item; an item of fewer words than a window is sought whole.

    Null and empty texts have no window and stay; very long ones are searched whole; null ids and repeated rows are judged
    each; an empty benchmark drops nothing."""
    plain, names, text = _aside(docs)
    patterns, _ = decontaminate.windows(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = decontaminate.marked(plain, patterns, text_col=text, keep=names)
    return found.where("n_hit = 0").select(*names).toDF(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret and linked credential part in the texts; n_chars follows.

    Null texts stay null and empty ones empty; very long ones are searched whole; every row stays, null ids and repeats too."""
    plain, names, text = _aside(docs)
    clean = secrets.scan(plain, text_col=text, keep=names).withColumn(text, secrets.redacted(F.col(text), F.col("spans"))).select(*names).toDF(*docs.columns)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the documents into token pieces and packs these into sequences: what to train on, in ids, and its place.

    Null and empty texts are a piece of the end token alone; very long ones are cut, all pieces kept; null ids, ties in length
    and repeated rows are packed each; no rows, no rows."""
    return packing.pack_documents(docs, vocabulary(), with_ids=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("sequence_packing", sequence_packing),
]

#: The trained model, the 64-bit hashes and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage writes on its way is removed once its result is stored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark) as made:
            docs = stored(stage(spark, docs, sf_dir), name)
            made.pop()  # the result stays
    return docs

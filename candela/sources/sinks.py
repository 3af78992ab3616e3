"""Sinks: record tables, append-only logs, bundles by kind, cards as text, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candela.functions import sequence as S


def write_records(df: DataFrame, path: str) -> None:
    """A JSON-lines table, replaced as a whole."""
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """An append-only event log."""
    df.write.mode("append").json(path)


def append_batch(path: str):
    """For ``foreachBatch``: appends a micro-batch under its id, so that a replayed batch replaces itself."""
    return lambda df, batch_id: df.write.mode("overwrite").json(f"{path}/batch={batch_id}")


def with_file_names(df: DataFrame, id_col: str, order_col: str) -> DataFrame:
    """``file_name`` from the identifier; of colliding identifiers all but the first get their index as a suffix."""
    safe = F.regexp_replace(F.col(id_col), r"[^A-Za-z0-9._-]", "_")
    n = F.row_number().over(Window.partitionBy(safe).orderBy(order_col))
    return df.withColumn("file_name", F.concat(safe, F.when(n > 1, F.concat(F.lit("-"), F.col(order_col).cast("string"))).otherwise(F.lit(""))))


def write_bundle(artifacts: DataFrame, path: str, kind_col: str = "artifact_type") -> None:
    """Artifacts in a folder a kind with their fields in order of name, a manifest of counts, and a report in markdown."""
    fields = sorted(c for c in artifacts.columns if c != kind_col)
    artifacts.select(*fields, kind_col).write.mode("overwrite").partitionBy(kind_col).json(f"{path}/artifacts")
    counts = artifacts.groupBy(kind_col).agg(F.count("*").alias("n"))
    counts.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    report = counts.orderBy(kind_col).select(F.concat(F.lit("- "), kind_col, F.lit(": "), F.col("n").cast("string")).alias("value"))  # a row a kind
    report.coalesce(1).write.mode("overwrite").text(f"{path}/report")


def write_features(df: DataFrame, path: str, sequence_col: str = "sequence") -> None:
    """A dataset as CSV with the curation features of its sequences; columns that have a feature's name are replaced."""
    made = S.curation_features(F.col(sequence_col))
    kept = [c for c in df.columns if c not in made]
    df.select(*(F.col(c) for c in kept), *(v.alias(k) for k, v in made.items())).write.mode("overwrite").option("header", True).csv(path)


def write_packets(packets: DataFrame, path: str) -> None:
    """Packets of work in a folder an agent, and the manifest of their counts."""
    packets.write.mode("overwrite").partitionBy("agent").json(f"{path}/packets")
    packets.groupBy("agent", "artifact").agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as two JSON-lines tables, nodes and edges."""
    write_records(nodes, f"{path}/nodes")
    write_records(edges, f"{path}/edges")


def read_bundle(spark, path: str, kinds: list[str] | None = None, kind_col: str = "artifact_type") -> DataFrame:
    """A bundle's artifacts, of some kinds only on request (pruned by folder)."""
    d = spark.read.json(f"{path}/artifacts")
    return d.where(F.col(kind_col).isin(kinds)) if kinds else d


def card(fields: dict[str, Column], title: Column) -> Column:
    """A card as markdown text; fields that are null or blank are left out."""
    lines = [F.when(F.trim(F.coalesce(v.cast("string"), F.lit(""))) != "", F.concat(F.lit(f"- {k}: "), v.cast("string"))) for k, v in fields.items()]
    return F.concat(F.lit("# "), title, F.lit("\n\n"), F.concat_ws("\n", *lines), F.lit("\n"))


def write_cards(df: DataFrame, text_col: str, path: str, needs: tuple[str, ...] = ()) -> None:
    """Cards as text; rows whose ``needs`` (an id, a sequence) are null or blank are skipped."""
    for c in needs:
        df = df.where(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "")
    df.select(F.col(text_col).alias("value")).write.mode("overwrite").text(path)


def dead_letters(calls: DataFrame) -> DataFrame:
    """Failed calls as (agent, error_type, error_message, ts, payload)."""
    return calls.where("not ok").select("agent", "error_type", "error_message", "ts", "payload")


def split_batch(path: str, error_col: str = "error"):
    """For ``foreachBatch``: rows without an error go to the table ``good``, the others to ``dead``, both under the batch's id, so that a
    batch delivered again replaces itself in both. A micro-batch is read once a table, from the files its source has pinned."""

    def write(df: DataFrame, batch_id: int) -> None:
        bad = F.coalesce(F.col(error_col), F.lit("")) != ""
        df.where(~bad).drop(error_col).write.mode("overwrite").parquet(f"{path}/good/batch={batch_id}")
        df.where(bad).write.mode("overwrite").parquet(f"{path}/dead/batch={batch_id}")

    return write


def split_stream(stream: DataFrame, path: str, error_col: str = "error"):
    """Starts ``stream`` into the two tables of ``split_batch`` over what its source holds now."""
    return stream.writeStream.foreachBatch(split_batch(path, error_col)).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()

"""Train/test leakage between splits: exact sequences, near duplicates by blocking, and the pair budget.

Input is (row long, id, sequence, split). Pairs run from an earlier row to a later one. Blocking is an equi-join, so Spark
picks its physical form and splits hot keys; ``exact_groups`` gives a row a sequence where pairs would be many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candela.functions import sequence as S
from candela.operators import events as E
from candela.operators.staging import staged

_FINGERPRINT = ["length", "head", "tail"]


def exact_pairs(rows: DataFrame) -> DataFrame:
    """row, id, prior_row, prior_id, sequence of equal sequences in different splits."""
    a = rows.select(F.col("row").alias("prior_row"), F.col("id").alias("prior_id"), "sequence", F.col("split").alias("prior_split"))
    return rows.join(a, "sequence").where((F.col("prior_row") < F.col("row")) & (F.col("prior_split") != F.col("split"))).select("row", "id", "prior_row", "prior_id", "sequence")


def exact_links(rows: DataFrame) -> DataFrame:
    """row, id, first_row (of its sequence), n_links (rows of other splits with that sequence), where there are any: linear
    in the rows, and counts are taken per (sequence, split) before anything is joined back, so no group is gathered."""
    key = F.unhex(F.sha2("sequence", 256))
    r = rows.select("row", "id", "split", key.alias("key"))
    each = r.groupBy("key", "split").agg(F.count("*").alias("mine"), F.min("row").alias("first"))
    all_ = each.groupBy("key").agg(F.sum("mine").alias("n"), F.min("first").alias("first_row"), F.count("*").alias("n_splits")).where("n_splits > 1")
    links = each.join(all_, "key").select("key", "split", "first_row", (F.col("n") - F.col("mine")).alias("n_links"))
    return r.join(links, ["key", "split"]).select("row", "id", "first_row", "n_links")


def exact_groups(rows: DataFrame) -> DataFrame:
    """sequence, n_rows, n_splits of sequences that are in more than one split: linear however often a sequence occurs."""
    g = rows.groupBy("sequence", "split").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    return g.groupBy("sequence").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_splits"), F.min("first").alias("first_row")).where("n_splits > 1")


def fingerprinted(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.length("sequence").alias("length"), F.left("sequence", F.lit(3)).alias("head"), F.right("sequence", F.lit(3)).alias("tail"))


def near_pairs(rows: DataFrame, threshold: float = 0.95) -> DataFrame:
    """row, id, other_row, other_id, similarity of rows of one length, head and tail in different splits, at least ``threshold`` alike."""
    d = fingerprinted(rows)
    o = d.select(*_FINGERPRINT, F.col("row").alias("other_row"), F.col("id").alias("other_id"), F.col("sequence").alias("other_sequence"), F.col("split").alias("other_split"))
    j = d.join(o, _FINGERPRINT).where((F.col("other_row") < F.col("row")) & (F.col("other_split") != F.col("split")))
    j = j.withColumn("similarity", S.identity(F.col("sequence"), F.col("other_sequence"))).where(F.col("similarity") >= threshold)
    return j.select("row", "id", "other_row", "other_id", "sequence", "other_sequence", "split", "other_split", "similarity")


def distinct_rows(rows: DataFrame) -> DataFrame:
    """sequence, row (the first that has it), splits (how many rows each split has) and n_pairs (its own pairs across splits)."""
    g = rows.groupBy("sequence", "split").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    d = g.groupBy("sequence").agg(F.min("first").alias("row"), F.map_from_entries(F.collect_list(F.struct("split", "n"))).alias("splits"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    return d.select("sequence", "row", "splits", "n", ((F.col("n") * F.col("n") - F.col("squares")) / 2).cast("long").alias("n_pairs"))


def near_groups(distinct: DataFrame, threshold: float = 0.95) -> DataFrame:
    """row, other_row, similarity, n_pairs of unequal sequences of one length, head and tail: ``near_pairs`` with the copies
    of a sequence counted, not paired. ``distinct`` is ``distinct_rows``."""
    d = fingerprinted(distinct)
    o = d.select(*_FINGERPRINT, F.col("row").alias("other_row"), F.col("sequence").alias("other_sequence"), F.col("splits").alias("other_splits"), F.col("n").alias("other_n"))
    j = d.drop("n_pairs").join(o, _FINGERPRINT).where(F.col("other_row") < F.col("row")).withColumn("n_pairs", F.col("n") * F.col("other_n") - _same_split()).where("n_pairs > 0")
    return j.withColumn("similarity", S.identity(F.col("sequence"), F.col("other_sequence"))).where(F.col("similarity") >= threshold).select("row", "other_row", "similarity", "n_pairs")


def indel_groups(distinct: DataFrame, threshold: float = 0.95) -> DataFrame:
    """row, other_row (of the shorter), similarity, n_pairs of sequences whose lengths differ by one and that are alike once the longer is
    shifted to one end: ``distinct`` is ``distinct_rows``.

    None is missed: with n residues of which at most m may differ, one of m + 1 segments agrees, so a shorter sequence meets a
    longer one on (n, segment, residues), the longer with both of its ends cut. What meets is verified, each pair once."""
    n = F.col("n_short")
    most = F.greatest(n - F.ceil(F.lit(threshold) * (n + 1) - F.lit(1e-9)), F.lit(-1)).cast("int")

    def segments(text):
        begin = lambda k: F.floor(k * n / (most + 1)).cast("int")
        return F.transform(F.sequence(F.lit(0), most), lambda k: F.struct(k.alias("k"), F.substring(text, begin(k) + 1, begin(k + 1) - begin(k)).alias("residues")))

    def keyed(d, *texts):
        cut = F.concat(*(segments(t) for t in texts)) if len(texts) > 1 else segments(texts[0])
        return d.where((most >= 0) & (n > 0)).select("row", "n_short", F.explode(F.array_distinct(cut)).alias("s")).select("row", "n_short", "s.k", "s.residues")

    short = keyed(distinct.withColumn("n_short", F.length("sequence")), F.col("sequence")).withColumnRenamed("row", "other_row")
    longer = keyed(distinct.withColumn("n_short", F.length("sequence") - 1), F.substring(F.col("sequence"), F.lit(1), n), F.substring(F.col("sequence"), F.lit(2), n))
    met = longer.join(short, ["n_short", "k", "residues"]).select("row", "other_row").distinct()
    o = distinct.select(F.col("row").alias("other_row"), F.col("sequence").alias("other_sequence"), F.col("splits").alias("other_splits"), F.col("n").alias("other_n"))
    j = met.join(distinct.drop("n_pairs"), "row").join(o, "other_row").withColumn("n_pairs", F.col("n") * F.col("other_n") - _same_split()).where("n_pairs > 0")
    return j.withColumn("similarity", S.identity(F.col("sequence"), F.col("other_sequence"))).where(F.col("similarity") >= threshold).select("row", "other_row", "similarity", "n_pairs")


def _same_split():
    """Pairs of rows in one split, from the maps of two sequences."""
    return F.aggregate(F.map_entries("splits"), F.lit(0).cast("long"), lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at("other_splits", e["key"]), F.lit(0)))


def with_pairs_before(rows: DataFrame, blocks: int = 1024) -> DataFrame:
    """``rank`` in the row's block and ``pairs_before``: pairs compared before the row, in row order.

    The running sum is taken within ranges of rows and lifted by the sums of earlier ranges (``blocks`` rows), so no
    task sees all rows.
    """
    d = fingerprinted(rows).withColumn("rank", F.row_number().over(Window.partitionBy(*_FINGERPRINT).orderBy("row")))
    top = rows.agg(F.max("row")).first()[0] or 0
    d = d.withColumn("range", F.floor(F.col("row") / (top // blocks + 1)))
    sums = d.groupBy("range").agg(F.sum(F.col("rank") - 1).alias("n"))
    lift = sums.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("lift"))  # at most ``blocks`` + 1 rows
    inner = F.sum(F.col("rank") - 1).over(Window.partitionBy("range").orderBy("row")) - (F.col("rank") - 1)
    return d.withColumn("inner", inner).join(F.broadcast(lift), "range").withColumn("pairs_before", F.col("inner") + F.col("lift")).drop("inner", "lift", "range")


def near_pairs_budgeted(rows: DataFrame, threshold: float = 0.95, max_pairs: int = 25_000) -> DataFrame:
    """``near_pairs`` among the first ``max_pairs`` comparisons in row order; comparisons within a split count too."""
    d = with_pairs_before(rows)
    o = d.select(*_FINGERPRINT, F.col("rank").alias("other_rank"), F.col("row").alias("other_row"), F.col("id").alias("other_id"), F.col("sequence").alias("other_sequence"), F.col("split").alias("other_split"))
    j = d.where(F.col("pairs_before") < max_pairs).join(o, _FINGERPRINT).where((F.col("other_rank") < F.col("rank")) & (F.col("pairs_before") + F.col("other_rank") <= max_pairs) & (F.col("other_split") != F.col("split")))
    j = j.withColumn("similarity", S.identity(F.col("sequence"), F.col("other_sequence"))).where(F.col("similarity") >= threshold)
    return j.select("row", "id", "other_row", "other_id", "sequence", "other_sequence", "split", "other_split", "similarity")


def cut_row(rows: DataFrame, max_pairs: int) -> int | None:
    """The row at which the budget runs out; later rows yield no events at all."""
    d = with_pairs_before(rows).where(F.col("pairs_before") + F.col("rank") - 1 > max_pairs)
    return d.agg(F.min("row")).first()[0]


def leakage_events(rows: DataFrame, *, tags: list[str] = (), threshold: float = 0.95, max_pairs: int | None = None, strict: bool = False, grouped: bool = False) -> DataFrame:
    """Tag mismatches, exact and near leakage as events. With ``max_pairs`` the search stops in row order, with a warning.

    An event a pair of rows, or, if ``grouped``, no more than the rows allow: an exact event a row, with the first row of its sequence and
    the number of rows of other splits that have it, and a near one a pair of unequal sequences, with the pairs of rows behind it."""
    spark = rows.sparkSession
    if grouped:
        return _grouped_events(rows, tags, threshold, strict)
    near = near_pairs(rows, threshold) if max_pairs is None else near_pairs_budgeted(rows, threshold, max_pairs)
    exact, tagged, end = exact_pairs(rows), rows, []
    if max_pairs is not None and (cut := cut_row(rows, max_pairs)) is not None:
        exact, tagged = exact.where(F.col("row") <= cut), rows.where(F.col("row") <= cut)
        end = [{"severity": "warning", "code": "SPLIT_LEAKAGE_PAIRWISE_TRUNCATED", "message": f"near-duplicate search truncated at {max_pairs} pairs"}]
    c = F.col
    out = [
        exact.select(E.event("error", "SPLIT_LEAKAGE_EXACT_SEQUENCE", "exact sequence observed across multiple splits", row=c("row"), row_id=c("id"), metadata={k: c(k) for k in ("sequence", "prior_row", "prior_id")}).alias("e")).select("e.*"),
        near.select(E.event("error" if strict else "warning", "SPLIT_LEAKAGE_NEAR_DUPLICATE", F.format_string("high similarity near-duplicate sequence detected (score %.3f)", "similarity"), row_id=c("id"), metadata={k: c(k) for k in ("sequence", "other_sequence", "similarity", "split", "other_split", "row", "other_row")}).alias("e")).select("e.*"),
        E.fixed(spark, end),
    ]
    return E.union(*out, *_tag_events(tagged, tags))


def _tag_events(rows: DataFrame, tags: list[str]) -> list[DataFrame]:
    if not tags:
        return []
    wrong = rows.where((F.col("split") != "") & ~F.col("split").isin(list(tags)))
    return [wrong.select(E.event("error", "DATASET_SPLIT_TAG_MISMATCH", F.concat(F.lit("split value '"), "split", F.lit("' not in split manifest tags")), row_id=F.col("id"), metadata={"allowed": F.lit(",".join(tags))}).alias("e")).select("e.*")]


def _grouped_events(rows: DataFrame, tags: list[str], threshold: float, strict: bool) -> DataFrame:
    c = F.col
    exact = exact_links(rows).select(E.event("error", "SPLIT_LEAKAGE_EXACT_SEQUENCE", "exact sequence observed across multiple splits", row=c("row"), row_id=c("id"), metadata={k: c(k) for k in ("first_row", "n_links")}).alias("e")).select("e.*")
    near = near_groups(staged(distinct_rows(rows), "texts"), threshold).select(E.event("error" if strict else "warning", "SPLIT_LEAKAGE_NEAR_DUPLICATE", F.format_string("high similarity near-duplicate sequence detected (score %.3f)", "similarity"), row=c("row"), metadata={k: c(k) for k in ("other_row", "similarity", "n_pairs")}).alias("e")).select("e.*")
    return E.union(exact, near, *_tag_events(rows, tags))

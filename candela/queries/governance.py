"""Dataset governance and leakage over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from candela.operators import contracts as K
from candela.operators import governance as G
from candela.operators import leakage as L
from candela.functions.sequence import STANDARD
from candela.operators.staging import shared_folder, staged
from candela.queries.tables import SEQ_HASH, SEQ_RAW, SEQ_TEXT, SPLIT_ROWS, letters, repeated, repeated_sql, seq_hash, seq_raw, seq_text, split_rows, table

TAGS = ["s0", "s1"]


def identifier_validation(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, F.concat("c_name", F.lit(" x"))).when(F.col("c_custkey") % 11 == 0, F.lit("  ")).otherwise(F.col("c_name")).alias("id"))
    return c.select("c_custkey", G.identifier_reason(F.col("id")).alias("reason"))


def _keyed(spark, sf_dir):
    li = table(spark, sf_dir, "documents")
    return li.select(F.col("n_chars").cast("string").alias("id"), F.col("doc_id").alias("_row_number"))


def duplicate_ids(spark, sf_dir):
    return G.duplicate_ids(_keyed(spark, sf_dir), "id")


def split_distribution(spark, sf_dir):
    return G.split_distribution(split_rows(spark, sf_dir), "split")


def unlisted_split_tags(spark, sf_dir):
    return G.split_events(split_rows(spark, sf_dir), "split", TAGS, True).select("severity", "code", "message", "location")


def contract_event_counts(spark, sf_dir):
    d = seq_raw(spark, sf_dir).select(F.col("doc_id").alias("_row_number"), F.concat(F.lit("p"), repeated(F.col("doc_id"), 20).cast("string")).alias("peptide_id"), "sequence")
    return G.contract_events(d, allow_ambiguous=False).groupBy("severity", "code").agg(F.count("*").alias("n"))


def exact_leakage_pairs(spark, sf_dir):
    """Every row whose sequence is also in another split: the first row with it, and how many rows of other splits have it."""
    return L.exact_links(split_rows(spark, sf_dir))


def exact_leakage_groups(spark, sf_dir):
    """Equal sequences: groups with their first row, of which every pair follows."""
    return L.exact_groups(split_rows(spark, sf_dir))


def near_duplicates(spark, sf_dir):
    """Near-duplicate sequences, each by the first row that has it, and the pairs of rows in different splits behind each."""
    return L.near_groups(staged(L.distinct_rows(split_rows(spark, sf_dir)), "texts"), 0.8).select("row", "other_row", F.round("similarity", 6).alias("similarity"), "n_pairs")


def near_duplicates_budgeted(spark, sf_dir):
    return L.near_pairs_budgeted(split_rows(spark, sf_dir), 0.8, 2000).select("row", "other_row", F.round("similarity", 6).alias("similarity"))


def benchmark_leakage(spark, sf_dir):
    """Documents that share any 10 successive residues with a benchmark item, wherever they stand in both: how many different
    ones (n_shared) of how many the item has (n_item). An item of fewer than 10 residues is sought as a whole."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace(letters(F.col("text")), f"[^{STANDARD}]", "").alias("sequence")).where("sequence <> ''")
    b = b.select("item_id", F.expr("array_distinct(transform(sequence(1, greatest(length(sequence) - 9, 1)), i -> substr(sequence, i, 10)))").alias("heads"))
    b = staged(b.select("item_id", F.size("heads").alias("n_item"), F.explode("heads").alias("head")), "items")
    lengths = sorted(r[0] for r in b.select(F.length("head")).distinct().collect()) or [10]  # 10 and less: at most ten
    heads = F.concat(*(F.regexp_extract_all("sequence", F.lit(f"(?=(.{{{n}}}))"), 1) for n in lengths))  # overlapping, linear in the text
    d = seq_text(spark, sf_dir).select("doc_id", F.explode(heads).alias("head"))
    return d.join(b, "head").groupBy("doc_id", "item_id", "n_item").agg(F.count_distinct("head").alias("n_shared"))


def reference_check(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_nationkey <> 3")
    return G.unmatched(o, "o_custkey", c, "c_custkey").select("o_orderkey", "o_custkey")


def preflight_counts(spark, sf_dir):
    """The whole preflight over documents with three splits, of which the manifest lists two. Pairs are counted from groups,
    not made."""
    rows = seq_text(spark, sf_dir).select(F.col("doc_id").alias("_row_number"), F.concat(F.lit("p"), "doc_id").alias("peptide_id"), "sequence", F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")).alias("split"))
    one = G.split_events(rows, "split", TAGS, True).select("severity", "code").unionByName(G.contract_events(rows, required=["peptide_id", "sequence", "split"], allow_ambiguous=True).select("severity", "code"))
    wrong = rows.where(~F.col("split").isin(TAGS)).select(F.lit("error").alias("severity"), F.lit("DATASET_SPLIT_TAG_MISMATCH").alias("code"))
    d = staged(L.distinct_rows(split_rows(spark, sf_dir)), "texts")
    exact = d.select(F.lit("error").alias("severity"), F.lit("SPLIT_LEAKAGE_EXACT_SEQUENCE").alias("code"), F.col("n_pairs").alias("n"))
    near = d.where("sequence <> ''").select("n_pairs").unionByName(L.near_groups(d, 0.95).select("n_pairs")).select(F.lit("warning").alias("severity"), F.lit("SPLIT_LEAKAGE_NEAR_DUPLICATE").alias("code"), F.col("n_pairs").alias("n"))
    return one.unionByName(wrong).withColumn("n", F.lit(1).cast("long")).unionByName(exact).unionByName(near).groupBy("severity", "code").agg(F.sum("n").alias("n")).where("n > 0")


def indel_duplicates(spark, sf_dir):
    """Sequences of which one lacks an end residue of the other, and of every third of them another one is changed: pairs one indel apart."""
    d = seq_hash(spark, sf_dir)
    cut = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.expr("substr(sequence, 2)")).otherwise(F.expr("substr(sequence, 1, length(sequence) - 1)")).alias("s"))
    changed = cut.select((-F.col("doc_id") - 1).alias("doc_id"), F.when(F.col("doc_id") % 3 == 0, F.expr("concat(substr(s, 1, 4), 'W', substr(s, 6))")).otherwise(F.col("s")).alias("sequence"))
    rows = d.unionByName(changed).select(F.col("doc_id").alias("row"), F.col("doc_id").cast("string").alias("id"), "sequence", F.concat(F.lit("s"), F.pmod("doc_id", F.lit(2)).cast("string")).alias("split"))
    return L.indel_groups(staged(L.distinct_rows(rows), "texts"), 0.8).select("row", "other_row", F.round("similarity", 6).alias("similarity"), "n_pairs")


def preflight(spark, sf_dir):
    """The preflight job itself over documents with three splits, of which the manifest lists two: its events, grouped, by code."""
    rows = seq_text(spark, sf_dir).select(F.col("doc_id").alias("_row_number"), F.concat(F.lit("p"), "doc_id").alias("peptide_id"), "sequence", F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")).alias("split"))
    manifest = {"split_column": "split", "split_required": True, "split_tags": TAGS}
    return G.preflight(rows, manifest, strict=False, max_pairs=None, grouped=True).groupBy("severity", "code").agg(F.count("*").alias("n"))


def contract_publish(spark, sf_dir):
    """documents published under a contract in one pass: the rows that arrive, and the rows that break each expectation."""
    path = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    short = K.Expectation("short", F.length("sequence") <= 300, "warning")
    counts = K.publish(seq_text(spark, sf_dir), [K.present("doc_id"), short], lambda d: d.withColumn("score", F.length("sequence") % 101), [K.bounded("score"), K.present("score")], path)
    rows = spark.read.parquet(path).agg(F.count("*").alias("n")).select(F.lit("rows").alias("what"), "n")
    return rows.unionByName(spark.createDataFrame(list(counts.items()), "what string, n long"))


def seed_rule_counts(spark, sf_dir):
    d = seq_raw(spark, sf_dir).select(
        F.col("doc_id").alias("_row_number"), F.concat(F.lit("p"), repeated(F.col("doc_id"), 25).cast("string")).alias("peptide_id"), "sequence", F.when(F.col("doc_id") % 5 == 0, "x").when(F.col("doc_id") % 5 == 1, "").otherwise("30").alias("length"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise("n").alias("name"), F.element_at(F.array(F.lit("linear"), F.lit("Cyclic"), F.lit("ring"), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int")).alias("linear_or_cyclic"),
        F.element_at(F.array(F.lit("Unknown"), F.lit("other"), F.lit("")), (F.col("doc_id") % 3 + 1).cast("int")).alias("gram_status"), F.lit("m").alias("target_microbe"),
    )
    return G.seed_rules(d).groupBy("severity", "code").agg(F.count("*").alias("n"))


_SIM = "len(list_filter(range(1, length(a.sequence) + 1), lambda i: substr(a.sequence, i, 1) = substr(b.sequence, i, 1))) / length(a.sequence)::DOUBLE"
_BUCKET = "length(a.sequence) = length(b.sequence) AND left(a.sequence, 3) = left(b.sequence, 3) AND right(a.sequence, 3) = right(b.sequence, 3)"
_BAD20 = "regexp_matches(sequence, '[^ACDEFGHIKLMNPQRSTVWY]')"
_PRE = f"(SELECT * FROM {SPLIT_ROWS} AS t)"

QUERIES = {f.__name__: f for f in (identifier_validation, duplicate_ids, split_distribution, unlisted_split_tags, contract_event_counts, exact_leakage_pairs, exact_leakage_groups, near_duplicates, near_duplicates_budgeted, benchmark_leakage, reference_check, preflight_counts, indel_duplicates, preflight, contract_publish, seed_rule_counts)}
_WHOLE = ("contract_event_counts", "exact_leakage_groups", "near_duplicates", "preflight_counts", "seed_rule_counts", "benchmark_leakage")
QUERIES |= {f"{n}_whole": QUERIES[n] for n in _WHOLE}  # the names of the round before
_CUT = f"(SELECT doc_id AS row, sequence, doc_id % 2 AS sp FROM {SEQ_HASH} AS t UNION ALL SELECT -doc_id - 1, CASE WHEN doc_id % 3 = 0 THEN substr(s, 1, 4) || 'W' || substr(s, 6) ELSE s END, (doc_id + 1) % 2 FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN substr(sequence, 2) ELSE left(sequence, length(sequence) - 1) END AS s FROM {SEQ_HASH} AS t))"
_HITS = "len(list_filter(range(1, length(b.sequence) + 1), lambda i: substr(a.sequence, i + {}, 1) = substr(b.sequence, i, 1)))"

SQL = {
    "indel_duplicates": f"""WITH c AS (SELECT sequence, min(row) AS row, count(*) FILTER (sp = 0) AS n0, count(*) FILTER (sp = 1) AS n1 FROM {_CUT} AS t GROUP BY sequence),
      p AS (SELECT a.row, b.row AS other_row, greatest({_HITS.format(0)}, {_HITS.format(1)}) / length(a.sequence)::DOUBLE AS s, a.n0 * b.n1 + a.n1 * b.n0 AS n_pairs FROM c AS a JOIN c AS b ON length(a.sequence) = length(b.sequence) + 1 WHERE b.sequence <> '')
      SELECT row, other_row, round(s, 6) AS similarity, n_pairs FROM p WHERE s >= 0.8 AND n_pairs > 0""",
    "preflight": f"""SELECT severity, code, count(*) AS n FROM (
        SELECT 'warning' AS severity, 'DATASET_UNLISTED_SPLIT_TAG' AS code FROM (SELECT DISTINCT split FROM {_PRE} AS t WHERE split NOT IN ('s0', 's1'))
        UNION ALL SELECT 'error', 'DATASET_SPLIT_TAG_MISMATCH' FROM {_PRE} AS t WHERE split NOT IN ('s0', 's1')
        UNION ALL SELECT 'error', 'DATASET_INVALID_SEQUENCE' FROM {_PRE} AS t WHERE sequence = ''
        UNION ALL SELECT 'error', 'SPLIT_LEAKAGE_EXACT_SEQUENCE' FROM (SELECT sequence, count(*) OVER (PARTITION BY sequence) AS n, count(*) OVER (PARTITION BY sequence, split) AS m FROM {_PRE} AS t) WHERE n > m
        UNION ALL SELECT 'warning', 'SPLIT_LEAKAGE_NEAR_DUPLICATE' FROM (SELECT DISTINCT a.sequence, b.sequence AS other FROM {_PRE} AS a JOIN {_PRE} AS b ON {_BUCKET} AND a.sequence < b.sequence AND a.split <> b.split WHERE {_SIM} >= 0.95)) GROUP BY severity, code""",
    "contract_publish": f"SELECT 'rows' AS what, count(*) AS n FROM documents UNION ALL SELECT 'doc_id present', 0 UNION ALL SELECT 'score present', 0 UNION ALL SELECT 'score within [0.0, 100.0]', 0 UNION ALL SELECT 'short', count(*) FILTER (length(sequence) > 300) FROM {SEQ_TEXT} AS t",
    "identifier_validation": "SELECT c_custkey, CASE WHEN trim(id) = '' THEN 'identifier is empty' WHEN NOT regexp_matches(trim(id), '^[A-Za-z0-9][A-Za-z0-9._-]*$') THEN 'identifier has unsupported characters' END AS reason FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_name || ' x' WHEN c_custkey % 11 = 0 THEN '  ' ELSE c_name END AS id FROM customer)",
    "duplicate_ids": "SELECT id AS row_id, r AS row, f AS previous_row FROM (SELECT CAST(n_chars AS VARCHAR) AS id, doc_id AS r, min(doc_id) OVER (PARTITION BY n_chars) AS f FROM documents) WHERE r > f",
    "split_distribution": f"SELECT split, count(*) AS n FROM {SPLIT_ROWS} AS t GROUP BY split",
    "unlisted_split_tags": f"SELECT DISTINCT 'warning' AS severity, 'DATASET_UNLISTED_SPLIT_TAG' AS code, 'split value ''' || split || ''' not listed in manifest split tags' AS message, 'split' AS location FROM {SPLIT_ROWS} AS t WHERE split NOT IN ('s0', 's1')",
    "contract_event_counts": f"SELECT 'error' AS severity, code, count(*) AS n FROM (SELECT 'DATASET_INVALID_SEQUENCE' AS code FROM {SEQ_RAW} AS t WHERE sequence = '' OR {_BAD20} UNION ALL SELECT 'DATASET_DUPLICATE_ID' FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY {repeated_sql('doc_id', 20)}) AS f FROM documents) WHERE doc_id > f) GROUP BY code",
    "exact_leakage_pairs": f"SELECT row, id, first_row, n_links FROM (SELECT row, id, min(row) OVER (PARTITION BY sequence) AS first_row, count(*) OVER (PARTITION BY sequence) - count(*) OVER (PARTITION BY sequence, split) AS n_links FROM {SPLIT_ROWS} AS t) WHERE n_links > 0",
    "exact_leakage_groups": f"SELECT sequence, count(*) AS n_rows, count(DISTINCT split) AS n_splits, min(row) AS first_row FROM {SPLIT_ROWS} AS t GROUP BY sequence HAVING count(DISTINCT split) > 1",
    "near_duplicates": f"""WITH d AS (SELECT sequence, min(row) AS f FROM {SPLIT_ROWS} AS t GROUP BY sequence)
        SELECT greatest(x.f, y.f) AS row, least(x.f, y.f) AS other_row, round({_SIM}, 6) AS similarity, count(*) AS n_pairs FROM {SPLIT_ROWS} AS a JOIN {SPLIT_ROWS} AS b ON {_BUCKET} AND a.row < b.row AND a.split <> b.split AND a.sequence <> b.sequence
        JOIN d AS x ON x.sequence = a.sequence JOIN d AS y ON y.sequence = b.sequence WHERE a.sequence <> '' AND {_SIM} >= 0.8 GROUP BY 1, 2, 3""",
    "near_duplicates_budgeted": f"""WITH p AS (SELECT a.row AS r, b.row AS o, a.split AS s, b.split AS t, a.sequence AS x, row_number() OVER (ORDER BY a.row, b.row) AS k, {_SIM} AS sim
        FROM {SPLIT_ROWS} AS a JOIN {SPLIT_ROWS} AS b ON {_BUCKET} AND b.row < a.row)
        SELECT r AS row, o AS other_row, round(sim, 6) AS similarity FROM p WHERE k <= 2000 AND s <> t AND x <> '' AND sim >= 0.8""",
    "benchmark_leakage": f"""WITH b AS (SELECT item_id, sequence, least(length(sequence), 10) AS w FROM {SEQ_TEXT.replace("doc_id", "item_id").replace("FROM documents", "FROM benchmark")} AS t WHERE sequence <> ''),
        k AS (SELECT DISTINCT item_id, w, substr(sequence, unnest(range(1, length(sequence) - w + 2)), w) AS head FROM b), n AS (SELECT item_id, count(*) AS n_item FROM k GROUP BY item_id),
        d AS (SELECT DISTINCT doc_id, w, substr(sequence, unnest(range(1, length(sequence) - w + 2)), w) AS head FROM {SEQ_TEXT} AS t, (SELECT DISTINCT w FROM k) AS ws WHERE length(sequence) >= w)
        SELECT doc_id, item_id, CAST(n_item AS INT) AS n_item, count(*) AS n_shared FROM d JOIN k USING (w, head) JOIN n USING (item_id) GROUP BY ALL""",
    "reference_check": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3)",
    "preflight_counts": f"""SELECT severity, code, count(*) AS n FROM (
        SELECT 'warning' AS severity, 'DATASET_UNLISTED_SPLIT_TAG' AS code FROM (SELECT DISTINCT split FROM {_PRE} AS t WHERE split NOT IN ('s0', 's1'))
        UNION ALL SELECT 'error', 'DATASET_SPLIT_TAG_MISMATCH' FROM {_PRE} AS t WHERE split NOT IN ('s0', 's1')
        UNION ALL SELECT 'error', 'DATASET_INVALID_SEQUENCE' FROM {_PRE} AS t WHERE sequence = ''
        UNION ALL SELECT 'error', 'SPLIT_LEAKAGE_EXACT_SEQUENCE' FROM {_PRE} AS a JOIN {_PRE} AS b ON a.sequence = b.sequence AND a.row < b.row AND a.split <> b.split
        UNION ALL SELECT 'warning', 'SPLIT_LEAKAGE_NEAR_DUPLICATE' FROM {_PRE} AS a JOIN {_PRE} AS b ON {_BUCKET} AND a.row < b.row AND a.split <> b.split WHERE a.sequence <> '' AND {_SIM} >= 0.95) GROUP BY severity, code""",
    "seed_rule_counts": f"""WITH s AS (SELECT doc_id AS r, 'p' || {repeated_sql('doc_id', 25)} AS id, sequence, CASE WHEN doc_id % 5 = 0 THEN 'x' WHEN doc_id % 5 = 1 THEN '' ELSE '30' END AS len,
        doc_id % 3 = 0 AS noname, ['linear', 'Cyclic', 'ring', ''][doc_id % 4 + 1] AS top, ['Unknown', 'other', ''][doc_id % 3 + 1] AS gram FROM {SEQ_RAW} AS t)
        SELECT severity, code, count(*) AS n FROM (
        SELECT 'error' AS severity, 'SEED_DUPLICATE_ID' AS code FROM (SELECT r, min(r) OVER (PARTITION BY id) AS f FROM s) WHERE r > f
        UNION ALL SELECT 'error', 'SEED_SEQUENCE' FROM s WHERE sequence = '' OR {_BAD20}
        UNION ALL SELECT 'error', 'SEED_LENGTH_REQUIRED' FROM s WHERE len = '' UNION ALL SELECT 'error', 'SEED_LENGTH_NOT_INTEGER' FROM s WHERE len = 'x'
        UNION ALL SELECT 'warning', 'SEED_LENGTH_MISMATCH' FROM s WHERE len = '30' AND length(sequence) <> 30 UNION ALL SELECT 'warning', 'SEED_NAME_EMPTY' FROM s WHERE noname
        UNION ALL SELECT 'warning', 'SEED_TOPOLOGY_MISSING' FROM s WHERE top = '' UNION ALL SELECT 'error', 'SEED_TOPOLOGY' FROM s WHERE top = 'ring'
        UNION ALL SELECT 'warning', 'SEED_GRAM_STATUS' FROM s WHERE gram = 'other' UNION ALL SELECT 'warning', 'SEED_GRAM_STATUS_MISSING' FROM s WHERE gram = '') GROUP BY severity, code""",
}
SQL |= {f"{n}_whole": SQL[n] for n in _WHOLE if n in SQL}

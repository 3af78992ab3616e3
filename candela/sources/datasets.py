"""Dataset sources: CSV with record numbers, split manifests, telemetry drops, graphs, result documents, artifact files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The manifest's own keys.
MANIFEST_REQUIRED = ["dataset_id", "split_method", "split_column"]
MANIFEST_KNOWN = [*MANIFEST_REQUIRED, "split_required", "split_tags", "homology_guard", "dataset_version", "source_reference", "notes", "created_at", "generated_by"]


def numbered(df: DataFrame, first: int = 2, name: str = "_row_number") -> DataFrame:
    """Records numbered in file order from ``first``: the order within parts plus the sizes of earlier parts (a row a part)."""
    d = df.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33))
    base = d.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__id").alias("__from"))
    base = base.select("__part", "__from", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return d.join(F.broadcast(base), "__part").withColumn(name, F.col("__before") + F.col("__id") - F.col("__from") + first).drop("__id", "__part", "__from", "__before")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def empty_files(spark: SparkSession, path: str, recursive: bool = True) -> list[str]:
    """JSON files without content, which Spark's readers pass over: from the same listing that a read starts with."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, out = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, recursive), []
    while found.hasNext():
        f = found.next()
        name = f.getPath().toString()
        if f.getLen() == 0 and name.endswith((".json", ".jsonl")):
            out.append(name)
    return out


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file or folder with a header: every value a trimmed string, ``_row_number`` from 2."""
    d = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return numbered(d.select(*(F.trim(F.col(f"`{c}`")).alias(c) for c in d.columns)))


def read_typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``read_dataset`` with the columns of a DDL ``schema``: values that don't fit are null and their columns listed in
    ``_invalid``; columns that the file lacks are null."""
    from pyspark.sql.types import StructType

    d = read_dataset(spark, path)
    have = {c.lower(): c for c in d.columns}
    raw = {f.name: F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None).cast("string") for f in StructType.fromDDL(schema)}
    cast = {f.name: raw[f.name].try_cast(f.dataType) for f in StructType.fromDDL(schema)}
    bad = F.array_compact(F.array(*(F.when((raw[n] != "") & c.isNull(), F.lit(n)) for n, c in cast.items())))
    return d.select("_row_number", *(c.alias(n) for n, c in cast.items()), bad.alias("_invalid"))


def read_by_schema(spark: SparkSession, path: str, schema: str, mode: str = "PERMISSIVE") -> DataFrame:
    """A CSV file or folder with a header, read by a DDL ``schema`` into types. PERMISSIVE keeps every record, what does not fit as null
    and the record's text in ``_corrupt_record``; FAILFAST stops at the first; DROPMALFORMED leaves them out."""
    from pyspark.sql.types import StringType, StructType

    kinds = StructType.fromDDL(schema)
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", mode)
    if mode == "PERMISSIVE":
        return reader.option("columnNameOfCorruptRecord", "_corrupt_record").schema(StructType([*kinds.fields]).add("_corrupt_record", StringType())).csv(path)
    return reader.schema(kinds).csv(path)


def expanded(spark: SparkSession, paths: list[str], suffixes: tuple[str, ...] = (".json", ".jsonl")) -> tuple[list[str], DataFrame]:
    """The files of a list of files and folders, sorted and each once, and (path, error) rows of what is missing or has
    another suffix. Only the listing that a read starts with is on the driver."""
    conf, files, wrong = spark._jsc.hadoopConfiguration(), set(), []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        if not fs.exists(p):
            wrong.append((path, "file does not exist"))
            continue
        status = fs.getFileStatus(p)
        if status.isFile():
            name = status.getPath().toString()
            files.add(name) if name.endswith(suffixes) else wrong.append((path, f"unsupported suffix, expected one of {', '.join(suffixes)}"))
            continue
        found = fs.listFiles(p, True)
        while found.hasNext():
            name = found.next().getPath().toString()
            if name.endswith(suffixes):
                files.add(name)
    return sorted(files), spark.createDataFrame(wrong, "path string, error string")


def load_manifest(spark: SparkSession, path: str) -> tuple[dict | None, list[dict]]:
    """(manifest, events): a JSON object with defaults filled in and unknown keys under ``extra``; None if unusable."""
    def bad(code: str, message: str) -> dict:
        return {"severity": "error", "code": f"SPLIT_MANIFEST_{code}", "message": message, "location": path}

    if not exists(spark, path):
        return None, [bad("NOT_FOUND", f"split manifest file does not exist: {path}")]
    text = spark.read.text(path, wholetext=True).first()
    try:
        raw = json.loads(text[0] if text else "")
    except ValueError as e:
        return None, [bad("PARSE_ERROR", f"could not parse split manifest: {e}")]
    if not isinstance(raw, dict):
        return None, [bad("INVALID_FORMAT", "split manifest must be a JSON object")]
    if missing := [k for k in MANIFEST_REQUIRED if k not in raw]:
        return None, [bad("MISSING_FIELDS", f"split manifest missing required fields: {', '.join(missing)}")]
    events, tags, guard = [], raw.get("split_tags") or [], raw.get("homology_guard") or {}
    if not isinstance(tags, list):
        events, tags = [*events, bad("INVALID_SPLIT_TAGS", "split_tags must be a JSON list")], []
    if not isinstance(guard, dict):
        events, guard = [*events, bad("INVALID_GUARD", "homology_guard must be an object")], {}
    known = {k: str(raw[k]) for k in MANIFEST_REQUIRED} | {k: raw.get(k) for k in MANIFEST_KNOWN[6:]}
    return known | {"split_required": bool(raw.get("split_required", True)), "split_tags": [str(t) for t in tags], "homology_guard": guard, "extra": {k: v for k, v in raw.items() if k not in MANIFEST_KNOWN}}, events


def telemetry_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV drop as (ingest_order, fields map)."""
    d = spark.read.option("header", True).csv(path)
    pairs = [x for c in d.columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    return numbered(d.select(F.create_map(*pairs).alias("fields")), 0, "ingest_order")


def telemetry_json(docs: DataFrame, text_col: str = "value") -> DataFrame:
    """JSON drops - a list, an object with ``records`` or ``candidates``, or one object - as (ingest_order, fields map)."""
    v = F.try_parse_json(text_col)
    d = docs.select(v.alias("v")).withColumn("kind", F.schema_of_variant("v"))
    get = lambda k: F.try_variant_get("v", f"$.{k}", "array<map<string,string>>")
    item = F.when(F.col("kind").startswith("ARRAY"), F.try_variant_get("v", "$", "array<map<string,string>>")).otherwise(F.coalesce(get("records"), get("candidates"), F.array(F.try_variant_get("v", "$", "map<string,string>"))))
    return d.select(F.posexplode(item).alias("ingest_order", "fields")).where("fields is not null")


def documents(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.option("recursiveFileLookup", recursive).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def graph(payloads: DataFrame, json_col: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of JSON graphs with ``nodes`` and ``edges`` lists."""
    d = payloads.select(F.try_parse_json(json_col).alias("v"))
    nodes = d.select(F.explode(F.try_variant_get("v", "$.nodes", "array<variant>")).alias("n"))
    edges = d.select(F.explode(F.try_variant_get("v", "$.edges", "array<variant>")).alias("e"))
    s = lambda c, k: F.try_variant_get(c, f"$.{k}", "string")
    return nodes.select(s("n", "id").alias("id"), s("n", "node_type").alias("node_type"), F.to_json(F.try_variant_get("n", "$.payload", "variant")).alias("payload")), edges.select(s("e", "source").alias("source"), s("e", "target").alias("target"), s("e", "edge_type").alias("edge_type"))


def edge_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("source string, target string, edge_type string").csv(path)


def json_payloads(spark: SparkSession, path: str, recursive: bool = True, pattern: str = "*.{json,jsonl}") -> DataFrame:
    """(path, index, payload, error) of JSON and JSON-lines files: a top-level list gives a row an item, a JSONL file a row
    a line, an object one row without index; what does not parse, and empty files, have an error. A JSON file all of whose
    lines are JSON on their own, as Spark writes them, counts as JSON lines."""
    blank = spark.createDataFrame([(f, None, "") for f in empty_files(spark, path, recursive)], "path string, index int, payload string")
    files = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    each = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    by_line = F.col("path").endswith(".jsonl") | ((F.size(each) > 1) & F.forall(each, lambda x: F.try_parse_json(x).isNotNull()))
    files = files.withColumn("by_line", by_line)
    lines = files.where("by_line").select("path", F.posexplode(F.split("text", "\n")).alias("index", "payload")).where(F.trim("payload") != "")
    whole = files.where("not by_line").withColumn("v", F.try_parse_json("text"))
    is_list = F.schema_of_variant("v").startswith("ARRAY")
    items = whole.where(is_list).select("path", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("index", "x")).select("path", "index", F.to_json("x").alias("payload"))
    single = whole.where(~F.coalesce(is_list, F.lit(False))).select("path", F.lit(None).cast("int").alias("index"), F.col("text").alias("payload"))
    error = F.when(F.trim(F.coalesce("payload", F.lit(""))) == "", "file is empty").when(F.try_parse_json("payload").isNull(), "invalid JSON")
    return lines.unionByName(items).unionByName(single).unionByName(blank).withColumn("error", error)


def candidate_records(spark: SparkSession, path: str, reset_status: bool = False) -> DataFrame:
    """Candidates of a folder of JSON records: what lacks an id, a sequence or its references is skipped, of equal ids the
    last file wins, statuses other than draft, scored, tested and selected become scored on request."""
    d = json_payloads(spark, path).where("error is null").withColumn("v", F.try_parse_json("payload"))
    s = lambda k, t="string": F.try_variant_get("v", f"$.{k}", t)
    status = F.coalesce(s("status"), F.lit("draft"))
    status = F.when(status.isin("draft", "scored", "tested", "selected"), status).otherwise("scored") if reset_status else status
    d = d.select("path", "index", s("candidate_id").alias("candidate_id"), s("sequence").alias("sequence"), s("target_id").alias("target_id"), s("hypothesis_id").alias("hypothesis_id"), F.coalesce(s("modality"), F.lit("unknown")).alias("modality"), s("manufacturability_score", "double").alias("manufacturability_score"), F.coalesce(s("risk_flags", "array<string>"), F.array().cast("array<string>")).alias("risk_flags"), status.alias("status"))
    d = d.where("candidate_id is not null and sequence is not null and target_id is not null and hypothesis_id is not null")
    w = Window.partitionBy("candidate_id").orderBy(F.desc("path"), F.desc("index"))
    return d.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "path", "index")

"""Helpers shared by the training-data operators: ASCII word cutting, shared-folder tables, Arrow mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of one Arrow batch are handed to a Python helper in slices of about this many bytes.
SLICE_BYTES = 4 << 20

_SPACE = b" \t\n\x0b\x0c\r"
#: Bytes A-Z lowered, all else kept.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes A-Z lowered; every other ASCII byte outside 0-9 and a-z becomes a space.
ALNUM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ``[0-9a-z]`` and non-ASCII characters, as UTF-8."""
    return text.encode("utf-8", "replace").translate(ALNUM_BYTES).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Runs of characters other than space and ``\\x09-\\x0d``, as UTF-8."""
    return text.encode("utf-8", "replace").split() if text else []


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset a temporary folder serves a
    local session; on a cluster it would be another folder on every machine, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Folders written by ``stored`` while a ``scratch`` is open.
_MADE: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """The folders that ``stored`` writes inside; those still listed at the end are removed."""
    _MADE.append([])
    try:
        yield _MADE[-1]
    finally:
        for path in _MADE.pop():
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Spark's own switch that removes a query's shuffle files once the query has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts the lineage and survives lost executors.

    The shuffle files behind it go once it is written, so a job of several such steps needs the disk of its largest.
    """
    spark, path = df.sparkSession, f"{shared_root(df.sparkSession)}/candela-{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
        if _MADE:
            _MADE[-1].append(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes, one row at least."""
    rows = batch.num_rows
    step = max(1, int(rows * limit / max(batch.nbytes, 1)))
    for at in range(0, rows, step):
        yield batch.slice(at, step)


#: Spark's bound on the bytes of one Arrow batch, and its default.
BATCH_BYTES, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """8 MB an Arrow batch instead of 64, unless the session has its own bound: texts are long, and a task holds a batch on both sides."""
    if spark.conf.get(BATCH_BYTES) == BATCH_DEFAULT:
        spark.conf.set(BATCH_BYTES, "8m")


def with_columns(df: DataFrame, fields: Sequence[T.StructField], make: Callable[[], Callable], inputs: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep`` columns of ``df`` plus ``fields``, which ``make()(*input columns as lists)`` computes row by row in Arrow batches.

    ``make`` runs once a task, so what it builds (a cache, a pattern table) lives as long as the task.
    A kept column that bears a field's name gives way to the field.
    """
    own = {f.name.lower() for f in fields}
    keep = [c for c in keep if c.lower() not in own]
    schema = T.StructType([df.schema[c] for c in keep] + list(fields))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        apply, kinds = make(), [to_arrow_type(f.dataType) for f in fields]
        for batch in batches:
            for part in slices(batch):
                made = apply(*(part.column(c).to_pylist() for c in inputs))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(v, k) for v, k in zip(made, kinds, strict=True))], names=schema.names)

    small_batches(df.sparkSession)
    return df.select(*dict.fromkeys([*keep, *inputs])).mapInArrow(run, schema)

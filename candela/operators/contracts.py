"""Expectations before and after a transformation, as column predicates; fatal ones stop the job."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from candela.operators import events as E


@dataclass(frozen=True)
class Expectation:
    name: str
    predicate: Column
    severity: str = "fatal"


class ContractBroken(ValueError):
    """Raised when a fatal expectation does not hold for some row."""


def valid_sequence(column: str = "sequence", least: int = 2, most: int = 100) -> Expectation:
    s = F.upper(F.trim(column))
    return Expectation(f"{column} is a sequence of {least} to {most} standard residues", s.rlike("^[ACDEFGHIKLMNPQRSTVWY]+$") & F.length(s).between(least, most))


def present(*columns: str) -> Expectation:
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).isNotNull()
    return Expectation(f"{', '.join(columns)} present", cond)


def bounded(column: str, low: float = 0.0, high: float = 100.0) -> Expectation:
    return Expectation(f"{column} within [{low}, {high}]", F.col(column).between(low, high))


def violations(df: DataFrame, expectations: list[Expectation], id_col: str | None = None) -> DataFrame:
    """An event a row and broken expectation; a null predicate is broken."""
    row_id = F.col(id_col) if id_col else None
    return E.where_true(df, [(~F.coalesce(x.predicate, F.lit(False)), E.event("error" if x.severity == "fatal" else "warning", "CONTRACT_BROKEN", x.name, row_id=row_id)) for x in expectations])


def broken_counts(df: DataFrame, expectations: list[Expectation]) -> dict[str, int]:
    """Rows that break each expectation, in one aggregate."""
    if not expectations:
        return {}
    return df.agg(*(F.count_if(~F.coalesce(x.predicate, F.lit(False))).alias(str(k)) for k, x in enumerate(expectations))).first().asDict()


def enforce(df: DataFrame, expectations: list[Expectation], when: str) -> DataFrame:
    counts = broken_counts(df, expectations)
    fatal = [f"{x.name} ({counts[str(k)]} rows)" for k, x in enumerate(expectations) if x.severity == "fatal" and counts[str(k)]]
    if fatal:
        raise ContractBroken(f"{when}: " + "; ".join(fatal))
    return df


def with_contract(before: list[Expectation], job: Callable[[DataFrame], DataFrame], after: list[Expectation]) -> Callable[[DataFrame], DataFrame]:
    """For ``df.transform``: assumptions are checked on the input, guarantees on the output."""
    return lambda df: enforce(job(enforce(df, before, "assumption")), after, "guarantee")


def observed(df: DataFrame, expectations: list[Expectation]) -> tuple[DataFrame, Observation]:
    """``df`` with the broken rows of each expectation counted in whatever pass reads it."""
    seen = Observation(f"contract-{uuid.uuid4().hex}")
    counts = [F.count_if(~F.coalesce(x.predicate, F.lit(False))).alias(str(k)) for k, x in enumerate(expectations)]
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts), seen


def publish(df: DataFrame, before: list[Expectation], job: Callable[[DataFrame], DataFrame], after: list[Expectation], path: str) -> dict[str, int]:
    """Runs ``job`` and writes its rows as Parquet to ``path``, in one pass: assumptions and guarantees are counted on the way. The rows are
    written beside and moved to ``path`` only if no fatal expectation is broken; else nothing stays and ContractBroken is raised.
    Returns the broken rows by expectation, of warnings too. A session that has observed cannot ship Spark ML models that keep their
    training summary, which holds the session: score with their coefficients, or with a model that was saved and loaded."""
    spark, aside = df.sparkSession, f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    source, first = observed(df, before)
    made, last = observed(job(source), after)
    made.write.parquet(aside)
    counts = {x.name: seen.get[str(k)] for seen, of in ((first, before), (last, after)) for k, x in enumerate(of)}
    fatal = [f"{x.name} ({counts[x.name]} rows)" for x in [*before, *after] if x.severity == "fatal" and counts[x.name]]
    to, at = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, aside))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fatal:
        fs.delete(at, True)
        raise ContractBroken("; ".join(fatal))
    if not fs.rename(at, to):
        fs.delete(at, True)
        raise FileExistsError(path)
    return counts

"""Small roll-ups over datasets: distinct targets and sources, causal attribution of failures, feasibility weighting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which kind of cause a failure code points to.
CAUSES = {
    "synthesis": ["SYN_"],
    "purification": ["PURIFICATION_", "COELUTING_", "ANALYTICAL_", "LCMS_"],
    "solubility": ["LOW_AQUEOUS_", "PRECIPITATION", "AGGREGATI"],
    "binding": ["NO_BINDING", "WEAK_BINDING", "WRONG_BINDING"],
    "model": ["MODEL_", "DOCKING_", "STRUCTURE_", "DATA_LEAKAGE"],
}


def distinct_parts(df: DataFrame, column: str, separator: str = ";") -> DataFrame:
    """(value, n): the distinct trimmed parts of a separated column, with the rows that hold them."""
    parts = F.array_distinct(F.filter(F.transform(F.split(column, separator), lambda x: F.trim(x)), lambda x: x != ""))
    return df.select(F.explode(parts).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def causes(modes: Column) -> Column:
    """The causes that a list of failure codes points to, in the order of the codes; other codes are "other"."""
    def cause(code: Column) -> Column:
        out = F.lit("other")
        for name, starts in reversed(CAUSES.items()):
            out = F.when(code.rlike(f"^({'|'.join(starts)})"), name).otherwise(out)
        return out

    return F.array_distinct(F.transform(modes, cause))


def attribution(results: DataFrame) -> DataFrame:
    """(cause, n) over results with failure_modes."""
    return results.select(F.explode(causes(F.col("failure_modes"))).alias("cause")).groupBy("cause").agg(F.count("*").alias("n"))


def feasible(acquisition: Column, feasibility: Column) -> Column:
    """Acquisition weighted by the probability that a candidate can be made and measured."""
    return acquisition * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(feasibility, F.lit(1.0))))


def feasibility_model(history: DataFrame, vector_col: str = "x", made_col: str = "made", rounds: int = 20):
    """A logistic model of ``made`` (0/1) on the feature vectors, fitted by Spark ML; ``transform`` adds probability."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    d = history.withColumn("features", array_to_vector(vector_col)).withColumn("label", F.col(made_col).cast("double"))
    return Pipeline(stages=[LogisticRegression(maxIter=rounds, regParam=0.01)]).fit(d)


def with_feasibility(candidates: DataFrame, model, vector_col: str = "x", acquisition_col: str = "acquisition") -> DataFrame:
    """``candidates`` with the model's probability as feasibility, from its coefficients in built-in functions, and the weighted acquisition."""
    fitted = model.stages[-1]
    weights = F.array(*(F.lit(float(w)) for w in fitted.coefficients.toArray()))
    score = F.aggregate(F.zip_with(vector_col, weights, lambda x, w: x * w), F.lit(float(fitted.intercept)), lambda a, v: a + v)
    d = candidates.withColumn("feasibility", 1.0 / (1.0 + F.exp(-score)))
    return d.withColumn("weighted_acquisition", feasible(F.col(acquisition_col), F.col("feasibility")))

"""Gaussian regression from mergeable statistics, and the optimality check
of a logistic one (M10-M12, C3, C11).

``gaussian_fit`` needs one aggregate over the rows: their number, means and
the (co)variances of response and predictors, which Spark merges from partial
ones without cancellation.  The normal equations, standard errors and
deviances follow from that single row, inside the plan.

``score_equations`` states what makes a logistic fit optimal: for the
intercept and every feature the mean of feature times probability equals the
mean of feature times label.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def two_sided_p(t: float, degrees: float) -> float:
    """Probability that Student's t of ``degrees`` lies beyond +-t: the
    regularised incomplete beta function at degrees / (degrees + t^2), by its
    continued fraction."""
    if not degrees > 0 or math.isnan(t):
        return math.nan
    x, a, b = degrees / (degrees + t * t), degrees / 2, 0.5
    if x >= 1:
        return 1.0
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        x, a, b = 1 - x, b, a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    total = d
    for m in range(1, 1000):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                          -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + numerator * d)
            c = 1 + numerator / c
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    return 1 - front * total if flip else front * total


def sufficient_statistics(df: DataFrame, response: str, predictors: Sequence[str]) -> DataFrame:
    """One row: n, the means and the upper triangle of population
    (co)variances of response and predictors, over the rows without nulls."""
    columns = [response, *predictors]
    rows = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]).dropna()
    k = range(len(columns))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(f"v{i}") for i in k]).alias("means"),
                    F.array(*[F.covar_pop(f"v{i}", f"v{j}") for i in k for j in k if i <= j]).alias("moments"))


def _solved(predictors: Sequence[str]):
    names = ["(Intercept)", *predictors]

    def solved(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for row in batch.to_pylist():
                n, means, k = row["n"], np.array(row["means"], float), len(names)
                free = n - k
                if free <= 0:
                    continue
                c = np.zeros((k, k))
                c[np.triu_indices(k)] = row["moments"]
                c = n * (c + np.triu(c, 1).T)
                inverse = np.linalg.pinv(c[1:, 1:])
                slopes = inverse @ c[1:, 0]
                rest = max(float(c[0, 0] - slopes @ c[1:, 0]), 0.0)
                dispersion = rest / free
                estimates = [float(means[0] - slopes @ means[1:]), *slopes.tolist()]
                variances = [1 / n + float(means[1:] @ inverse @ means[1:]), *np.diag(inverse).tolist()]
                errors = [math.sqrt(dispersion * v) for v in variances]
                t = [e / s if s else math.nan for e, s in zip(estimates, errors, strict=True)]
                aic = n * (math.log(2 * math.pi * rest / n) + 1) + 2 + 2 * k if rest else -math.inf
                yield pa.RecordBatch.from_pylist([
                    {"term": name, "estimate": e, "std_error": s, "t_value": x, "p_value": two_sided_p(x, free), "n": n, "df_residual": free,
                     "deviance": rest, "null_deviance": float(c[0, 0]), "dispersion": dispersion, "aic": aic}
                    for name, e, s, x in zip(names, estimates, errors, t, strict=True)], _FIT)
    return solved


_FIT = pa.schema([("term", pa.string()), *[(c, pa.float64()) for c in ("estimate", "std_error", "t_value", "p_value")],
                  ("n", pa.int64()), ("df_residual", pa.int64()),
                  *[(c, pa.float64()) for c in ("deviance", "null_deviance", "dispersion", "aic")]])


def gaussian_fit(df: DataFrame, response: str, predictors: Sequence[str]) -> DataFrame:
    """Least squares of ``response`` on ``predictors`` with
    intercept.  One row a term: term, estimate, std_error, t_value, p_value,
    and on each the model's n, df_residual, deviance, null_deviance,
    dispersion and aic.  No rows when the rows do not exceed the terms."""
    kinds = {pa.string(): "string", pa.int64(): "long", pa.float64(): "double"}
    return sufficient_statistics(df, response, predictors).mapInArrow(
        _solved(list(predictors)), ", ".join(f"{f.name} {kinds[f.type]}" for f in _FIT))


def score_equations(scored: DataFrame, features: Sequence[str], features_col: str = "features", label_col: str = "bugfix_double",
                    probability_col: str = "probability") -> DataFrame:
    """One row a term: ``term, observed`` (mean of feature times label) and
    ``fitted`` (mean of feature times probability), in one aggregate over a
    scored table.  A logistic fit without penalty is optimal exactly where
    the two are equal for all terms."""
    x, p = vector_to_array(F.col(features_col)), vector_to_array(F.col(probability_col))[1]
    rows = scored.select(F.concat(F.array(F.lit(1.0)), x).alias("x"), F.col(label_col).alias("y"), p.alias("p"))
    names = ["(Intercept)", *features]
    sums = [F.struct(F.lit(name).alias("term"), F.avg(F.col("x")[i] * F.col("y")).alias("observed"),
                     F.avg(F.col("x")[i] * F.col("p")).alias("fitted")) for i, name in enumerate(names)]
    return rows.agg(F.array(*sums).alias("s")).select(F.explode("s").alias("s")).select("s.*")

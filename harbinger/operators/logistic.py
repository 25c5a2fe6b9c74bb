"""Logistic fits and medians whose every step is one counted aggregate.

The fit is iteratively reweighted least squares: a step sums the weighted moments of the
rows inside tasks, adds them up, and solves a system as wide as the features. The number of
steps is fixed, so the same rows give the same curve whatever the partitions are.

Medians are exact: a pass counts the values of every column in equal buckets between the
known ends, and goes on inside the bucket that holds the middle, until that holds one value.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbinger.operators.learn import LABEL
from harbinger.sources.shared import settle

STEPS = 8
BUCKETS = 256


# -- medians -------------------------------------------------------------------------------


def _known(column: str) -> Column:
    value = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def exact_medians(df: DataFrame, columns: Sequence[str], buckets: int = BUCKETS) -> dict[str, float | None]:
    """The median of every column: the middle value, or the mean of the two middle ones.

    Nulls, NaN and infinities are left out; a column without values has None. A pass costs
    one aggregate with ``buckets`` rows a column at most, and every pass shortens the range
    at least to what lies between two neighbouring values of it.
    """
    columns = list(columns)
    df = settle(df.select(*[_known(c).alias(c) for c in columns]))  # read once a pass
    ends = df.agg(
        *[f(f"`{c}`").alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
    ).first()
    found: dict[tuple[int, int], float] = {}
    # (column, middle) -> the range it lies in and its rank there
    open_: dict[tuple[int, int], tuple[float, float, int]] = {}
    for i in range(len(columns)):
        if ends[f"n{i}"]:
            for middle in (0, 1):
                open_[i, middle] = (ends[f"lo{i}"], ends[f"hi{i}"], (ends[f"n{i}"] - 1 + middle) // 2)
    while True:
        for key, (low, high, _) in list(open_.items()):
            if low == high:
                found[key] = low
                del open_[key]
        if not open_:
            break
        ranges = sorted({(i, low, high) for (i, _), (low, high, _) in open_.items()})
        places = []
        for number, (i, low, high) in enumerate(ranges):
            value = F.col(f"`{columns[i]}`")
            # halves, so that the width of the widest range is still a number
            share = (value / 2 - low / 2) / (high / 2 - low / 2)
            bucket = F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int")
            inside = value.between(low, high)
            places.append(F.when(inside, F.struct(F.lit(number).alias("range"), bucket.alias("bucket"), value.alias("value"))))
        each = df.select(F.explode(F.array_compact(F.array(*places))).alias("p")).select("p.*")
        counted = each.groupBy("range", "bucket").agg(
            F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
        )
        by_range: dict[int, list] = {}
        for r in sorted(counted.collect(), key=lambda r: (r["range"], r["bucket"])):
            by_range.setdefault(r["range"], []).append(r)
        for key, (low, high, rank) in list(open_.items()):
            for r in by_range[ranges.index((key[0], low, high))]:
                if rank < r["n"]:
                    open_[key] = (r["low"], r["high"], rank)
                    break
                rank -= r["n"]
    return {c: (found[i, 0] + found[i, 1]) / 2 if (i, 0) in found else None for i, c in enumerate(columns)}


def median_impute(df: DataFrame, columns: Sequence[str], medians: dict[str, float | None] | None = None) -> DataFrame:
    """Columns as doubles with missing values replaced by the median; 0 where there is none."""
    medians = exact_medians(df, columns) if medians is None else medians
    return df.withColumns({c: F.coalesce(_known(c), F.lit(float(medians[c] or 0.0))) for c in columns})


# -- logistic curve ------------------------------------------------------------------------


@dataclass(frozen=True)
class LogisticCurve:
    """Centre, scale and coefficient of every feature, and the intercept."""

    features: tuple[str, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def probability(self) -> Column:
        terms = zip(self.features, self.centre, self.scale, self.coefficients, strict=True)
        linear = F.lit(self.intercept)
        for name, centre, scale, coefficient in terms:
            linear = linear + F.lit(coefficient) * (F.col(f"`{name}`") - F.lit(centre)) / F.lit(scale)
        return 1.0 / (1.0 + F.exp(-linear))


def _moments(rows: DataFrame, d: int, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(information matrix, gradient) of the weighted log loss, the intercept first."""
    width = d + 1

    def run(batches):
        total = np.zeros(width * width + width)
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), *[batch.column(i).to_numpy() for i in range(d)]])
            y, s = batch.column(d).to_numpy(), batch.column(d + 1).to_numpy()
            p = 1 / (1 + np.exp(-(x @ beta)))
            total[: width * width] += (x.T @ (x * (s * p * (1 - p))[:, None])).ravel()
            total[width * width :] += x.T @ (s * (y - p))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "value"])

    sums = rows.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    flat = np.zeros(width * width + width)
    for r in sums.collect():  # as many numbers as the square of the features
        flat[r["place"]] = r["value"]
    return flat[: width * width].reshape(width, width), flat[width * width :]


def fit_logistic(
    df: DataFrame, features: Sequence[str], label: str = LABEL, balanced: bool = True, standardise: bool = True,
    penalty: float = 1.0, steps: int = STEPS,
) -> LogisticCurve:
    """The logistic curve after a fixed number of Newton steps from zero.

    The loss is the weighted sum of log losses plus half the ``penalty`` on the squared
    coefficients; the intercept is free. ``balanced`` gives both classes the same weight,
    ``standardise`` centres and divides by the population deviation (1 where that is 0).
    Rows with a missing label or feature are left out.
    """
    features = list(features)
    y = F.col(f"`{label}`").cast("double")
    rows = df.select(*[_known(c).alias(f"x{i}") for i, c in enumerate(features)], y.alias("y")).dropna()
    rows = settle(rows)
    facts = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("pos"),
        *[f(f"x{i}").alias(f"{k}{i}") for i in range(len(features)) for k, f in (("m", F.avg), ("s", F.stddev_pop))],
    ).first()
    n, pos = facts["n"], facts["pos"]
    centre, scale = [0.0] * len(features), [1.0] * len(features)
    if standardise and n:
        centre = [facts[f"m{i}"] for i in range(len(features))]
        scale = [facts[f"s{i}"] or 1.0 for i in range(len(features))]
    weight = F.lit(1.0)
    if balanced:
        weight = F.when(F.col("y") == 1, n / (2 * max(1, pos))).otherwise(n / (2 * max(1, n - pos)))
    ready = settle(
        rows.select(
            *[((F.col(f"x{i}") - centre[i]) / scale[i]).alias(f"x{i}") for i in range(len(features))],
            "y", weight.alias("s"),
        )
    )
    beta = np.zeros(len(features) + 1)
    ridge = np.diag([0.0] + [penalty] * len(features))
    for _ in range(steps if n else 0):
        information, gradient = _moments(ready, len(features), beta)
        beta = beta + np.linalg.lstsq(information + ridge, gradient - ridge @ beta, rcond=None)[0]
    return LogisticCurve(tuple(features), tuple(centre), tuple(scale), tuple(beta[1:].tolist()), float(beta[0]))


def platt_curve(scored: DataFrame, prob: str = "p", label: str = LABEL, steps: int = STEPS) -> LogisticCurve:
    """The calibration curve over a raw probability: one slope, one intercept, unit penalty."""
    return fit_logistic(scored, [prob], label, balanced=False, standardise=False, steps=steps)

"""Exact medians and the logistic fit against plain computations."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from harbinger.operators import learn as L
from harbinger.operators.logistic import exact_medians, fit_logistic, median_impute, platt_curve


@pytest.mark.parametrize("buckets", [2, 3, 256])
def test_medians_are_exact(spark, buckets):
    draw = random.Random(buckets)
    wide = [draw.choice([-1, 1]) * 10.0 ** draw.randint(-300, 300) for _ in range(201)]
    tied = [float(draw.randint(0, 3)) for _ in range(201)]
    near = [1.0 + k * 2.0**-52 for k in range(200)] + [None]
    odd = [float("nan"), float("inf"), None] * 67
    whole = [draw.randint(-5, 5) for _ in range(201)]
    frame = spark.createDataFrame(
        list(zip(wide, tied, near, odd, whole, strict=True)), "wide double, tied double, near double, odd double, whole int"
    ).repartition(5)
    got = exact_medians(frame, ["wide", "tied", "near", "odd", "whole"], buckets)
    assert got["wide"] == statistics.median(wide) and got["tied"] == statistics.median(tied)
    assert got["near"] == statistics.median(near[:-1]) and got["whole"] == statistics.median(whole)
    assert got["odd"] is None


def test_median_of_the_widest_range(spark):
    frame = spark.createDataFrame([(-1.7e308,), (1.7e308,), (5.0,)], "v double")
    assert exact_medians(frame, ["v"]) == {"v": 5.0}
    assert exact_medians(frame.limit(0), ["v"]) == {"v": None}


def test_imputed_values(spark):
    frame = spark.createDataFrame([(1.0, None), (None, None), (4.0, None), (10.0, None)], "a double, b double")
    assert [tuple(r) for r in median_impute(frame, ["a", "b"]).collect()] == [(1.0, 0.0), (4.0, 0.0), (4.0, 0.0), (10.0, 0.0)]


def newton(x, y, s, penalty, steps):
    """The same steps over one matrix."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, ridge = np.zeros(x.shape[1]), np.diag([0.0] + [penalty] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve(x.T @ (x * (s * p * (1 - p))[:, None]) + ridge, x.T @ (s * (y - p)) - ridge @ beta)
    return beta


def sample(n=400, d=5):
    draw = np.random.default_rng(2)
    x = draw.normal(3, [1, 5, 0.2, 1, 9], (n, d))
    y = (x[:, 0] - 3 + 0.1 * (x[:, 1] - 3) + draw.normal(0, 0.7, n) > 0.8).astype(float)
    return x, y


def test_fit_equals_newton_over_one_matrix(spark):
    x, y = sample()
    names = [f"f{i}" for i in range(5)]
    rows = [(*map(float, r), int(t)) for r, t in zip(x, y, strict=True)]
    schema = ", ".join(f"{c} double" for c in names) + ", target_phase3plus int"
    frame = spark.createDataFrame(rows + [(None, 1.0, 1.0, 1.0, 1.0, 1), (1.0, 1.0, 1.0, 1.0, 1.0, None)], schema)
    curve = fit_logistic(frame.repartition(7), names)
    scaled = (x - x.mean(0)) / x.std(0)
    s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    expected = newton(scaled, y, s, 1.0, 8)
    assert np.allclose([curve.intercept, *curve.coefficients], expected, atol=1e-9)
    p = 1 / (1 + np.exp(-(expected[0] + scaled @ expected[1:])))
    got = [r.p for r in spark.createDataFrame(rows, schema).select(curve.probability().alias("p")).collect()]
    assert np.allclose(got, p, atol=1e-9)


def test_platt_equals_the_library_fit(spark):
    _, y = sample()
    draw = np.random.default_rng(5)
    p = np.clip(0.3 + 0.4 * y + draw.normal(0, 0.2, len(y)), 0, 1)
    frame = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "p double, target_phase3plus int")
    curve, model = platt_curve(frame), L.fit_platt(frame)
    assert curve.coefficients[0] == pytest.approx(model.coefficients[0], rel=1e-3)
    assert curve.intercept == pytest.approx(model.intercept, rel=1e-3)


def test_degenerate_rows(spark):
    schema = "a double, target_phase3plus int"
    constant = fit_logistic(spark.createDataFrame([(2.0, 0), (2.0, 1), (2.0, 1)], schema), ["a"])
    assert constant.coefficients == (0.0,) and constant.scale == (1.0,)
    one_class = fit_logistic(spark.createDataFrame([(2.0, 1), (3.0, 1)], schema), ["a"])
    assert spark.createDataFrame([(2.5, 1)], schema).select(one_class.probability().alias("p")).first().p > 0.9
    empty = fit_logistic(spark.createDataFrame([], schema), ["a"])
    assert (empty.intercept, empty.coefficients) == (0.0, (0.0,))
    assert spark.range(1).select(F.lit(1.0).alias("a")).select(empty.probability().alias("p")).first().p == 0.5

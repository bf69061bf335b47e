"""Regularised lower incomplete gamma function as a column.

Below ``LARGE_SHAPE`` the power series is summed with a number of terms chosen
per row. Above it the series would need as many terms as there are posts, so the
uniform asymptotic expansion is used; its error function is the same series at
shape one half, which keeps the work per row bounded whatever the volume.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGE_SHAPE = 2000.0

# Lanczos coefficients for g = 7, n = 9.
LANCZOS_G = 7.0
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
    -176.61502916214059, 12.507343278686905, -0.13857109526572012,
    9.9843695780195716e-6, 1.5056327351493116e-7,
)


def log_gamma_plus_one(a: Column) -> Column:
    """ln Γ(a + 1) for a ≥ 0."""
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], start=1):
        series = series + F.lit(c) / (a + float(i))
    t = a + (LANCZOS_G + 0.5)
    return F.lit(0.5 * math.log(2 * math.pi)) + (a + 0.5) * F.log(t) - t + F.log(series)


def _series(a: Column, x: Column) -> Column:
    terms = F.ceil(x + 10.0 * F.sqrt(x) + 50.0).cast("int")
    # The running term, the sum and both arguments travel as one array, so that
    # the arguments are evaluated once per row and not once per term.
    total = F.aggregate(
        F.sequence(F.lit(1), terms),
        F.array(F.lit(1.0), F.lit(1.0), a, x),
        lambda acc, n: F.array(
            acc[0] * acc[3] / (acc[2] + n), acc[1] + acc[0] * acc[3] / (acc[2] + n), acc[2], acc[3]
        ),
        lambda acc: acc[1],
    )
    return F.exp(a * F.log(x) - x - log_gamma_plus_one(a)) * total


def gamma_cdf(rate: Column, shape: Column, value: Column) -> Column:
    """P(X ≤ value) for a Gamma variable with the given shape and rate."""
    a = shape.cast("double")
    x = (rate * value).cast("double")
    large = a > LARGE_SHAPE
    # Expansion variable of the large-shape branch.
    mu = F.when(large, x / a - 1.0).otherwise(F.lit(0.0))
    half_eta_sq = F.greatest(mu - F.log1p(mu), F.lit(0.0))
    eta = F.signum(mu) * F.sqrt(2.0 * half_eta_sq)
    z_sq = F.least(a * half_eta_sq, F.lit(40.0))

    far_above = x - a > 12.0 * F.sqrt(a + 1.0) + 60.0
    far_below = a - x > 12.0 * F.sqrt(a + 1.0) + 60.0
    series_a = F.when(large, F.lit(0.5)).otherwise(a)
    series_x = F.when(large, F.greatest(z_sq, F.lit(1e-300))).otherwise(x)
    core = _series(series_a, series_x)

    first = F.when(F.abs(eta) < 1e-3, F.lit(-1.0 / 3.0) + eta / 12.0).otherwise(
        1.0 / mu - 1.0 / eta
    )
    tail = F.exp(-z_sq) / F.sqrt(2.0 * math.pi * a) * first
    erf = F.signum(eta) * core
    expanded = 0.5 * (1.0 + erf) - tail
    return (
        F.when(x <= 0, F.lit(0.0))
        .when(far_above, F.lit(1.0))
        .when(far_below, F.lit(0.0))
        .when(large, expanded)
        .otherwise(F.least(core, F.lit(1.0)))
    )

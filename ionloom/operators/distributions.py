"""Robust fits (Gaussian, Laplace, Gumbel), their cdf and quantiles, outlier masks."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F

from ionloom import constants as K
from ionloom.functions.expr import let
from ionloom.operators.frames import attach

DISTRIBUTIONS = ("gaussian", "laplace", "gumbel")


def _check(distribution: str) -> None:
    if distribution not in DISTRIBUTIONS:
        raise ValueError(f"distribution must be one of {DISTRIBUTIONS}, not {distribution!r}")


def fit(
    df: DataFrame, value: str, distribution: str, groups: Sequence[str] = ()
) -> DataFrame:
    """groups + (mu, scale): partial aggregates only, one row per group.

    Laplace needs the mean before the mean deviation, so it reads its input twice.
    """
    _check(distribution)
    x = F.col(value)
    if distribution == "laplace":
        means = df.groupBy(*groups).agg(F.avg(x).alias("mu"))
        centred = attach(df.select(*groups, value), means, groups)
        return centred.groupBy(*groups).agg(
            F.avg("mu").alias("mu"), F.avg(F.abs(x - F.col("mu"))).alias("scale")
        ) if not groups else centred.groupBy(*groups, "mu").agg(
            F.avg(F.abs(x - F.col("mu"))).alias("scale")
        )
    stats = df.groupBy(*groups).agg(F.avg(x).alias("_mean"), F.stddev_samp(x).alias("_sd"))
    if distribution == "gaussian":
        return stats.select(*groups, F.col("_mean").alias("mu"), F.col("_sd").alias("scale"))
    beta = F.col("_sd") * F.lit(math.sqrt(6) / math.pi)
    return stats.select(
        *groups, (F.col("_mean") - F.lit(K.EULER_GAMMA) * beta).alias("mu"), beta.alias("scale")
    )


def quantile(distribution: str, mu: Column, scale: Column, q: float) -> Column:
    """The q-quantile (ppf) of a fitted distribution."""
    _check(distribution)
    if distribution == "gaussian":
        factor = NormalDist().inv_cdf(q)
    elif distribution == "laplace":
        factor = math.log(2 * q) if q <= 0.5 else -math.log(2 - 2 * q)
    else:
        factor = -math.log(-math.log(q))
    return mu + scale * F.lit(factor)


# Coefficients of a published rational approximation of the normal tail
# (Hart's, as given by West), highest power first, good to about 1e-15.
NORMAL_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
NORMAL_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
NORMAL_SPLIT = 7.07106781186547


def _polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def _normal_cdf(z: Column) -> Column:
    """The standard normal cdf as a column expression."""

    def tail(u: Column) -> Column:
        near = _polynomial(u, NORMAL_TOP) / _polynomial(u, NORMAL_BOTTOM)
        far = u + 0.65
        for i in (4, 3, 2, 1):
            far = u + i / far
        return F.when(u > 37, F.lit(0.0)).otherwise(
            F.exp(-u * u / 2) * F.when(u < NORMAL_SPLIT, near).otherwise(1 / far / math.sqrt(2 * math.pi))
        )

    return let(z, lambda v: F.when(v > 0, 1 - tail(v)).otherwise(tail(-v)))


def cumulative(distribution: str, mu: Column, scale: Column, x: Column) -> Column:
    """P(X <= x) of a fitted distribution."""
    _check(distribution)
    z = (x - mu) / scale
    if distribution == "gaussian":
        return _normal_cdf(z)
    if distribution == "laplace":
        return F.when(x <= mu, 0.5 * F.exp(z)).otherwise(1 - 0.5 * F.exp(-z))
    return F.exp(-F.exp(-z))


def mark_inliers(
    df: DataFrame,
    value: str,
    distribution: str,
    fdr: float = K.TRAIN_FDR,
    groups: Sequence[str] = (),
    label: str = "kept",
) -> DataFrame:
    """Add whether the value lies below the (1 - fdr) quantile of its fitted distribution."""
    params = fit(df, value, distribution, groups)
    limit = quantile(distribution, F.col("mu"), F.col("scale"), 1.0 - fdr)
    limits = params.select(*groups, limit.alias("_limit"))
    return attach(df, limits, groups).withColumn(label, F.col(value) < F.col("_limit")).drop("_limit")

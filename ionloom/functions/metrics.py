"""Spectral similarity on array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ionloom import constants as K
from ionloom.functions.expr import col


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def ion_mask(true: Column | str, eps: float = K.EPSILON) -> Column:
    """0 where the true value is -1 (incompatible ion), almost 1 elsewhere."""
    return F.transform(col(true), lambda t: (t + 1.0) / (t + 1.0 + F.lit(eps)))


def apply_mask(values: Column | str, mask: Column) -> Column:
    return F.zip_with(col(values), mask, lambda v, m: v * m)


def l2_normalise(values: Column | str, eps: float = K.EPSILON) -> Column:
    v = col(values)
    norm = F.sqrt(F.greatest(_sum(F.transform(v, lambda x: x * x)), F.lit(eps)))
    return F.zip_with(v, F.array_repeat(norm, F.size(v)), lambda x, n: x / n)


def dot(left: Column, right: Column) -> Column:
    return _sum(F.zip_with(left, right, lambda a, b: a * b))


def spectral_cosine(pred: Column | str, true: Column | str, eps: float = K.EPSILON) -> Column:
    """Cosine of two spectra over the ions that are compatible with the true one.

    Written with three sums, so that each array is walked once per sum.
    """
    triples = F.zip_with(
        apply_mask(pred, ion_mask(true, eps)),
        apply_mask(true, ion_mask(true, eps)),
        lambda p, t: F.struct(p.alias("p"), t.alias("t")),
    )
    sums = F.aggregate(
        triples,
        F.struct(F.lit(0.0).alias("pt"), F.lit(0.0).alias("pp"), F.lit(0.0).alias("tt")),
        lambda a, x: F.struct(
            (a["pt"] + x["p"] * x["t"]).alias("pt"),
            (a["pp"] + x["p"] * x["p"]).alias("pp"),
            (a["tt"] + x["t"] * x["t"]).alias("tt"),
        ),
        lambda a: a["pt"]
        / F.sqrt(F.greatest(a["pp"], F.lit(eps)))
        / F.sqrt(F.greatest(a["tt"], F.lit(eps))),
    )
    return sums


def negative_logit(p: Column | str, eps: float = K.EPSILON) -> Column:
    value = col(p)
    return F.log(F.greatest(1.0 - value, F.lit(eps))) - F.log(F.greatest(value, F.lit(eps)))

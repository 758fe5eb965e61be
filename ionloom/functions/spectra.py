"""Spectrum arrays: filtering, normalising, zipping."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ionloom import constants as K
from ionloom.functions.expr import col, let

PEAKS_TYPE = "array<struct<mz:double,intensity:float>>"


def drop_low_peaks(peaks: Column | str, threshold: float = K.MIN_INTENSITY) -> Column:
    """Peaks at or above the threshold that have an m/z (an impossible ion has 0)."""
    return F.filter(col(peaks), lambda p: (p["intensity"] >= threshold) & (p["mz"] > 0))


def zip_peaks(mz_rows: Column | str, intensity_rows: Column | str) -> Column:
    """Cell-by-cell pairing of two ion matrices as one flat peak array."""
    return F.zip_with(
        F.flatten(col(mz_rows)),
        F.flatten(col(intensity_rows)),
        lambda m, i: F.struct(m.cast("double").alias("mz"), i.cast("float").alias("intensity")),
    )


def base_peak_normalise(values: Column | str) -> Column:
    """Clamp a flat prediction at 0 and divide by its largest value; all 0 without one."""
    zero = F.lit(0.0).cast("float")
    clamped = F.transform(col(values), lambda v: F.greatest(v, zero))
    # the maximum is bound once, not looked for again at every cell
    return let(
        F.struct(clamped.alias("v"), F.array_max(clamped).alias("top")),
        lambda s: F.when(
            s["top"] > 0, F.transform(s["v"], lambda v: (v / s["top"]).cast("float"))
        ).otherwise(s["v"]),
    )


def matched_normalise(intensities: Column | str) -> Column:
    """Matched intensities over (their maximum + epsilon)."""
    values = col(intensities)
    return let(
        F.array_max(values) + F.lit(K.EPSILON), lambda top: F.transform(values, lambda v: v / top)
    )


def count_strong_ions(rows: Column | str, threshold: float = 0.01) -> Column:
    return F.size(F.filter(F.flatten(col(rows)), lambda v: v >= F.lit(threshold).cast("float")))

"""Nearest observed peak of every theoretical ion, within a mass tolerance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from ionloom import constants as K
from ionloom.functions import masses as S

BIN_TOLERANCES = 4  # a bin is this many tolerances wide, so most ions touch one bin
EDGE = 1.001        # bins reach a little beyond the tolerance; the exact test decides


def _bin(mz: Column, resolution: str) -> Column:
    width = BIN_TOLERANCES * K.MASS_TOLERANCES[resolution]
    scaled = F.log(mz) if resolution == "high" else mz
    return F.floor(scaled / F.lit(width)).cast("int")


def match_ions(
    ions: DataFrame,
    peaks: DataFrame,
    keys: Sequence[str],
    ion_keys: Sequence[str],
    resolution: str = "high",
    salts: int = 1,
) -> DataFrame:
    """Add ``intensity`` to ions(keys, ion_keys, mz) from peaks(keys, peak_index, mz, intensity).

    Nearest peak, first index on ties, 0 when none lies within the (inclusive)
    tolerance. The band join is an equi-join on (keys, m/z bin) with the exact
    test as its residual: ions are copied to the one or two bins their tolerance
    touches, peaks are shuffled once and never copied.

    Skew: the bins split a dense spectrum, and the join is an inner one so that
    AQE may split a hot bin on the side of the peaks (an outer join would not
    allow it); ``salts`` spreads every bin over that many tasks where AQE is off.
    The best peak per task is kept before the last shuffle. A spectrum has at
    most a few hundred ions, so the joined rows stay linear in the peaks. Ions
    without a peak come back by a union with the ions themselves.
    """
    wanted = ions.where(F.col("mz") > 0).withColumn("_tol", S.tolerance("mz", resolution))
    lowest = _bin(F.greatest(F.col("mz") - F.lit(EDGE) * F.col("_tol"), F.lit(1e-9)), resolution)
    highest = _bin(F.col("mz") + F.lit(EDGE) * F.col("_tol"), resolution)
    wanted = wanted.withColumn("_bin", F.explode(F.sequence(lowest, highest)))
    observed = peaks.where(F.col("mz") > 0).select(
        *keys,
        "peak_index",
        "intensity",
        F.col("mz").alias("_peak_mz"),
        _bin(F.col("mz"), resolution).alias("_bin"),
    )
    on = [*keys, "_bin"]
    if salts > 1:
        wanted = wanted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        observed = observed.withColumn("_salt", F.pmod(F.xxhash64("peak_index"), F.lit(salts)).cast("int"))
        on.append("_salt")
    distance = F.abs(F.col("_peak_mz") - F.col("mz"))
    order = F.struct(distance.alias("d"), F.col("peak_index").alias("i"), F.col("intensity").alias("v"))
    inside = wanted.join(observed, on).where(distance <= F.col("_tol"))
    found = inside.select(*keys, *ion_keys, "mz", order.alias("_found"))
    nothing = F.lit(None).cast(found.schema["_found"].dataType)
    every = ions.select(*keys, *ion_keys, "mz", nothing.alias("_found"))
    best = found.unionByName(every).groupBy(*keys, *ion_keys, "mz").agg(F.min("_found").alias("_found"))
    return best.select(
        *keys,
        *ion_keys,
        "mz",
        F.coalesce(F.col("_found")["v"].cast("double"), F.lit(0.0)).alias("intensity"),
    )


def nearest_intensities(
    wanted: np.ndarray, mzs: np.ndarray, intensities: np.ndarray, resolution: str
) -> np.ndarray:
    """The same rule for one spectrum held in arrays (binary search, no pair list)."""
    out = np.zeros(len(wanted))
    if len(mzs) == 0 or len(wanted) == 0:
        return out
    order = np.argsort(mzs, kind="stable")
    sorted_mz = mzs[order]
    first = order[np.searchsorted(sorted_mz, sorted_mz, side="left")]  # first index of each m/z
    right = np.searchsorted(sorted_mz, wanted, side="left")
    lo = np.clip(right - 1, 0, len(mzs) - 1)
    hi = np.clip(right, 0, len(mzs) - 1)
    d_lo, d_hi = np.abs(sorted_mz[lo] - wanted), np.abs(sorted_mz[hi] - wanted)
    use_lo = (d_lo < d_hi) | ((d_lo == d_hi) & (first[lo] <= first[hi]))
    index = np.where(use_lo, first[lo], first[hi])
    tol = K.MASS_TOLERANCES[resolution]
    tol = tol * wanted if resolution == "high" else np.full(len(wanted), tol)
    hit = (np.minimum(d_lo, d_hi) <= tol) & (wanted != 0.0)
    out[hit] = intensities[index[hit]]
    return out


def _joined(parts: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """All values of arrays in a row (NULL: none), and how many each has."""
    arrays = [np.zeros(0) if p is None else np.asarray(p, "float64") for p in parts]
    return np.concatenate([np.zeros(0), *arrays]), np.array([len(p) for p in arrays], np.int64)


def nearest_in_batch(wanted: Sequence, mzs: Sequence, intensities: Sequence, resolution: str) -> list[np.ndarray]:
    """``nearest_intensities`` of many spectra at once: one sort and one sweep over all of them."""
    want, n_want = _joined(wanted)
    mz, n_mz = _joined(mzs)
    height, _ = _joined(intensities)
    out = np.zeros(len(want))
    ends = np.cumsum(n_want)[:-1]
    if not len(want) or not len(mz):
        return np.split(out, ends)
    row_want, row_mz = (np.repeat(np.arange(len(n)), n) for n in (n_want, n_mz))
    stop = np.cumsum(n_mz)
    begin = stop - n_mz
    # by spectrum and m/z; an ion stands before the peaks of its own m/z
    peak = np.append(np.zeros(len(want), bool), np.ones(len(mz), bool))
    order = np.lexsort((peak, np.append(want, mz), np.append(row_want, row_mz)))
    is_peak = peak[order]
    by_mz = order[is_peak] - len(want)
    right = np.empty(len(want), np.int64)
    right[order[~is_peak]] = np.cumsum(is_peak)[~is_peak]
    # of equal peaks of a spectrum the first one counts
    new = np.append(True, (mz[by_mz][1:] != mz[by_mz][:-1]) | (row_mz[by_mz][1:] != row_mz[by_mz][:-1]))
    first = by_mz[np.maximum.accumulate(np.where(new, np.arange(len(by_mz)), 0))]
    lo, hi = np.maximum(right - 1, 0), np.minimum(right, len(mz) - 1)
    d_lo = np.where(right - 1 >= begin[row_want], np.abs(mz[by_mz[lo]] - want), np.inf)
    d_hi = np.where(right < stop[row_want], np.abs(mz[by_mz[hi]] - want), np.inf)
    index = np.where((d_lo < d_hi) | ((d_lo == d_hi) & (first[lo] <= first[hi])), first[lo], first[hi])
    tol = K.MASS_TOLERANCES[resolution]
    tol = tol * want if resolution == "high" else np.full(len(want), tol)
    hit = (np.minimum(d_lo, d_hi) <= tol) & (want != 0.0)
    out[hit] = height[index[hit]]
    return np.split(out, ends)


def match_arrays(wanted: Column, mzs: Column, intensities: Column, resolution: str = "high") -> Column:
    """Matched intensities of an ion m/z array, for spectra that are one row each.

    Library files hold a spectrum as a pair of arrays; matching them in place
    needs no shuffle at all. A batch of spectra is matched in one sweep.
    """
    if resolution not in K.MASS_TOLERANCES:
        raise ValueError(f"resolution must be one of {sorted(K.MASS_TOLERANCES)}")

    @pandas_udf(ArrayType(DoubleType()))
    def matched(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for w, m, i in parts:
            found = nearest_in_batch(w.tolist(), m.tolist(), i.tolist(), resolution)
            yield pd.Series(found if len(w) else [], dtype="object")

    # keeps the optimiser from copying the call into every expression that reads it
    return matched.asNondeterministic()(wanted, mzs, intensities)


def normalise_matches(matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Divide each matched intensity by (the largest of its spectrum + epsilon).

    One shuffle by spectrum; a spectrum has at most a few hundred ions.
    """
    top = F.max("intensity").over(Window.partitionBy(*keys)) + F.lit(K.EPSILON)
    return matches.withColumn("norm_intensity", F.col("intensity") / top)

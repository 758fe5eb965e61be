"""Fragment intensities that depend on the collision energy.

Per ion context a straight line in the energy is fitted from five sums that add up
across tasks and files (n, x, xx, y, xy). A context with few ions is drawn towards the
coarser one: ``shrink`` ions of the coarser context are added to its sums, and those
of the channel (per fragmentation type) to the coarser one's. All levels roll up one aggregate, whose size the alphabet bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ionloom import constants as K
from ionloom.operators.frames import attach
from ionloom.operators.models import COARSE, CONTEXT, POSITION_BINS, ion_context

SUMS = ("n", "x", "xx", "y", "xy")
SHRINK = 20.0               # ions of the coarser context that are added to each finer one
LEAST_VARIANCE = 1e-6       # of energies, below which a line is flat
BEAM = "HCD"                # only here the energy counts; elsewhere it is 0
CHANNEL = ["channel", "frag_type"]
LEVELS = {"": CONTEXT, "coarse_": COARSE, "channel_": CHANNEL}


def energy_context(samples: DataFrame, nce: str = "nce", **columns: str) -> DataFrame:
    """``ion_context`` with the energy of each ion. A NULL energy counts as none."""
    energy = F.when(F.upper("frag_type") == BEAM, F.coalesce(F.col(nce).cast("double"), F.lit(0.0))).otherwise(0.0)
    return ion_context(samples, energy=energy, **columns)


def energy_sums(contexts: DataFrame) -> DataFrame:
    """The five sums of every context."""
    x, y = F.col("energy"), F.col("intensity").cast("double")
    return contexts.groupBy(*CONTEXT).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("x"), F.sum(x * x).alias("xx"), F.sum(y).alias("y"), F.sum(x * y).alias("xy")
    )


def merge_sums(*parts: DataFrame) -> DataFrame:
    """The sums of several sets of ions, as of all of them together."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return _rolled(whole, CONTEXT)


def _rolled(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    return sums.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in SUMS])


def _drawn(sums: DataFrame, towards: DataFrame, keys: Sequence[str], shrink: float) -> DataFrame:
    """Add ``shrink`` ions of the context named by ``keys`` to each row's sums."""
    both = attach(sums, towards.select(*keys, *[F.col(s).alias(f"_{s}") for s in SUMS]), keys)
    share = F.lit(float(shrink)) / F.col("_n")
    return both.select(*[c for c in sums.columns if c not in SUMS], *[(F.col(s) + share * F.col(f"_{s}")).alias(s) for s in SUMS])


def _line(prefix: str) -> list[Column]:
    n, x, xx, y, xy = (F.col(s) for s in SUMS)
    variance = xx / n - (x / n) * (x / n)
    slope = F.when(variance > LEAST_VARIANCE, (xy / n - x / n * (y / n)) / variance).otherwise(0.0)
    return [slope.alias(f"{prefix}slope"), (y / n - slope * x / n).alias(f"{prefix}base")]


def fit_energy(sums: DataFrame, shrink: float = SHRINK) -> DataFrame:
    """Per context n (of its own ions) and base and slope of its line, of the coarser one's and of its channel's."""
    channel, coarse = _rolled(sums, CHANNEL), _rolled(sums, COARSE)
    coarse = _drawn(coarse, channel, CHANNEL, shrink)
    fine = _drawn(sums.withColumn("ions", F.col("n").cast("bigint")), coarse, COARSE, shrink)
    table = fine.select(*CONTEXT, "ions", *_line("")).withColumnRenamed("ions", "n")
    table = attach(table, coarse.select(*COARSE, *_line("coarse_")), COARSE)
    return attach(table, channel.select(*CHANNEL, *_line("channel_")), CHANNEL)


@dataclass(frozen=True)
class EnergyModel:
    """Base and slope of each level as dense arrays; the last axis is (base, slope)."""

    fine: np.ndarray     # [channel, charge, bin, left, right, 2]
    coarse: np.ndarray   # [channel, charge, bin, 2]
    channel: np.ndarray  # [channel, 2]

    def make_model(self) -> Callable:
        """For ``score_fragments``: intensities between 0 and 1 at each peptide's energy."""
        fine, coarse, channel = self.fine, self.coarse, self.channel

        def make():
            def predict(codes, charge, nce):
                codes, energy = codes.astype(int), np.asarray(nce, float).reshape(-1, 1)
                n = (codes != 0).sum(axis=1)[:, None] - 2
                z, row, i = charge.argmax(axis=1)[:, None], np.arange(len(codes))[:, None], np.arange(K.MAX_IONS)[None, :]
                real = i < n - 1
                out = np.zeros((len(codes), K.N_CHANNELS, K.MAX_IONS), "float32")
                for c in range(K.N_CHANNELS):
                    cut = np.where(real, i + 1 if c % 2 == 0 else n - i - 1, 1)
                    bins = np.clip(cut * POSITION_BINS // np.maximum(n, 1), 0, POSITION_BINS - 1)
                    line = fine[c, z, bins, codes[row, cut], codes[row, cut + 1]]
                    line = np.where(np.isnan(line), coarse[c, z, bins], line)
                    line = np.where(np.isnan(line), channel[c], line)
                    out[:, c, :] = np.where(real, np.clip(line[..., 0] + line[..., 1] * energy, 0.0, 1.0), 0.0)
                return out.reshape(len(codes), -1)

            return predict

        return make


def load_energy_model(table: DataFrame, frag_type: str = BEAM) -> EnergyModel:
    """Read the fitted lines (bounded by the alphabet) into arrays for scoring."""
    shape = (K.N_CHANNELS, K.MAX_PRECURSOR_CHARGE, POSITION_BINS)
    fine, coarse = np.full((*shape, K.N_STATES, K.N_STATES, 2), np.nan), np.full((*shape, 2), np.nan)
    channel = np.zeros((K.N_CHANNELS, 2))
    for r in table.where(F.col("frag_type") == frag_type.upper()).toLocalIterator():
        channel[r["channel"]] = r["channel_base"], r["channel_slope"]
        place = r["channel"], r["charge"] - 1, min(r["position_bin"], POSITION_BINS - 1)
        left, right = K.SYMBOL_CODES.get(r["residue_left"], 0), K.SYMBOL_CODES.get(r["residue_right"], 0)
        fine[(*place, left, right)] = r["base"], r["slope"]
        coarse[place] = r["coarse_base"], r["coarse_slope"]
    return EnergyModel(fine, coarse, channel)


def score_energy_table(contexts: DataFrame, table: DataFrame, energy: Column | str = "energy") -> DataFrame:
    """Long-form scoring by join, at the energy of each row or a given one: the context's line, else the coarser ones'."""
    joined = contexts
    for prefix, keys in LEVELS.items():
        names = [f"{prefix}base", f"{prefix}slope"]
        joined = attach(joined, table.select(*keys, *names).distinct(), keys)
    at = F.col(energy) if isinstance(energy, str) else energy
    lines = [F.col(f"{p}base") + F.col(f"{p}slope") * at for p in LEVELS]
    value = F.least(F.greatest(F.coalesce(*lines, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return joined.withColumn("predicted", value).drop(*[f"{p}{c}" for p in LEVELS for c in ("base", "slope")])

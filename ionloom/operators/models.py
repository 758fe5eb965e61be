"""Batched scoring with a user's model, and two models that Spark itself can fit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, predict_batch_udf
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from ionloom import constants as K
from ionloom.functions.expr import col
from ionloom.operators.frames import attach

BATCH_SIZE = 2048


def score_retention_time(
    make_model: Callable, codes: Column | str = "codes", batch_size: int = BATCH_SIZE
) -> Column:
    """One value per peptide. ``make_model()`` returns ``predict(int[n, 37]) -> float[n]``."""
    score = predict_batch_udf(
        make_model,
        return_type=DoubleType(),
        batch_size=batch_size,
        input_tensor_shapes=[[K.MAX_CODED_LEN]],
    )
    return score.asNondeterministic()(col(codes))  # evaluated once, never copied


def score_fragments(
    make_model: Callable,
    codes: Column | str = "codes",
    charge: Column | str = "charge_one_hot",
    nce: Column | str | None = "nce",
    batch_size: int = BATCH_SIZE,
) -> Column:
    """4 x 34 intensities per precursor, flat (channel-major: b1, y1, b2, y2).

    ``make_model()`` returns ``predict(codes[n, 37], charge[n, 6], nce[n])``; with
    ``nce=None`` (trap fragmentation) the model takes no collision energy.
    """
    inputs = [col(codes), col(charge)]
    shapes = [[K.MAX_CODED_LEN], [K.MAX_PRECURSOR_CHARGE]]
    if nce is not None:
        inputs.append(F.array(col(nce).cast("float")))
        shapes.append([1])
    score = predict_batch_udf(
        make_model,
        return_type=ArrayType(FloatType()),
        batch_size=batch_size,
        input_tensor_shapes=shapes,
    )
    return score.asNondeterministic()(*inputs)  # evaluated once, never copied


def as_ion_rows(flat: Column | str) -> Column:
    """The flat 4 x 34 prediction as four rows."""
    return F.array(
        *[F.slice(col(flat), c * K.MAX_IONS + 1, K.MAX_IONS) for c in range(K.N_CHANNELS)]
    )


# --- retention time: linear in the residue counts ---------------------------------


def symbol_counts(coded: Column | str) -> Column:
    """How often each of the 44 symbols occurs."""
    text = col(coded)
    return F.array(
        *[
            (F.length(text) - F.length(F.replace(text, F.lit(s), F.lit("")))).cast("double")
            for s in K.ALPHABET
        ]
    )


@dataclass(frozen=True)
class RetentionModel:
    intercept: float
    weights: tuple[float, ...]  # per symbol code, 0 for the padding

    def predict(self, codes: Column | str) -> Column:
        """The model as a plain column expression over integer codes."""
        table = F.array(*[F.lit(float(w)) for w in self.weights])
        return F.aggregate(
            col(codes),
            F.lit(self.intercept),
            lambda total, c: total + F.element_at(table, c + 1),
        )

    def make_model(self) -> Callable:
        """The same model for batched scoring."""
        weights, intercept = np.asarray(self.weights), self.intercept

        def make():
            return lambda codes: weights[codes.astype(int)].sum(axis=1) + intercept

        return make


def fit_retention(
    train: DataFrame, coded: str = "CodedPeptideSeq", target: str = "HI", loss: str = "squaredError",
    reg: float = 0.0,
) -> RetentionModel:
    """Least squares (or ``huber``) on symbol counts; Spark sums one small Gram matrix."""
    features = train.select(
        array_to_vector(symbol_counts(coded)).alias("features"),
        F.col(target).cast("double").alias("label"),
    )
    fitted = LinearRegression(loss=loss, regParam=reg, maxIter=1000, tol=1e-12).fit(features)
    return RetentionModel(float(fitted.intercept), (0.0, *map(float, fitted.coefficients)))


# --- fragment intensities: means per ion context, with back-off -------------------

POSITION_BINS = 10
CONTEXT = ["channel", "charge", "frag_type", "position_bin", "residue_left", "residue_right"]
COARSE = CONTEXT[:4]


def ion_context(
    samples: DataFrame, rows: str = "ion_array", coded: str = "coded_seq", charge: str = "precursor_z", **carried: Column
) -> DataFrame:
    """One row per compatible ion: its context and intensity, and values carried along from its sample.

    b_i cuts after residue i and y_i after residue n - i; the context holds the
    residues on both sides of the cut.
    """
    exploded = samples.select(
        F.col(charge).alias("charge"),
        F.upper("frag_type").alias("frag_type"),
        F.substr(F.col(coded), F.lit(2), F.length(coded) - 2).alias("_seq"),
        *[value.alias(name) for name, value in carried.items()],
        F.posexplode(F.col(rows)).alias("channel", "_row"),
    ).select("*", F.posexplode("_row").alias("_i", "intensity"))
    n = F.length("_seq")
    cut = F.when(F.col("channel") % 2 == 0, F.col("_i") + 1).otherwise(n - F.col("_i") - 1)
    return (
        exploded.where((F.col("intensity") >= 0) & (F.col("_i") < n - 1))
        .withColumn("_cut", cut)
        .select(
            "channel",
            "charge",
            "frag_type",
            F.floor(F.col("_cut") * POSITION_BINS / n).cast("int").alias("position_bin"),
            F.substr(F.col("_seq"), F.col("_cut"), F.lit(1)).alias("residue_left"),
            F.substr(F.col("_seq"), F.col("_cut") + 1, F.lit(1)).alias("residue_right"),
            "intensity",
            *carried,
        )
    )


def fit_fragments(contexts: DataFrame) -> DataFrame:
    """Mean intensity per context, its coarse mean and the channel mean.

    The ions are aggregated once; the back-off levels roll up that aggregate,
    whose size is bounded by the alphabet (4 channels x 6 charges x 2 types x
    10 bins x 37 x 37 residues).
    """
    full = contexts.groupBy(*CONTEXT).agg(
        F.sum(F.col("intensity").cast("double")).alias("total"), F.count(F.lit(1)).alias("n")
    )
    coarse = full.groupBy(*COARSE).agg((F.sum("total") / F.sum("n")).alias("coarse_mean"))
    channel = full.groupBy("channel").agg((F.sum("total") / F.sum("n")).alias("channel_mean"))
    return (
        full.join(coarse, COARSE)
        .join(channel, "channel")
        .select(*CONTEXT, "n", (F.col("total") / F.col("n")).alias("mean"), "coarse_mean", "channel_mean")
    )


@dataclass(frozen=True)
class FragmentModel:
    """Mean intensities as dense arrays indexed by context (a fixed size)."""

    fine: np.ndarray     # [channel, charge, bin, left, right]
    coarse: np.ndarray   # [channel, charge, bin]
    channel: np.ndarray  # [channel]

    def make_model(self) -> Callable:
        fine, coarse, channel = self.fine, self.coarse, self.channel

        def make():
            def predict(codes, charge, nce=None):
                codes = codes.astype(int)
                n = (codes != 0).sum(axis=1) - 2
                z = charge.argmax(axis=1)
                out = np.zeros((len(codes), K.N_CHANNELS, K.MAX_IONS), "float32")
                i = np.arange(K.MAX_IONS)
                row = np.arange(len(codes))[:, None]
                real = i[None, :] < (n - 1)[:, None]
                for c in range(K.N_CHANNELS):
                    cut = (i + 1)[None, :] if c % 2 == 0 else n[:, None] - i[None, :] - 1
                    cut = np.where(real, cut, 1)
                    bins = np.clip(cut * POSITION_BINS // np.maximum(n[:, None], 1), 0, POSITION_BINS - 1)
                    left, right = codes[row, cut], codes[row, cut + 1]
                    value = fine[c, z[:, None], bins, left, right]
                    value = np.where(np.isnan(value), coarse[c, z[:, None], bins], value)
                    value = np.where(np.isnan(value), channel[c], value)
                    out[:, c, :] = np.where(real, value, 0.0)
                return out.reshape(len(codes), -1)

            return predict

        return make


def load_fragment_model(table: DataFrame, frag_type: str = "HCD") -> FragmentModel:
    """Read the fitted means (bounded by the alphabet) into arrays for scoring."""
    states = K.N_STATES
    charges = K.MAX_PRECURSOR_CHARGE
    fine = np.full((K.N_CHANNELS, charges, POSITION_BINS, states, states), np.nan, "float32")
    coarse = np.full((K.N_CHANNELS, charges, POSITION_BINS), np.nan, "float32")
    channel = np.zeros(K.N_CHANNELS, "float32")
    for r in table.select("channel", "channel_mean").distinct().collect():     # one row per channel
        channel[r["channel"]] = r["channel_mean"]
    for r in table.where(F.col("frag_type") == frag_type.upper()).toLocalIterator():
        z, b = r["charge"] - 1, min(r["position_bin"], POSITION_BINS - 1)
        left, right = K.SYMBOL_CODES.get(r["residue_left"], 0), K.SYMBOL_CODES.get(r["residue_right"], 0)
        fine[r["channel"], z, b, left, right] = r["mean"]
        coarse[r["channel"], z, b] = r["coarse_mean"]
    return FragmentModel(fine, coarse, channel)


def score_context_table(contexts: DataFrame, table: DataFrame) -> DataFrame:
    """Long-form scoring by join: the context mean, else the coarse one, else the channel's."""
    means = table.select(*CONTEXT, "mean")
    coarse = table.select(*COARSE, "coarse_mean").distinct()
    channel = table.select("channel", "channel_mean").distinct()
    joined = attach(attach(attach(contexts, means, CONTEXT), coarse, COARSE), channel, ["channel"])
    return joined.withColumn(
        "predicted", F.coalesce("mean", "coarse_mean", "channel_mean", F.lit(0.0))
    ).drop("mean", "coarse_mean", "channel_mean")

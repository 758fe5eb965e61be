"""Fitting and evaluating the two default models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ionloom import constants as K
from ionloom.functions.encoding import integer_codes
from ionloom.operators import energy, losses, models
from ionloom.operators.frames import union_frames
from ionloom.operators.robust import fit_robust_retention
from ionloom.operators.splits import exact_split
from ionloom.plans.training_sets import sample_features
from ionloom.session import materialise


@dataclass(frozen=True)
class TrainedRetention:
    model: models.RetentionModel
    scales: DataFrame      # Source, b
    evaluation: DataFrame  # score, n_kept, n on the test part


def evaluate_retention(
    train: DataFrame, test: DataFrame, fdr: float = K.TRAIN_FDR, pred: str = "pred", true: str = "HI", source: str = "Source",
) -> tuple[DataFrame, DataFrame]:
    """Error scale per source of the training part, and the masked likelihood of the test part under them."""
    scales = materialise(losses.source_scales(train, pred, true, source))
    return scales, losses.rt_masked_likelihood(test, pred, true, source, scales, fdr)


def train_retention(
    rows: DataFrame, key: list[str], fraction: float = K.VALIDATION_FRACTION, seed: int = K.SEED,
    loss: str = "squaredError", fdr: float = K.TRAIN_FDR,
) -> TrainedRetention:
    """Exact split, fit, error scale per source, masked likelihood on the test part.

    ``loss`` is ``squaredError``, ``huber``, or ``maskedLikelihood``, which fits weights,
    scales and outlier mask together.
    """
    split = materialise(exact_split(rows, fraction, key, seed=seed))
    train, test = split.where(~F.col("is_test")), split.where("is_test")
    if loss == "maskedLikelihood":
        model = fit_robust_retention(train, fdr=fdr).model
    else:
        model = models.fit_retention(train, loss=loss)
    predicted = integer_codes("CodedPeptideSeq")

    def score(part: DataFrame) -> DataFrame:
        return part.withColumn("_codes", predicted).withColumn("pred", model.predict("_codes"))

    scales, evaluation = evaluate_retention(score(train), score(test), fdr)
    return TrainedRetention(model, scales, evaluation)


@dataclass(frozen=True)
class TrainedFragments:
    table: DataFrame
    models: dict[str, models.FragmentModel | energy.EnergyModel]     # per fragmentation type
    evaluation: DataFrame                       # score, mean_cosine, n_kept, n on the test part


def train_fragments(
    samples: DataFrame, frag_types: Sequence[str] = ("HCD", "CID"), fraction: float = K.VALIDATION_FRACTION,
    seed: int = K.SEED, fdr: float = K.TRAIN_FDR, shrink: float | None = None,
) -> TrainedFragments:
    """Split in each dataset, intensities per ion context, masked score on the test part.

    Intensities are means; with ``shrink`` they are lines in the collision energy, drawn
    towards the coarser context by so many ions. Every spectrum is scored with the means of its own fragmentation type. Samples of
    other types than ``frag_types`` are an error.
    """
    groups = ["dataset", "frag_type", "nce"]
    samples = materialise(samples)      # read several times, but matched once
    other = samples.where(~F.upper("frag_type").isin(*[t.upper() for t in frag_types]) | F.col("frag_type").isNull())
    if not other.isEmpty():
        raise ValueError(f"samples of other fragmentation types than {list(frag_types)}")
    split = materialise(exact_split(samples, fraction, [*groups, "coded_seq", "precursor_z"], groups, seed))
    train, test = split.where(~F.col("is_test")), split.where("is_test")
    if shrink is None:
        table = materialise(models.fit_fragments(models.ion_context(train)))
        fitted = {t.upper(): models.load_fragment_model(table, t) for t in frag_types}
    else:
        sums = materialise(energy.energy_sums(energy.energy_context(train)))
        table = materialise(energy.fit_energy(sums, shrink))
        fitted = {t.upper(): energy.load_energy_model(table, t) for t in frag_types}
    parts = []
    for frag_type, model in fitted.items():
        features = sample_features(test.where(F.upper("frag_type") == frag_type))
        pred = models.score_fragments(model.make_model(), "codes", "charge", "nce")
        parts.append(features.select(F.flatten("target").alias("true"), pred.alias("pred")))
    # scored once: the mask reads its input twice
    scored = materialise(losses.spectral_scores(union_frames(*parts), "pred", "true").select("cosine", "score"))
    return TrainedFragments(table, fitted, losses.masked_score(scored, fdr))

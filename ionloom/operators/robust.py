"""Retention weights and error scales fitted together to the masked likelihood."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ionloom import constants as K
from ionloom.functions.encoding import integer_codes
from ionloom.operators.frames import bounded_broadcast
from ionloom.operators.models import RetentionModel
from ionloom.session import materialise, stored

WIDTH = K.N_STATES              # intercept (in the place of the padding) and one weight per symbol
SMOOTHING = 1e-3                # errors below this share of their scale weigh alike
ROUNDS = 8
LEAST_GAIN = 1e-5


@dataclass(frozen=True)
class Round:
    """State of one round: the model, its scales per source, the mask's limit and the masked likelihood."""

    model: RetentionModel
    scales: DataFrame
    limit: float
    score: float
    n_kept: int
    n: int


@dataclass(frozen=True)
class RobustFit:
    rows: DataFrame             # codes, y, source
    rounds: list[Round] = field(default_factory=list)

    @property
    def last(self) -> Round:
        return self.rounds[-1]

    @property
    def model(self) -> RetentionModel:
        return self.last.model

    def weighted(self) -> DataFrame:
        """The training rows with the weights of the least squares that gave the last model, and its ``pred``."""
        rows = self.rows.withColumn("weight", F.lit(1.0))
        if len(self.rounds) > 1:
            before = self.rounds[-2]
            rows, _ = weighted_rows(self.rows, before.model, before.scales, before.limit)
        return rows.withColumn("pred", self.model.predict("codes"))


def norm_errors(rows: DataFrame, model: RetentionModel, scales: DataFrame) -> DataFrame:
    """Add error, b and norm_error. Every source of ``rows`` has a scale; ``scales`` is marked for broadcast or not."""
    named = scales.select(F.col("source").alias("_source"), "b")
    scored = rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return scored.withColumn("error", F.col("y") - model.predict("codes")).withColumn("norm_error", F.abs("error") / F.col("b"))


def mask_limit(scored: DataFrame, fdr: float) -> float:
    """The norm error below which a row counts: the (1 - fdr) quantile of the Laplace distribution fitted to them."""
    mu = scored.agg(F.avg("norm_error")).first()[0]
    spread = scored.agg(F.avg(F.abs(F.col("norm_error") - F.lit(mu)))).first()[0]
    return mu + spread * (-math.log(2 * fdr) if fdr <= 0.5 else math.log(2 - 2 * fdr))


def _weight() -> Column:
    """Of a kept row: what makes a squared error count like an absolute one at the present error."""
    return 1 / (F.col("b") * F.greatest(F.abs("error"), F.col("b") * SMOOTHING))


def weighted_rows(rows: DataFrame, model: RetentionModel, scales: DataFrame, limit: float | None, fdr: float = K.TRAIN_FDR) -> tuple[DataFrame, float]:
    """Rows with the weight of the next least squares (0 for the masked ones) and their loss, and the mask's limit."""
    scored = norm_errors(rows, model, scales)
    limit = mask_limit(scored, fdr) if limit is None else limit
    kept = F.col("norm_error") < limit
    loss = F.when(kept, F.col("norm_error") + F.log(2 * F.col("b")))
    return scored.select("codes", "y", "source", F.when(kept, _weight()).otherwise(0.0).alias("weight"), loss.alias("loss")), limit


def _gram(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    total, losses = np.zeros((width, width + 1)), np.zeros(3)
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1)
        place = np.repeat(np.arange(batch.num_rows), codes.shape[1]) * width + codes.ravel()
        x = np.bincount(place, minlength=batch.num_rows * width).reshape(-1, width).astype(float)
        x[:, 0] = 1.0
        y, weight, loss = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        total += (x * weight[:, None]).T @ np.column_stack([x, y])
        losses += np.nansum(loss), (~np.isnan(loss)).sum(), len(loss)
    values = np.append(total.ravel(), losses)
    cell = np.flatnonzero(values)
    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(values[cell])], ["cell", "value"])


def least_squares(weighted: DataFrame) -> tuple[RetentionModel, float, int, int]:
    """Weighted least squares from one summed Gram matrix, whose size is that of the alphabet.

    In the same pass the losses are added up: their sum, number, and the number of rows. Weights
    that the rows leave open (a symbol that never occurs) are those of least norm.
    """
    parts = weighted.select("codes", *[F.col(c).cast("double") for c in ("y", "weight", "loss")])
    cells = parts.mapInArrow(partial(_gram, width=WIDTH), "cell int, value double")
    table = cells.groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    values = np.zeros(WIDTH * (WIDTH + 1) + 3)
    values[table["cell"].to_numpy()] = table["value"].to_numpy()
    gram = values[:-3].reshape(WIDTH, WIDTH + 1)
    scale = np.sqrt(np.where(np.diag(gram[:, :-1]) > 0, np.diag(gram[:, :-1]), 1.0))
    solved = np.linalg.lstsq(gram[:, :-1] / np.outer(scale, scale), gram[:, -1] / scale, rcond=1e-13)[0] / scale
    model = RetentionModel(float(solved[0]), (0.0, *map(float, solved[1:])))
    return model, float(values[-3]), int(values[-2]), int(values[-1])


def fit_robust_retention(
    train: DataFrame, coded: str = "CodedPeptideSeq", target: str = "HI", source: str = "Source",
    fdr: float = K.TRAIN_FDR, rounds: int = ROUNDS,
) -> RobustFit:
    """Fit weights, one Laplace scale per source and the outlier mask by turns.

    Each round draws the mask anew from the norm errors of all rows, solves the weighted
    least squares whose weights make kept absolute errors count by their source's scale,
    and sets each scale to the mean absolute error of the kept rows (of all rows, where a
    source keeps none). It ends when the masked likelihood no longer falls; the last
    round that lowered it stands. Rows without a coded sequence or a target are left out; a
    NULL source is a source of its own.
    """
    rows = train.where(F.col(coded).isNotNull() & F.col(target).isNotNull()).select(
        integer_codes(coded).alias("codes"), F.col(target).cast("double").alias("y"), F.col(source).alias("source")
    )
    rows = materialise(rows)
    if rows.isEmpty():
        raise ValueError("no rows to fit")

    def scales_of(model: RetentionModel, before: Round | None) -> DataFrame:
        if before is None:
            scored, kept = rows, F.lit(True)
        else:
            scored = norm_errors(rows, before.model, before.scales)
            kept = F.col("norm_error") < before.limit
        error = F.abs(F.col("y") - model.predict("codes"))
        means = scored.groupBy("source").agg(F.avg(F.when(kept, error)).alias("own"), F.avg(error).alias("all"))
        b = F.greatest(F.coalesce("own", "all"), F.lit(K.EPSILON)).alias("b")
        return bounded_broadcast(stored(means.select("source", b), "scales"))

    plain = rows.withColumns({"weight": F.lit(1.0), "loss": F.lit(None).cast("double")})
    model, done = least_squares(plain)[0], []
    for _ in range(rounds + 1):
        scales = scales_of(model, done[-1] if done else None)
        weighted, limit = weighted_rows(rows, model, scales, None, fdr)
        following, total, n_kept, n = least_squares(weighted)
        found = Round(model, scales, limit, (total + K.EPSILON) / (n_kept + K.EPSILON), n_kept, n)
        if done and not found.score < done[-1].score - LEAST_GAIN:
            break
        done.append(found)
        model = following
    return RobustFit(rows, done)

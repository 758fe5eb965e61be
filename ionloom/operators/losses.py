"""Masked quality scores of predictions, and averages of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ionloom import constants as K
from ionloom.functions import metrics as M
from ionloom.operators.distributions import mark_inliers
from ionloom.operators.frames import attach
from ionloom.session import materialise

INITIAL_SCALE = 10.0    # what the scales start from before they are fitted


def source_scales(df: DataFrame, pred: str, true: str, source: str) -> DataFrame:
    """Maximum-likelihood Laplace scale per source: mean absolute error, at least epsilon."""
    error = F.abs(F.col(pred) - F.col(true))
    return df.groupBy(source).agg(F.greatest(F.avg(error), F.lit(K.EPSILON)).alias("b"))


def masked_mean(value: Column, kept: Column, eps: float = K.EPSILON) -> Column:
    total = F.sum(F.when(kept, value).otherwise(F.lit(0.0)))
    return (total + F.lit(eps)) / (F.count_if(kept) + F.lit(eps))


def rt_likelihood_rows(
    df: DataFrame, pred: str, true: str, source: str, scales: DataFrame | None = None,
    fdr: float = K.TRAIN_FDR,
) -> DataFrame:
    """Add norm_error, neg_log_l, kept (error below the Laplace quantile) and unseen (no scale of its own)."""
    scales = materialise(source_scales(df, pred, true, source) if scales is None else scales)
    pooled = scales.agg(F.avg("b")).scalar()
    rows = attach(df, scales, [source])
    # a source without a scale takes the mean scale of the others, or the initial one
    b = F.greatest(F.coalesce(F.col("b"), pooled, F.lit(INITIAL_SCALE)), F.lit(K.EPSILON))
    rows = rows.withColumn("unseen", F.col("b").isNull())
    rows = rows.withColumn("norm_error", F.abs(F.col(pred) - F.col(true)) / b).withColumn(
        "neg_log_l", F.col("norm_error") + F.log(2 * b)
    )
    return mark_inliers(rows, "norm_error", "laplace", fdr)


def rt_masked_likelihood(
    df: DataFrame, pred: str, true: str, source: str, scales: DataFrame | None = None,
    fdr: float = K.TRAIN_FDR,
) -> DataFrame:
    rows = rt_likelihood_rows(df, pred, true, source, scales, fdr)
    return rows.agg(
        masked_mean(F.col("neg_log_l"), F.col("kept")).alias("score"),
        F.count_if("kept").alias("n_kept"),
        F.count(F.lit(1)).alias("n"),
        F.count_if("unseen").alias("n_unseen"),
    )


def spectral_scores(df: DataFrame, pred: str, true: str) -> DataFrame:
    """Add the masked cosine of two ion vectors and its negative logit."""
    return df.withColumn("cosine", M.spectral_cosine(pred, true)).withColumn(
        "score", M.negative_logit("cosine")
    )


def spectral_masked_score(
    df: DataFrame, pred: str, true: str, fdr: float = K.TRAIN_FDR
) -> DataFrame:
    return masked_score(spectral_scores(df, pred, true).select("cosine", "score"), fdr)


def masked_score(scored: DataFrame, fdr: float = K.TRAIN_FDR) -> DataFrame:
    """Mean of cosine and, without outliers, of score. Reads its input twice."""
    rows = mark_inliers(scored, "score", "gumbel", fdr)
    return rows.agg(
        masked_mean(F.col("score"), F.col("kept")).alias("score"),
        F.avg("cosine").alias("mean_cosine"),
        F.count_if("kept").alias("n_kept"),
        F.count(F.lit(1)).alias("n"),
    )


def weighted_mean_loss(df: DataFrame, loss: str, size: str, groups: Sequence[str] = ()) -> DataFrame:
    """Batch losses averaged by batch size."""
    mean = F.sum(F.col(loss) * F.col(size)) / F.sum(size)
    return df.groupBy(*groups).agg(mean.alias("epoch_loss"), F.sum(size).alias("n_samples"))

"""The joint fit of retention weights, scales and outlier mask."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom import constants as K
from ionloom.functions.encoding import integer_codes
from ionloom.operators import losses, models, robust
from ionloom.plans.training import train_retention

WEIGHTS = {s: i * 0.5 for i, s in enumerate("ACDEFGHIK")}


def peptides(n, seed=1):
    rng = random.Random(seed)
    for i in range(n):
        seq = "".join(rng.choices("ACDEFGHIK", k=rng.randint(6, 20)))
        source = "ab"[i % 2]
        noise = rng.gauss(0, 0.05 if source == "a" else 0.5)
        wild = 400.0 if i % 50 == 0 else 0.0
        yield i, f"-{seq}_", 3 + sum(WEIGHTS[s] for s in seq) + noise + wild, source


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(peptides(1500)), "id long, CodedPeptideSeq string, HI double, Source string").repartition(5).cache()


@pytest.fixture(scope="module")
def fit(rows):
    return robust.fit_robust_retention(rows)


def spread(model, rows):
    clean = rows.where("id % 50 <> 0").withColumn("p", model.predict(integer_codes("CodedPeptideSeq")))
    return clean.agg(F.avg(F.abs(F.col("p") - F.col("HI")))).first()[0]


def test_likelihood_falls_every_round(fit):
    scores = [r.score for r in fit.rounds]
    assert len(scores) > 2 and all(b < a for a, b in zip(scores, scores[1:]))


def test_wild_rows_do_not_move_the_weights(fit, rows):
    plain = models.fit_retention(rows)
    assert spread(fit.model, rows) < 0.3 < spread(plain, rows)
    scales = {r["source"]: r["b"] for r in fit.last.scales.collect()}
    assert scales["a"] < scales["b"] < 2
    assert fit.last.n_kept <= fit.last.n - 30


def test_least_squares_equals_numpy(spark, rows):
    some = rows.limit(200).select(integer_codes("CodedPeptideSeq").alias("codes"), F.col("HI").alias("y"), (F.col("id") % 7 + 1.0).alias("weight"), F.when(F.col("id") % 2 == 0, 0.5).alias("loss")).cache()
    model, total, kept, n = robust.least_squares(some)
    assert (total, kept, n) == (kept / 2, some.where("loss > 0").count(), 200)
    table = some.toPandas()
    x = np.stack([np.append(1.0, np.bincount(c, minlength=K.N_STATES)[1:]) for c in table["codes"]])
    w = np.sqrt(table["weight"].to_numpy())
    want = x @ np.linalg.lstsq(x * w[:, None], table["y"].to_numpy() * w, rcond=None)[0]
    got = [r[0] for r in some.select(model.predict("codes")).collect()]
    assert got == pytest.approx(want, abs=1e-6)


def test_weighted_normal_equations(fit):
    table = fit.weighted().toPandas()
    x = np.stack([np.append(1.0, np.bincount(c, minlength=K.N_STATES)[1:]) for c in table["codes"]])
    part = table["weight"].to_numpy() * (table["y"] - table["pred"]).to_numpy()
    assert np.abs(x.T @ part).max() < 1e-6 * np.abs(x * part[:, None]).sum(axis=0).max()


def test_score_is_the_masked_likelihood(fit):
    scored = fit.rows.withColumn("pred", fit.model.predict("codes"))
    want = losses.rt_masked_likelihood(scored, "pred", "y", "source", fit.last.scales).first()
    assert fit.last.score == pytest.approx(want["score"]) and fit.last.n_kept == want["n_kept"]


def test_partitioning_does_not_matter(rows, fit):
    other = robust.fit_robust_retention(rows.repartition(1))
    assert len(other.rounds) == len(fit.rounds)
    assert other.last.score == pytest.approx(fit.last.score, abs=1e-6)


def test_awkward_rows(spark):
    shape = "id long, CodedPeptideSeq string, HI double, Source string, weight string, y string"
    rows = [(i, c, y, s, "clash", "clash") for i, c, y, s in peptides(60)]
    rows += [(1, None, 5.0, "a", "", ""), (2, "-ACD_", None, "a", "", ""), (3, "-ACDACD_", 7.5, None, "", "")] * 2
    found = robust.fit_robust_retention(spark.createDataFrame(rows, shape))
    assert found.last.n == 62
    assert {r["source"] for r in found.last.scales.collect()} == {"a", "b", None}
    one = robust.fit_robust_retention(spark.createDataFrame([(1, "-ACD_", 7.0, "a")], "id long, CodedPeptideSeq string, HI double, Source string"))
    assert one.rows.select(one.model.predict("codes")).first()[0] == pytest.approx(7.0)
    with pytest.raises(ValueError):
        robust.fit_robust_retention(spark.createDataFrame([], shape))


def test_training_with_the_masked_likelihood(rows):
    plain, joint = (train_retention(rows, ["id"], loss=loss) for loss in ("squaredError", "maskedLikelihood"))
    assert joint.evaluation.first()["score"] < plain.evaluation.first()["score"]
    assert {r["Source"] for r in joint.scales.collect()} == {"a", "b"}

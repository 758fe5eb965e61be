"""Fragment intensities as lines in the collision energy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom import constants as K
from ionloom.functions.encoding import charge_one_hot, integer_codes
from ionloom.operators import energy, models
from ionloom.plans.training import train_fragments

SHAPE = "coded_seq string, precursor_z int, frag_type string, nce double, ion_array array<array<float>>, dataset string"


def sample(seq, z, frag_type, nce, level):
    n = len(seq) - 1
    rows = [[float(level(c, nce)) if i < n else -1.0 for i in range(K.MAX_IONS)] for c in range(K.N_CHANNELS)]
    return f"-{seq}_", z, frag_type, nce, rows, "set"


def level(channel, nce):
    return 0.2 + 0.1 * channel + (0.01 if channel % 2 else -0.004) * (nce - 30)


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(2)
    rows = []
    for i in range(120):
        seq = "".join(rng.choices("ACDEFGH", k=rng.randint(6, 12)))
        rows.append(sample(seq, 2 + i % 2, "hcd", [20.0, 25.0, 30.0, 35.0][i % 4], level))
        rows.append(sample(seq, 2, "CID", 35.0, lambda c, _: 0.5))
    return spark.createDataFrame(rows, SHAPE).repartition(4).cache()


@pytest.fixture(scope="module")
def sums(samples):
    return energy.energy_sums(energy.energy_context(samples)).cache()


def test_lines_are_found(sums):
    table = energy.fit_energy(sums, shrink=0.5)
    for r in table.where("frag_type = 'HCD'").select("channel", "coarse_base", "coarse_slope").distinct().collect():
        for e in (20, 35):
            assert r["coarse_base"] + r["coarse_slope"] * e == pytest.approx(level(r["channel"], e), abs=0.05)
    trap = table.where("frag_type = 'CID' AND n > 100").collect()
    assert all(abs(r["base"] - 0.5) < 0.05 for r in trap)


def test_sums_of_parts_are_those_of_the_whole(samples, sums):
    parts = [energy.energy_sums(energy.energy_context(samples.where(f"nce {op} 25"))) for op in ("<=", ">")]
    merged = energy.merge_sums(*parts).orderBy(*models.CONTEXT).toPandas()
    whole = sums.orderBy(*models.CONTEXT).toPandas()[merged.columns]
    assert len(merged) == len(whole)
    assert np.allclose(merged[list(energy.SUMS)], whole[list(energy.SUMS)])


@pytest.mark.parametrize("shrink, low, high", [(0.01, 0.9, 1.0), (20.0, 0.4, 0.5), (1e6, 0.35, 0.41)])
def test_few_ions_are_drawn_to_the_coarser_context(spark, shrink, low, high):
    shape = "channel int, charge int, frag_type string, position_bin int, residue_left string, residue_right string, n double, x double, xx double, y double, xy double"
    rows = [(0, 2, "HCD", 1, "A", "C", 100.0, 3000.0, 92_500.0, 40.0, 1200.0), (0, 2, "HCD", 1, "W", "W", 1.0, 30.0, 900.0, 1.0, 30.0)]
    found = energy.fit_energy(spark.createDataFrame(rows, shape), shrink).where("residue_left = 'W'").first()
    assert found["n"] == 1 and low < found["base"] + 30 * found["slope"] < high


def test_two_energies_give_different_spectra(samples, sums):
    table = energy.fit_energy(sums)
    model = energy.load_energy_model(table).make_model()()
    rows = samples.where("frag_type = 'hcd'").select(integer_codes("coded_seq").alias("c"), charge_one_hot("precursor_z").alias("z")).toPandas()
    codes, charge = np.stack(rows["c"]), np.stack(rows["z"])
    low, high = (model(codes, charge, np.full(len(codes), e)).reshape(len(codes), K.N_CHANNELS, -1) for e in (20.0, 35.0))
    real = np.arange(K.MAX_IONS)[None] < ((codes != 0).sum(axis=1) - 3)[:, None]
    assert (high[:, 1][real] > low[:, 1][real]).all() and (high[:, 0][real] < low[:, 0][real]).all()
    assert not low[:, 0][~real].any() and low.min() >= 0 and high.max() <= 1


def test_join_and_arrays_score_alike(samples, sums):
    table = energy.fit_energy(sums)
    contexts = energy.energy_context(samples.where("frag_type = 'hcd'"))
    total = energy.score_energy_table(contexts, table).agg(F.sum("predicted")).first()[0]
    model = energy.load_energy_model(table).make_model()()
    rows = samples.where("frag_type = 'hcd'").select("nce", integer_codes("coded_seq").alias("c"), charge_one_hot("precursor_z").alias("z")).toPandas()
    arrays = model(np.stack(rows["c"]), np.stack(rows["z"]), rows["nce"].to_numpy()[:, None]).astype(float).sum()
    assert arrays == pytest.approx(total, rel=1e-5)


def test_unseen_contexts_fall_back(spark, sums):
    table = energy.fit_energy(sums)
    row = spark.createDataFrame([(0, 6, "HCD", 9, "W", "W", 1.0, 30.0), (0, 6, None, None, None, None, None, 30.0)], "channel int, charge int, frag_type string, position_bin int, residue_left string, residue_right string, intensity double, energy double")
    channel = table.where("channel = 0 AND frag_type = 'HCD'").first()
    found = {r["frag_type"]: r["predicted"] for r in energy.score_energy_table(row, table).collect()}
    assert found["HCD"] == pytest.approx(channel["channel_base"] + 30 * channel["channel_slope"]) and found[None] == 0.0


def test_empty_and_null_energies(spark, samples):
    none = energy.fit_energy(energy.energy_sums(energy.energy_context(samples.limit(0))))
    assert none.collect() == []
    one = samples.limit(1).withColumn("nce", F.lit(None).cast("double"))
    lines = energy.fit_energy(energy.energy_sums(energy.energy_context(one))).collect()
    assert lines and all(r["slope"] == 0.0 for r in lines)


def test_training_uses_the_energy(samples):
    flat, lines = (train_fragments(samples, shrink=s) for s in (None, 5.0))
    assert lines.evaluation.first()["mean_cosine"] >= flat.evaluation.first()["mean_cosine"] - 1e-4
    assert set(lines.models) == {"HCD", "CID"}

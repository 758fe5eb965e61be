import math
import random
import statistics

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ionloom import constants as K
from ionloom.functions import masses as S
from ionloom.operators import assembly, distributions as D, frames, losses, models
from ionloom.operators.digestion import peptides_to_proteins, unique_peptides
from ionloom.operators.matching import match_arrays, match_ions, nearest_in_batch, nearest_intensities
from ionloom.operators.modification import expand_charges
from ionloom.operators.splits import exact_split


def brute_match(ions, peaks, resolution):
    """First nearest peak by index, within the tolerance; 0 otherwise."""
    out = {}
    for spectrum, ion, mz in ions:
        mine = [p for p in peaks if p[0] == spectrum]
        best = min(mine, key=lambda p: (abs(p[2] - mz), p[1]), default=None)
        tol = 20e-6 * mz if resolution == "high" else 0.35
        out[spectrum, ion] = best[3] if best and mz != 0.0 and abs(best[2] - mz) <= tol else 0.0
    return out


def spectra_fixture(seed, hot=False):
    rng = random.Random(seed)
    ions, peaks = [], []
    for spectrum in range(12):
        for ion in range(20):
            ions.append((spectrum, ion, 0.0 if ion == 0 else rng.uniform(100, 2000)))
        for index in range(0 if spectrum == 3 else 60):
            near = rng.choice(ions[-19:])[2]
            shift = rng.choice([0, 1, -1, 0.5, 1.001, 0.999]) * (20e-6 * near if rng.random() < 0.5 else 0.35)
            peaks.append((spectrum, index, near + shift, float(rng.randint(1, 50))))
    # equidistant peaks on both sides, and two peaks of one m/z
    ions += [(0, 98, 500.0), (0, 99, 700.0)]
    peaks += [(0, 1000, 499.875, 5.0), (0, 1001, 500.125, 6.0), (0, 1003, 700.0, 8.0), (0, 1002, 700.0, 7.0)]
    if hot:
        peaks += [(1, 2000 + i, 800.0 + (i % 7) * 1e-3, 1.0 + i % 3) for i in range(4000)]
        ions += [(1, 200 + i, 800.0 + i * 1e-3) for i in range(5)]
    return ions, peaks


@pytest.mark.parametrize("resolution", ["high", "low"])
@pytest.mark.parametrize("hot,salts,parts", [(False, 1, 8), (True, 4, 1), (True, 1, 64)])
def test_match_equals_brute_force(spark, resolution, hot, salts, parts):
    ions, peaks = spectra_fixture(3, hot)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = match_ions(
            spark.createDataFrame(ions, "spectrum_id int, ion int, mz double"),
            spark.createDataFrame(peaks, "spectrum_id int, peak_index int, mz double, intensity double"),
            ["spectrum_id"],
            ["ion"],
            resolution,
            salts,
        ).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert {(r["spectrum_id"], r["ion"]): r["intensity"] for r in found} == brute_match(ions, peaks, resolution)
    assert len(found) == len(ions)


@pytest.mark.parametrize("resolution", ["high", "low"])
def test_array_match_equals_brute_force(resolution):
    ions, peaks = spectra_fixture(5, True)
    want = brute_match(ions, peaks, resolution)
    for spectrum in range(12):
        mine = sorted((p for p in peaks if p[0] == spectrum), key=lambda p: p[1])
        wanted = [i for i in ions if i[0] == spectrum]
        got = nearest_intensities(
            np.array([i[2] for i in wanted]), np.array([p[2] for p in mine]), np.array([p[3] for p in mine]), resolution
        )
        assert list(got) == [want[spectrum, i[1]] for i in wanted]


def test_match_arrays_column(spark):
    df = spark.createDataFrame([([100.0, 0.0, 300.0], [100.1, 299.0], [5.0, 7.0]), ([1.0], [], [])], "w array<double>, m array<double>, i array<double>")
    got = [r[0] for r in df.select(match_arrays(F.col("w"), F.col("m"), F.col("i"), "low")).collect()]
    assert got == [[5.0, 0.0, 0.0], [0.0]]
    with pytest.raises(ValueError):
        match_arrays(F.col("w"), F.col("m"), F.col("i"), "none")


MODSEQS = [
    "ADELKEELK", "[+42.010565]AC[+57.021464]M[+15.994915]K", "AK", "S[+79.966331]S[+1.0][+2.0]K", "A" * 35,
    "[+1.5]AK[+2.5]", "C[-17.5]CCCCC",
]


def test_arrow_ladder_equals_column_ladder(spark):
    df = spark.createDataFrame([(m, z) for m in MODSEQS for z in (1, 2, 3)], "m string, z int")
    rows = df.select("m", "z", S.ladder_matrix(S.ladder_nano("m"), "z", 2).alias("mz")).collect()
    masses, possible = assembly.ion_masses(pa.array([r["m"] for r in rows]), np.array([r["z"] for r in rows]))
    mz = np.zeros(masses.shape)
    mz[possible] = assembly.ion_mz(masses, possible)
    for i, r in enumerate(rows):
        for c in range(4):
            n = len(r["mz"][c])
            assert np.where(possible[i, c, :n], mz[i, c, :n], 0.0).tolist() == r["mz"][c]
            assert not possible[i, c, n:].any()


def test_arrow_helpers_on_slices_and_empty():
    texts = pa.array(["xx", "-AcmK_", "-AK_"]).slice(1)
    assert assembly.code_matrix(texts)[:, :7].tolist() == [[38, 1, 21, 22, 9, 44, 0], [38, 1, 9, 44, 0, 0, 0]]
    assert assembly.code_matrix(pa.array([], pa.string())).shape == (0, 37)
    lengths, b, whole = assembly.prefix_masses(pa.array(["AK", ""]))
    assert lengths.tolist() == [2, 0] and b[1].sum() == 0 and whole[1] == K.WATER_NANO


def test_peptides_to_proteins(spark):
    proteins = spark.createDataFrame([("p1", "AAAAAAKCCCCCCK"), ("p2", "AAAAAAK")], "ProteinAccession string, sequence string")
    rel = peptides_to_proteins(proteins, decoys=True)
    rows = {(r["PeptideSeq"], r["isDecoy"], r["ProteinAccession"]) for r in rel.collect()}
    assert ("AAAAAAK", False, "p1") in rows and ("AAAAAAK", True, "p2") in rows
    assert unique_peptides(rel).count() == 4  # equal targets and decoys are one; AAAAAAKCCCCCCK has its own decoy


def test_expand_charges(spark):
    df = spark.createDataFrame([("A",)], "PeptideSeq string")
    got = [tuple(r) for r in expand_charges(df, [2, 3], 30).collect()]
    assert got == [("A", 2, 30.0), ("A", 3, 30.0)]
    with pytest.raises(ValueError):
        expand_charges(df, [2, 3], [30.0])


@pytest.mark.parametrize("fraction", [0.0, 0.2, 0.5, 1.0])
@pytest.mark.parametrize("parts", [1, 16])
def test_exact_split(spark, fraction, parts):
    df = spark.range(0, 1001, numPartitions=parts)
    split = exact_split(df, fraction, ["id"])
    rows = {r["id"]: r["is_test"] for r in split.collect()}
    assert len(rows) == 1001 and sum(rows.values()) == round(1001 * fraction)
    import hashlib

    order = sorted(range(1001), key=lambda i: hashlib.md5(f"2447;{len(str(i))}:{i}".encode()).hexdigest())
    assert {i for i, t in rows.items() if t} == set(order[: round(1001 * fraction)])


def test_split_groups_of_every_size(spark):
    df = spark.createDataFrame([(g, i) for g in range(7) for i in range(g)], "g int, i int")
    split = exact_split(df, 0.5, ["i"], ["g"])
    got = {r["g"]: (r["n"], r["t"]) for r in split.groupBy("g").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert got == {g: (g, round(g * 0.5)) for g in range(1, 7)}  # half to even


def test_split_of_copies(spark):
    """A third and more of all rows are equal; every copy stays, and the size is exact."""
    rows = [("hot", 1)] * 700 + [("cold", i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v int")
    split = exact_split(df, 0.3, ["k"], unique_key=False).collect()
    assert len(split) == 1000 and sum(r["is_test"] for r in split) == 300
    assert sum(r["k"] == "hot" for r in split) == 700
    with pytest.raises(Exception, match="identify"):
        exact_split(df, 0.3, ["k"]).collect()


def test_last_per_key_and_new_rows(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y")], "k string, o int, v string")
    assert {tuple(r) for r in frames.last_per_key(df, ["k"], F.col("o")).collect()} == {("a", 2, None), ("b", 1, "y")}
    old = spark.createDataFrame([("a",), ("a",)], "k string")
    for limit in (0, 1000):
        assert [r["k"] for r in frames.new_rows(df, old, ["k"], limit).collect()] == ["b"]


def test_attach_by_broadcast_and_by_shuffle(spark):
    df = spark.createDataFrame([("a", 1), ("z", 2)], "k string, v int")
    small = spark.createDataFrame([("a", 9)], "k string, w int")
    for limit in (0, 1000):
        assert {tuple(r) for r in frames.attach(df, small, ["k"], limit).collect()} == {("a", 1, 9), ("z", 2, None)}
    assert {tuple(r) for r in frames.attach(df, small.select("w"), []).collect()} == {("a", 1, 9), ("z", 2, 9)}


@pytest.mark.parametrize("name", D.DISTRIBUTIONS)
def test_distributions(spark, name):
    rng = random.Random(1)
    x = [rng.gauss(10, 3) for _ in range(500)]
    df = spark.createDataFrame([(v, i % 2) for i, v in enumerate(x)], "x double, g int")
    got = D.fit(df, "x", name).first()
    mean, sd = statistics.fmean(x), statistics.stdev(x)
    if name == "gaussian":
        mu, scale = mean, sd
        cdf = statistics.NormalDist(mu, scale).cdf
    elif name == "laplace":
        mu, scale = mean, statistics.fmean(abs(v - mean) for v in x)
        cdf = lambda v: 0.5 * math.exp((v - mu) / scale) if v <= mu else 1 - 0.5 * math.exp(-(v - mu) / scale)
    else:
        scale = sd * math.sqrt(6) / math.pi
        mu = mean - 0.57721 * scale
        cdf = lambda v: math.exp(-math.exp(-(v - mu) / scale))
    assert (got["mu"], got["scale"]) == (pytest.approx(mu), pytest.approx(scale))
    fitted = df.select("x", D.cumulative(name, F.lit(mu), F.lit(scale), F.col("x")).alias("c")).collect()
    assert all(r["c"] == pytest.approx(cdf(r["x"])) for r in fitted)
    for q in (0.01, 0.3, 0.99):
        at = df.limit(1).select(D.quantile(name, F.lit(mu), F.lit(scale), q)).first()[0]
        assert cdf(at) == pytest.approx(q, abs=1e-9)
    kept = D.mark_inliers(df, "x", name, 0.05, ["g"]).groupBy("g").agg(F.count_if("kept").alias("n")).collect()
    assert all(200 < r["n"] <= 250 for r in kept)


def test_unknown_distribution(spark):
    with pytest.raises(ValueError):
        D.fit(spark.range(3), "id", "cauchy")


def test_group_of_one_row(spark):
    df = spark.createDataFrame([(1.0, "a")], "x double, g string")
    assert D.mark_inliers(df, "x", "gaussian", groups=["g"]).first()["kept"] is None


def test_masked_likelihood(spark):
    rows = [(float(i), float(i) + (1 if i % 2 else -2), "s") for i in range(40)] + [(0.0, 500.0, "s")]
    df = spark.createDataFrame(rows, "pred double, true double, source string")
    errors = [abs(p - t) for p, t, _ in rows]
    b = statistics.fmean(errors)
    x = [e / b for e in errors]
    mu = statistics.fmean(x)
    limit = mu - statistics.fmean(abs(v - mu) for v in x) * math.log(2 - 2 * 0.99)
    kept = [v + math.log(2 * b) for v in x if v < limit]
    got = losses.rt_masked_likelihood(df, "pred", "true", "source").first()
    assert got["n_kept"] == len(kept) == 40
    assert got["score"] == pytest.approx((sum(kept) + 1e-7) / (len(kept) + 1e-7))


def test_weighted_mean(spark):
    df = spark.createDataFrame([(1.0, 1), (4.0, 3)], "loss double, n int")
    assert losses.weighted_mean_loss(df, "loss", "n").first()["epoch_loss"] == pytest.approx(13 / 4)


def test_retention_model_recovers_weights(spark):
    rng = random.Random(2)
    truth = {c: rng.uniform(-3, 3) for c in K.CANONICAL}
    rows = []
    for _ in range(400):
        p = "".join(rng.choices(K.CANONICAL, k=rng.randint(6, 30)))
        rows.append(("-" + p + "_", 5.0 + sum(truth[c] for c in p)))
    df = spark.createDataFrame(rows, "CodedPeptideSeq string, HI double")
    model = models.fit_retention(df)
    from ionloom.functions.encoding import integer_codes

    coded = df.withColumn("codes", integer_codes("CodedPeptideSeq"))
    both = coded.select(
        "HI", model.predict("codes").alias("a"), models.score_retention_time(model.make_model(), "codes").alias("b"),
        assembly.score_coded(model.make_model(), "CodedPeptideSeq").alias("c"),
    ).collect()
    for r in both:
        assert r["a"] == pytest.approx(r["HI"], abs=1e-4)
        assert r["a"] == pytest.approx(r["b"], abs=1e-3) == pytest.approx(r["c"], abs=1e-3)


def test_hot_bin_is_split_by_aqe(spark):
    """One bin holds most peaks: the join is split on their side, and the result is whole."""
    ions = spark.createDataFrame([(s, i, 500.0 + i * 30) for s in range(8) for i in range(10)], "spectrum_id int, ion int, mz double")
    cold = spark.range(4000).selectExpr("cast(id % 8 as int) spectrum_id", "id peak_index", "100 + id * 0.4 mz", "cast(1 as float) intensity")
    hot = spark.range(0, 400000, 1, 8).selectExpr("1 spectrum_id", "id + 10000 peak_index", "500 + 1e-9 * id mz", "cast(2 as float) intensity")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        matched = match_ions(ions, hot.unionByName(cold), ["spectrum_id"], ["ion"], "high")
        rows = matched.collect()
        plan = matched._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "skew=true" in plan or "isSkewJoin=true" in plan
    assert len(rows) == 80
    assert {r["ion"]: r["intensity"] for r in rows if r["spectrum_id"] == 1}[0] == 2.0


@pytest.mark.parametrize("groups, unique", [([], True), (["g"], True), (["g"], False)])
def test_split_evaluates_its_input_twice(spark, groups, unique):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    rows = spark.range(3000).withColumn("g", F.col("id") % 5).mapInPandas(count, "id long, g long")
    exact_split(rows, 0.2, ["id"], groups, unique_key=unique).write.format("noop").mode("overwrite").save()
    assert seen.value == 3000 * (2 if unique else 3)    # copies at the boundary are written apart


@pytest.mark.parametrize("resolution", ["high", "low"])
def test_a_batch_of_spectra_matches_like_each_alone(resolution):
    rng = np.random.default_rng(5)
    spectra = []
    for _ in range(300):
        peaks = np.round(rng.uniform(100, 110, rng.integers(0, 25)), rng.integers(0, 5))
        ions = np.concatenate([np.round(rng.uniform(99, 111, rng.integers(0, 12)), 1), rng.choice(peaks, min(len(peaks), 3)), [0.0] * rng.integers(0, 2)])
        spectra.append((rng.permutation(ions), rng.permutation(peaks), rng.uniform(1, 9, len(peaks))))
    got = nearest_in_batch(*zip(*spectra), resolution)
    assert len(got) == 300
    for found, (ions, peaks, heights) in zip(got, spectra):
        assert found.tolist() == nearest_intensities(ions, peaks, heights, resolution).tolist()
    assert [f.tolist() for f in nearest_in_batch([None, [1.0]], [[1.0], None], [[2.0], None], resolution)] == [[], [0.0]]

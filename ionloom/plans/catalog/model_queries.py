"""Batched scoring, model fits, and the whole library build."""

from __future__ import annotations

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ionloom import constants as K
from ionloom.functions import encoding as E
from ionloom.operators import assembly, energy, models
from ionloom.operators.frames import union_frames
from ionloom.operators.modification import expand_charges
from ionloom.operators.robust import fit_robust_retention
from ionloom.operators.splits import exact_split
from ionloom.plans.build_library import append_library, append_library_version, build_library, save_library, score_entries
from ionloom.plans.catalog import sql as Q
from ionloom.plans.catalog.registry import query
from ionloom.plans.catalog.tables import CAM, Tables
from ionloom.plans.training import evaluate_retention, train_fragments, train_retention
from ionloom.plans.training_sets import samples_from_tables
from ionloom.session import materialise, scratch_path, stored
from ionloom.sources import blobs, library, versions
from ionloom.sources.dlib import read_dlib
from ionloom.streaming.incremental import stream_library
from ionloom.streaming.proteins import current_relation, live_entries, score_relation, stream_relation


def plain_retention_model():
    """A user model with a closed form: codes weighted by their position modulo 7."""
    weights = 1 + np.arange(K.MAX_CODED_LEN) % 7
    return lambda codes: (codes.astype("float64") * weights).sum(axis=1) / 100.0


def plain_fragment_model():
    """A user model with a closed form: ((code * (channel + 1) + charge + energy) mod 17) - 4."""

    def predict(codes, charge, nce):
        z = charge.argmax(axis=1) + 1
        ions = codes[:, 1 : K.MAX_IONS + 1].astype("int64")
        cells = [
            (ions * (c + 1) + z[:, None] + nce.reshape(-1, 1).astype("int64")) % 17 - 4 for c in range(K.N_CHANNELS)
        ]
        return np.stack(cells, axis=1).reshape(len(codes), -1).astype("float32")

    return predict


def trap_fragment_model():
    """The same without an energy."""
    predict = plain_fragment_model()
    return lambda codes, charge: predict(codes, charge, np.zeros(len(codes)))


_CODED = "'-' || replace(PeptideSeq, 'C', 'c') || '_'"
_RT = f"""(list_sum(list_transform(list_zip({Q.codes(_CODED)}, range(0, 37)), lambda z: z[1] * (1 + z[2] % 7))) / 100.0::DOUBLE)"""


@query(
    "batched_retention_scores",
    f"WITH {Q.MODIFIED} SELECT PeptideModSeq, round({_RT}, 6) AS RTInSeconds FROM modified",
)
def batched_retention_scores(t: Tables):
    coded = t.modified().select("PeptideModSeq", assembly.coded_texts("PeptideModSeq").alias("coded"))
    scored = coded.withColumn("rt", assembly.score_coded(plain_retention_model, "coded"))
    return scored.select("PeptideModSeq", F.round("rt", 6).alias("RTInSeconds"))


_CELLS = f"""letters AS (
  SELECT PeptideModSeq, PeptideSeq, length(PeptideSeq) AS n, unnest(range(1, length(PeptideSeq) + 1)) AS pos,
         unnest(string_split(replace(PeptideSeq, 'C', 'c'), '')) AS s FROM modified),
predicted AS (
  SELECT PeptideModSeq, n, pos, z, channel,
         greatest((strpos('{K.ALPHABET}', s) * (channel + 1) + z + 30) % 17 - 4, 0) AS v
  FROM letters, (VALUES (2), (3)) c(z), (VALUES (0), (1), (2), (3)) h(channel)),
tops AS (
  SELECT PeptideModSeq, z, max(v) AS top FROM (
    SELECT PeptideModSeq, z, channel, pos, v FROM predicted WHERE pos <= 34
    UNION ALL SELECT PeptideModSeq, z, channel, 0, greatest((44 * (channel + 1) + z + 30) % 17 - 4, 0)
      FROM (SELECT DISTINCT PeptideModSeq, n, z, channel FROM predicted) WHERE n <= 33
    UNION ALL SELECT PeptideModSeq, z, channel, 0, greatest((z + 30) % 17 - 4, 0)
      FROM (SELECT DISTINCT PeptideModSeq, n, z, channel FROM predicted) WHERE n <= 32) GROUP BY ALL)"""


@query(
    "batched_fragment_scores",
    f"""WITH {Q.MODIFIED}, {_CELLS}
SELECT PeptideModSeq, z AS PrecursorCharge, count(*) AS n_cells, count(*) FILTER (v > 0) AS n_positive,
CAST(sum({Q.micro("CAST(v::DOUBLE / top AS FLOAT)::DOUBLE")}) AS BIGINT) AS total_micro
FROM predicted JOIN tops USING (PeptideModSeq, z) WHERE pos < n GROUP BY ALL""",
)
def batched_fragment_scores(t: Tables):
    """Scores of every precursor, normalised to the base peak and trimmed to the real ions."""
    coded = t.modified().select("PeptideModSeq", assembly.coded_texts("PeptideModSeq").alias("coded"))
    cells = expand_charges(coded, [2, 3], 30.0).select(
        "PeptideModSeq",
        "PrecursorCharge",
        assembly.array_totals(assembly.predicted_cells(plain_fragment_model, "coded", "PrecursorCharge")).alias("totals"),
    )
    return cells.select(
        "PeptideModSeq",
        "PrecursorCharge",
        F.col("totals.n").alias("n_cells"),
        F.col("totals.positive").alias("n_positive"),
        F.col("totals.micro").alias("total_micro"),
    )


@query(
    "library_entries",
    f"""WITH {Q.MODIFIED}, {_CELLS}, {Q.residue_rows("modified", "PeptideModSeq").replace("letters AS", "letters2 AS").replace("FROM letters JOIN", "FROM letters2 JOIN")},
{Q.ladder("PeptideModSeq")},
ions AS (
  SELECT PeptideModSeq, pos AS i, 0 AS kind, b AS nano FROM ladder WHERE pos < n
  UNION ALL SELECT PeptideModSeq, n - pos, 1, total - b FROM ladder WHERE pos < n),
whole AS (SELECT DISTINCT PeptideModSeq, total FROM ladder),
peaks AS (
  SELECT p.PeptideModSeq, p.z, CAST(v::DOUBLE / top AS FLOAT) AS intensity, {Q.mz("nano", "(1 + channel // 2)")} AS mz
  FROM predicted p JOIN tops USING (PeptideModSeq, z)
  JOIN ions ON ions.PeptideModSeq = p.PeptideModSeq AND ions.i = p.pos AND ions.kind = p.channel % 2)
SELECT PeptideModSeq, z AS PrecursorCharge, round({Q.mz("total", "z")}, 6) AS PrecursorMz, round({_RT}, 6) AS RTInSeconds,
count(mz) AS n_peaks, CAST(coalesce(sum({Q.micro("mz")}), 0) AS BIGINT) AS mz_micro,
CAST(coalesce(sum({Q.micro("intensity::DOUBLE")}), 0) AS BIGINT) AS intensity_micro
FROM modified JOIN whole USING (PeptideModSeq), (VALUES (2), (3)) c(z)
LEFT JOIN (SELECT PeptideModSeq AS m, z AS pz, mz, intensity FROM peaks WHERE intensity >= 0.001) ON m = PeptideModSeq AND pz = z
GROUP BY PeptideModSeq, PeptideSeq, z, total""",
)
def library_entries(t: Tables):
    """The whole build: digest, modify, code, score, ladder, zip, filter."""
    entries = score_entries(t.peptides(), plain_retention_model, plain_fragment_model, CAM, spectrum_as=assembly.spectrum_totals)
    return entries.select(
        "PeptideModSeq",
        "PrecursorCharge",
        F.round("PrecursorMz", 6).alias("PrecursorMz"),
        F.round("RTInSeconds", 6).alias("RTInSeconds"),
        "spectrum.n_peaks",
        "spectrum.mz_micro",
        "spectrum.intensity_micro",
    )


@query(
    "library_entries_without_energy",
    f"""WITH {Q.MODIFIED}, {_CELLS.replace("z + 30", "z")}
SELECT PeptideModSeq, z AS PrecursorCharge, count(*) FILTER (CAST(v::DOUBLE / top AS FLOAT) >= 0.001 AND 1 + channel // 2 <= z) AS n_peaks,
CAST(sum(CASE WHEN CAST(v::DOUBLE / top AS FLOAT) >= 0.001 AND 1 + channel // 2 <= z THEN {Q.micro("CAST(v::DOUBLE / top AS FLOAT)::DOUBLE")} ELSE 0 END) AS BIGINT) AS intensity_micro
FROM predicted JOIN tops USING (PeptideModSeq, z) WHERE pos < n GROUP BY ALL""",
)
def library_entries_without_energy(t: Tables):
    """Trap fragmentation: the model takes no collision energy."""
    entries = score_entries(t.peptides(), plain_retention_model, trap_fragment_model, CAM, beam=False, spectrum_as=assembly.spectrum_totals)
    return entries.select(
        "PeptideModSeq",
        "PrecursorCharge",
        "spectrum.n_peaks",
        "spectrum.intensity_micro",
    )


def _exported_and_read_back(t: Tables, proteins, piece_bytes: int = library.PIECE_BYTES):
    """The library files come and go piece by piece; what was read from all of them stays."""
    base, files, found = (scratch_path(t.spark, name) for name in ("built", "exported", "read-back"))
    save_library(t.spark, build_library(proteins, plain_retention_model, plain_fragment_model), base)
    for table, piece in library.export_pieces(t.spark, base, files, piece_bytes):
        if table == "entries":
            back = read_dlib(t.spark, piece).withColumn("s", blobs.unpack_arrays())
            rows = back.select(
                "PeptideModSeq",
                "PeptideSeq",
                "PrecursorCharge",
                F.round("RTInSeconds", 6).alias("RTInSeconds"),
                F.size("s.mzs").cast("bigint").alias("n_peaks"),
                assembly.array_totals("s.intensities")["micro"].alias("intensity_micro"),
            )
            rows.write.mode("append").options(**library.STORED).parquet(found)
    return t.spark.read.schema(rows.schema).parquet(found)


@query(
    "whole_library_exported_and_read_back",
    f"""WITH {Q.MODIFIED}, {_CELLS}
SELECT PeptideModSeq, PeptideSeq, z AS PrecursorCharge, round({_RT}, 6) AS RTInSeconds,
count(*) FILTER (CAST(v::DOUBLE / top AS FLOAT) >= 0.001) AS n_peaks,
CAST(sum(CASE WHEN CAST(v::DOUBLE / top AS FLOAT) >= 0.001 THEN {Q.micro("CAST(v::DOUBLE / top AS FLOAT)::DOUBLE")} ELSE 0 END) AS BIGINT) AS intensity_micro
FROM predicted JOIN tops USING (PeptideModSeq, z) JOIN modified USING (PeptideModSeq) WHERE pos < n GROUP BY PeptideModSeq, PeptideSeq, z""",
)
def whole_library_exported_and_read_back(t: Tables):
    """A library of all documents built, saved as Parquet, exported as library files and read from them."""
    return _exported_and_read_back(t, t.proteins().select("ProteinAccession", "sequence"))


def _retention_rows(t: Tables):
    return t.retention().withColumn("CodedPeptideSeq", E.coded_sequence("PeptideModSeq"))


@query(
    "retention_model_fit",
    f"""WITH {Q.RETENTION}, letters AS (SELECT doc_id, HI, unnest(string_split({_CODED}, '')) AS symbol FROM retention)
SELECT symbol, count(*) AS n, round(sum(HI) / count(*), 2) AS mean_fitted FROM letters GROUP BY symbol""",
)
def retention_model_fit(t: Tables):
    """Least squares over all rows, checked by its normal equations.

    For every symbol the count-weighted mean of the fitted values must equal that
    of the measured ones; this holds for the least-squares solution only.
    """
    rows = materialise(_retention_rows(t))
    model = models.fit_retention(rows)
    fitted = rows.withColumn("codes", E.integer_codes("CodedPeptideSeq")).withColumn(
        "pred", model.predict("codes")
    )
    symbols = fitted.select("pred", F.explode(F.split("CodedPeptideSeq", "")).alias("symbol"))
    return symbols.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("pred"), 2).alias("mean_fitted")
    )


@query(
    "retention_training",
    f"""WITH {Q.RETENTION}, split AS (SELECT *, row_number() OVER (ORDER BY {Q.shuffle_key("doc_id")}) <= round_even(count(*) OVER () * 0.2::DOUBLE, 0) AS is_test FROM retention),
letters AS (SELECT is_test, HI, unnest(string_split({_CODED}, '')) AS symbol FROM split)
SELECT symbol, count(*) FILTER (NOT is_test) AS n_train, count(*) FILTER (is_test) AS n_test,
round(avg(HI) FILTER (NOT is_test), 2) AS mean_measured, round(avg(HI) FILTER (NOT is_test), 2) AS mean_fitted FROM letters GROUP BY symbol""",
)
def retention_training(t: Tables):
    """Split and fit of the training job, checked by the normal equations of its training part."""
    rows = materialise(_retention_rows(t))
    trained = train_retention(rows, ["doc_id"])
    fitted = exact_split(rows, K.VALIDATION_FRACTION, ["doc_id"]).withColumn(
        "pred", trained.model.predict(E.integer_codes("CodedPeptideSeq"))
    )
    symbols = fitted.select("is_test", "HI", "pred", F.explode(F.split("CodedPeptideSeq", "")).alias("symbol"))
    of_train = {c: F.round(F.avg(F.when(~F.col("is_test"), F.col(c))), 2) for c in ("HI", "pred")}
    return symbols.groupBy("symbol").agg(
        F.count_if(~F.col("is_test")).alias("n_train"),
        F.count_if("is_test").alias("n_test"),
        of_train["HI"].alias("mean_measured"),
        of_train["pred"].alias("mean_fitted"),
    )


@query(
    "robust_retention_fit",
    f"""WITH {Q.RETENTION}, letters AS (SELECT unnest(string_split({_CODED}, '')) AS symbol FROM retention)
SELECT symbol, count(*) AS n, 0.0::DOUBLE AS gap, TRUE AS likelihood_falls, TRUE AS better_than_least_squares FROM letters GROUP BY symbol""",
)
def robust_retention_fit(t: Tables):
    """Weights, scales and mask fitted together, checked by the weighted normal equations of the last round.

    For every symbol the weighted errors must add up to nothing (``gap``, as a share of the
    weighted absolute errors), and the masked likelihood must have fallen in every round.
    """
    fit = fit_robust_retention(_retention_rows(t))
    scores = [r.score for r in fit.rounds]
    falls = all(b < a for a, b in zip(scores, scores[1:]))
    symbols = fit.weighted().select(
        F.explode("codes").alias("code"), F.col("weight"), (F.col("weight") * (F.col("y") - F.col("pred"))).alias("part")
    )
    sums = symbols.where("code > 0").groupBy("code").agg(
        F.count(F.lit(1)).alias("n"), (F.sum("part") / F.greatest(F.sum(F.abs("part")), F.lit(K.EPSILON))).alias("gap")
    )
    return sums.select(
        F.substr(F.lit(K.ALPHABET), F.col("code"), F.lit(1)).alias("symbol"),
        "n",
        (F.round("gap", 5) + 0.0).alias("gap"),
        F.lit(falls).alias("likelihood_falls"),
        F.lit(len(scores) > 1 and scores[-1] < scores[0]).alias("better_than_least_squares"),
    )


@query(
    "retention_evaluation",
    f"""WITH {Q.RETENTION}, split AS (SELECT *, row_number() OVER (ORDER BY {Q.shuffle_key("doc_id")}) <= round_even(count(*) OVER () * 0.2::DOUBLE, 0) AS is_test,
  {_RT} AS p FROM retention),
s AS (SELECT Source, greatest(avg(abs(p - HI)), 1e-7) AS b FROM split WHERE NOT is_test GROUP BY Source),
e AS (SELECT abs(p - HI) / coalesce(b, pooled) AS x, abs(p - HI) / coalesce(b, pooled) + ln(2 * coalesce(b, pooled)) AS nll, b IS NULL AS unseen
  FROM split LEFT JOIN s USING (Source), (SELECT avg(b) AS pooled FROM s) WHERE is_test),
f AS (SELECT any_value(mu) AS mu, avg(abs(x - mu)) AS s FROM e, (SELECT avg(x) AS mu FROM e)),
k AS (SELECT nll, unseen, x < mu - s * ln(2 - 2 * (1 - 0.01)) AS kept FROM e, f)
SELECT round((sum(CASE WHEN kept THEN nll ELSE 0 END) + 1e-7) / (count(*) FILTER (kept) + 1e-7), 5) AS score,
count(*) FILTER (kept) AS n_kept, count(*) AS n, count(*) FILTER (unseen) AS n_unseen FROM k""",
)
def retention_evaluation(t: Tables):
    """The evaluation of the training job, of a model with a closed form: scales of the training part, score of the test part."""
    rows = materialise(_retention_rows(t).withColumn("codes", E.integer_codes("CodedPeptideSeq")))
    scored = rows.withColumn("pred", models.score_retention_time(plain_retention_model))
    split = materialise(exact_split(scored, K.VALIDATION_FRACTION, ["doc_id"]))
    _, found = evaluate_retention(split.where(~F.col("is_test")), split.where("is_test"))
    return found.select(F.round("score", 5).alias("score"), "n_kept", "n", "n_unseen")


_CONTEXTS = """contexts AS (
  SELECT channel, PrecursorCharge AS charge, upper(frag_type) AS frag_type, n, cell, coded_seq,
         CASE WHEN channel % 2 = 0 THEN i ELSE n - i END AS cut FROM filled WHERE cell >= 0),
keyed AS (
  SELECT channel, charge, frag_type, CAST(floor(cut * 10 / n) AS INTEGER) AS position_bin,
         coded_seq[cut + 1] AS residue_left, coded_seq[cut + 2] AS residue_right, cell::DOUBLE AS cell FROM contexts)"""


def _samples_sql() -> str:
    from ionloom.plans.catalog.matching_queries import _SAMPLES_SQL

    return _SAMPLES_SQL


@query(
    "fragment_model_fit",
    f"""WITH {_samples_sql()}, {_CONTEXTS},
coarse AS (SELECT channel, charge, frag_type, position_bin, avg(cell) AS c FROM keyed GROUP BY ALL),
by_channel AS (SELECT channel, avg(cell) AS h FROM keyed GROUP BY ALL)
SELECT CAST(channel AS INTEGER) AS channel, CAST(charge AS INTEGER) AS charge, frag_type, position_bin, residue_left, residue_right, count(*) AS n,
round(avg(cell), 6) AS mean, round(any_value(c), 6) AS coarse_mean, round(any_value(h), 6) AS channel_mean
FROM keyed JOIN coarse USING (channel, charge, frag_type, position_bin) JOIN by_channel USING (channel)
GROUP BY channel, charge, frag_type, position_bin, residue_left, residue_right""",
)
def fragment_model_fit(t: Tables):
    samples = materialise(samples_from_tables(t.spectra(), t.peaks(), "spectrum_id", "low"))
    table = models.fit_fragments(models.ion_context(samples))
    return table.select(
        *models.CONTEXT, "n", *[F.round(c, 6).alias(c) for c in ("mean", "coarse_mean", "channel_mean")]
    )


@query(
    "fragment_model_scores",
    f"""WITH {_samples_sql()}, {_CONTEXTS},
fine AS (SELECT channel, charge, frag_type, position_bin, residue_left, residue_right, avg(cell) AS m FROM keyed GROUP BY ALL)
SELECT CAST(channel AS INTEGER) AS channel, frag_type, count(*) AS n, round(sum(m), 6) AS predicted
FROM keyed JOIN fine USING (channel, charge, frag_type, position_bin, residue_left, residue_right) GROUP BY ALL""",
)
def fragment_model_scores(t: Tables):
    """The fitted means joined back to the ions they were fitted on."""
    samples = materialise(samples_from_tables(t.spectra(), t.peaks(), "spectrum_id", "low"))
    contexts = models.ion_context(samples)
    scored = models.score_context_table(contexts, models.fit_fragments(contexts))
    return scored.groupBy("channel", "frag_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("predicted"), 6).alias("predicted")
    )


@query(
    "fragment_training",
    f"""WITH {_samples_sql()},
split AS MATERIALIZED (SELECT spectrum_id, row_number() OVER (PARTITION BY dataset, frag_type, nce
    ORDER BY {Q.shuffle_key("dataset", "frag_type", "nce", "coded_seq", "PrecursorCharge")})
  <= round_even(count(*) OVER (PARTITION BY dataset, frag_type, nce) * 0.2::DOUBLE, 0) AS is_test FROM last_ones),
cells AS MATERIALIZED (SELECT spectrum_id, is_test, channel, i, n, PrecursorCharge AS charge, frag_type, cell,
  CASE WHEN channel % 2 = 0 THEN i ELSE n - i END AS cut, coded_seq FROM filled JOIN split USING (spectrum_id)),
keyed AS MATERIALIZED (SELECT spectrum_id, is_test, channel, i, n, charge, frag_type, cell, floor(cut * 10 / n) AS bin,
  coded_seq[cut + 1] AS l, coded_seq[cut + 2] AS r FROM cells),
train AS (SELECT * FROM keyed WHERE NOT is_test AND cell >= 0 AND i < n),
fine AS (SELECT channel, charge, frag_type, bin, l, r, avg(cell::DOUBLE) AS f FROM train GROUP BY ALL),
coarse AS (SELECT channel, charge, frag_type, bin, avg(cell::DOUBLE) AS c FROM train GROUP BY ALL),
whole AS (SELECT channel, avg(cell::DOUBLE) AS h FROM train GROUP BY ALL),
scored AS (SELECT spectrum_id, cell::DOUBLE AS t, (cell::DOUBLE + 1.0) / (cell::DOUBLE + 1.0 + 1e-7::DOUBLE) AS m,
  CASE WHEN i < n THEN coalesce(f, c, h, 0)::FLOAT::DOUBLE ELSE 0 END AS p
  FROM (SELECT * FROM keyed WHERE is_test) LEFT JOIN fine USING (channel, charge, frag_type, bin, l, r)
  LEFT JOIN coarse USING (channel, charge, frag_type, bin) LEFT JOIN whole USING (channel)),
cosines AS (SELECT spectrum_id, sum(p * m * t * m) / sqrt(greatest(sum(p * m * p * m), 1e-7)) / sqrt(greatest(sum(t * m * t * m), 1e-7)) AS cosine
  FROM scored GROUP BY spectrum_id),
scores AS (SELECT cosine, ln(greatest(1 - cosine, 1e-7)) - ln(greatest(cosine, 1e-7)) AS score FROM cosines),
g AS (SELECT avg(score) - 0.57721 * stddev_samp(score) * sqrt(6) / pi() AS mu, stddev_samp(score) * sqrt(6) / pi() AS s FROM scores),
k AS (SELECT cosine, score, score < mu - s * ln(-ln(1 - 0.01)) AS kept FROM scores, g)
SELECT round((sum(CASE WHEN kept THEN score ELSE 0 END) + 1e-7) / (count(*) FILTER (kept) + 1e-7), 3) AS score,
round(avg(cosine), 5) AS mean_cosine, count(*) FILTER (kept) AS n_kept, count(*) AS n FROM k""",
)
def fragment_training(t: Tables):
    """Split per dataset, fit per type, batched scoring and masked score of the test part."""
    samples = samples_from_tables(t.spectra(), t.peaks(), "spectrum_id", "low").drop("spectrum_id")
    found = train_fragments(samples).evaluation
    return found.select(F.round("score", 3).alias("score"), F.round("mean_cosine", 5).alias("mean_cosine"), "n_kept", "n")


_ENERGY = """20.0 + 5 * (spectrum_id // 2 % 4)"""
_LINES = f"""{_CONTEXTS.replace("SELECT channel, PrecursorCharge", "SELECT spectrum_id, channel, PrecursorCharge").replace("SELECT channel, charge,", "SELECT spectrum_id, channel, charge,")},
points AS (SELECT *, CASE WHEN frag_type = 'HCD' THEN {_ENERGY} ELSE 0.0 END::DOUBLE AS e FROM keyed),
fine AS (SELECT channel, charge, frag_type, position_bin, residue_left, residue_right, count(*)::DOUBLE AS n, sum(e) AS x, sum(e * e) AS xx,
  sum(cell) AS y, sum(e * cell) AS xy FROM points GROUP BY ALL),
coarse AS (SELECT channel, charge, frag_type, position_bin, sum(n) AS n, sum(x) AS x, sum(xx) AS xx, sum(y) AS y, sum(xy) AS xy FROM fine GROUP BY ALL),
top AS (SELECT channel, frag_type, sum(n) AS n, sum(x) AS x, sum(xx) AS xx, sum(y) AS y, sum(xy) AS xy FROM fine GROUP BY ALL),
c2 AS (SELECT c.channel, charge, frag_type, position_bin, c.n + 20 AS n, c.x + 20 / t.n * t.x AS x, c.xx + 20 / t.n * t.xx AS xx,
  c.y + 20 / t.n * t.y AS y, c.xy + 20 / t.n * t.xy AS xy FROM coarse c JOIN top t USING (channel, frag_type)),
f2 AS (SELECT channel, charge, frag_type, position_bin, residue_left, residue_right, f.n AS ions, f.n + 20 AS n, f.x + 20 / c.n * c.x AS x,
  f.xx + 20 / c.n * c.xx AS xx, f.y + 20 / c.n * c.y AS y, f.xy + 20 / c.n * c.xy AS xy
  FROM fine f JOIN c2 c USING (channel, charge, frag_type, position_bin)),
slopes AS (SELECT *, CASE WHEN xx / n - (x / n) ** 2 > 1e-6 THEN (xy / n - x / n * (y / n)) / (xx / n - (x / n) ** 2) ELSE 0 END AS slope FROM f2),
lines AS (SELECT *, y / n - slope * x / n AS base FROM slopes)"""


def _energy_samples(t: Tables):
    """Samples at four collision energies."""
    samples = samples_from_tables(t.spectra(), t.peaks(), "spectrum_id", "low")
    return materialise(samples.withColumn("nce", F.expr("20.0D + 5 * (spectrum_id div 2 % 4)")))


@query(
    "energy_fragment_fit",
    f"""WITH {_samples_sql()}, {_LINES}
SELECT CAST(channel AS INTEGER) AS channel, CAST(charge AS INTEGER) AS charge, frag_type, position_bin, residue_left, residue_right,
CAST(ions AS BIGINT) AS n, round(base, 6) + 0.0 AS base, round(slope, 6) + 0.0 AS slope FROM lines""",
)
def energy_fragment_fit(t: Tables):
    """A line in the collision energy per ion context, drawn towards the coarser contexts."""
    table = energy.fit_energy(energy.energy_sums(energy.energy_context(_energy_samples(t))))
    return table.select(*models.CONTEXT, "n", *[(F.round(c, 6) + 0.0).alias(c) for c in ("base", "slope")])


@query(
    "energy_fragment_scores",
    f"""WITH {_samples_sql()}, {_LINES},
scored AS (SELECT spectrum_id, least(greatest(base + slope * 20, 0), 1) AS low, least(greatest(base + slope * 40, 0), 1) AS high
  FROM points JOIN lines USING (channel, charge, frag_type, position_bin, residue_left, residue_right) WHERE frag_type = 'HCD')
SELECT spectrum_id, round(sum(low), 3) + 0.0 AS at_20, round(sum(high), 3) + 0.0 AS at_40, count(*) FILTER (abs(low - high) > 0.0001) > 0 AS differ
FROM scored GROUP BY spectrum_id""",
)
def energy_fragment_scores(t: Tables):
    """Every beam-type sample's peptide scored in batches at two energies."""
    samples = _energy_samples(t)
    table = materialise(energy.fit_energy(energy.energy_sums(energy.energy_context(samples))))
    model = energy.load_energy_model(table)
    features = samples.where("upper(frag_type) = 'HCD'").select(
        "spectrum_id", E.integer_codes("coded_seq").alias("codes"), E.charge_one_hot("precursor_z").alias("charge")
    )
    for name, value in (("low", 20.0), ("high", 40.0)):
        features = features.withColumn(name, models.score_fragments(model.make_model(), "codes", "charge", F.lit(value)))

    def total(name: str):
        return F.round(F.aggregate(name, F.lit(0.0), lambda a, v: a + v.cast("double")), 3) + 0.0

    differ = F.exists(F.zip_with("low", "high", lambda a, b: F.abs(a - b) > 0.0001), lambda d: d)
    return features.select("spectrum_id", total("low").alias("at_20"), total("high").alias("at_40"), differ.alias("differ"))


@query(
    "library_grown_by_stream",
    f"""WITH {Q.VARIANTS}, {Q.RESIDUES},
forms AS MATERIALIZED (SELECT PeptideSeq, PeptideModSeq,
  (length(PeptideModSeq) - length(replace(PeptideModSeq, '{Q.CAM_TEXT}', ''))) // {len(Q.CAM_TEXT)} AS n_cam,
  (length(PeptideModSeq) - length(replace(PeptideModSeq, '{Q.OX_TEXT}', ''))) // {len(Q.OX_TEXT)} AS n_ox FROM variants),
letters AS (SELECT PeptideSeq, unnest(string_split(PeptideSeq, '')) AS residue FROM (SELECT DISTINCT PeptideSeq FROM forms)),
base AS (SELECT PeptideSeq, CAST(sum(nano) AS BIGINT) AS nano FROM letters JOIN residue_mass USING (residue) GROUP BY 1),
owners AS (SELECT PeptideSeq, count(*) AS n_proteins FROM relation GROUP BY PeptideSeq)
SELECT PeptideModSeq, z AS PrecursorCharge, n_proteins,
  round({Q.mz("(nano + " + str(K.WATER_NANO) + " + n_cam * 57021464000 + n_ox * 15994915000)", "z")}, 6) AS PrecursorMz
FROM forms JOIN base USING (PeptideSeq) JOIN owners USING (PeptideSeq), (VALUES (2), (3), (4)) c(z) WHERE z = 4 OR n_ox = 0""",
)
def library_grown_by_stream(t: Tables):
    """A library of the English documents; FASTA files of all documents arrive as a stream, and then
    all are appended again with another charge and a variable modification."""
    proteins = t.proteins().select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("ProteinAccession"), "sequence", "lang"
    )
    base, incoming = scratch_path(t.spark, "grown"), scratch_path(t.spark, "incoming")
    english = build_library(proteins.where(F.col("lang") == "en"), plain_retention_model, plain_fragment_model)
    save_library(t.spark, english, base)
    proteins.select(F.concat(F.lit(">"), "ProteinAccession", F.lit("\n"), "sequence")).write.text(incoming)
    stream_library(
        t.spark, incoming, base, scratch_path(t.spark, "progress"), plain_retention_model, plain_fragment_model, create=False
    ).awaitTermination()
    append_library(
        t.spark, proteins, base, plain_retention_model, plain_fragment_model, charges=[4], variable={"M": K.MOD_MASSES["Ox"]}
    )
    relation = library.read_table(t.spark, base, "peptidetoprotein")
    owners = relation.groupBy("PeptideSeq").agg(F.count(F.lit(1)).alias("n_proteins"))
    entries = library.read_table(t.spark, base, "entries")
    return entries.join(owners, "PeptideSeq").select(
        "PeptideModSeq", "PrecursorCharge", "n_proteins", F.round("PrecursorMz", 6).alias("PrecursorMz")
    )


def broken_retention_model():
    """A user model that ends in an error."""
    raise RuntimeError("no model")


_VERSION_COUNTS = "count(*) AS n_relation, 2 * count(DISTINCT PeptideSeq) AS n_entries"


@query(
    "library_version_appends",
    f"""WITH {Q.DIGEST}, en AS (SELECT relation.* FROM relation JOIN documents USING (doc_id) WHERE lang = 'en')
SELECT 'english' AS step, {_VERSION_COUNTS} FROM en UNION ALL SELECT 'after a failure', {_VERSION_COUNTS} FROM en
UNION ALL SELECT 'all', {_VERSION_COUNTS} FROM relation UNION ALL SELECT 'english again', {_VERSION_COUNTS} FROM en
UNION ALL SELECT 'in one folder', {_VERSION_COUNTS} FROM relation""",
)
def library_version_appends(t: Tables):
    """Versions of a library: an append that fails between its tables shows nothing, and old versions stay readable."""
    spark, base = t.spark, scratch_path(t.spark, "versions")
    proteins = t.proteins().select("ProteinAccession", "sequence", "lang")
    versions.create_versions(spark, base)
    english = append_library_version(spark, proteins.where("lang = 'en'"), base, plain_retention_model, plain_fragment_model)
    try:
        append_library_version(spark, proteins, base, broken_retention_model, plain_fragment_model)
        raise AssertionError("the append did not fail")
    except PySparkException:
        failed = versions.latest(spark, base)
    whole = append_library_version(spark, proteins, base, plain_retention_model, plain_fragment_model)
    versions.compact(spark, base, "entries")
    steps = [("english", english), ("after a failure", failed), ("all", whole), ("english again", english.number), ("in one folder", None)]

    def count(table: str, version):
        return versions.read_version(spark, base, table, version).agg(F.count(F.lit(1)).alias("n")).scalar()

    rows = [
        spark.range(1).select(F.lit(step).alias("step"), count("peptidetoprotein", v).alias("n_relation"), count("entries", v).alias("n_entries"))
        for step, v in steps
    ]
    return union_frames(*rows)


_CHANGED = f"""{Q.PROTEINS.replace("proteins AS (", "first_texts AS (", 1)},
proteins AS (SELECT doc_id, lang, source, n_chars, CASE WHEN doc_id % 3 = 1 THEN reverse(sequence) WHEN doc_id % 13 = 5 THEN '' ELSE sequence END AS sequence
  FROM first_texts), {Q.fragments()}, {Q.RUNS}, {Q.RELATION}"""


@query(
    "library_of_changed_proteins",
    f"""WITH {_CHANGED}, owners AS (SELECT PeptideSeq, count(*) AS n_proteins FROM relation GROUP BY PeptideSeq)
SELECT replace(PeptideSeq, 'C', 'C{Q.CAM_TEXT}') AS PeptideModSeq, z AS PrecursorCharge, n_proteins FROM owners, (VALUES (2), (3)) c(z)""",
)
def library_of_changed_proteins(t: Tables):
    """Proteins of all documents arrive in a stream; then a third of them with another sequence, some without
    one, and some as they were. Entries are live while a protein still has their peptide."""
    spark = t.spark
    log, incoming, progress, base = (scratch_path(spark, name) for name in ("changes", "arriving", "progress", "followed"))
    library.create_library(spark, base)
    of = lambda n, i: F.col("doc_id") % n == i
    header = F.concat(F.lit(">doc"), F.col("doc_id").cast("string"), F.lit("\n"))
    later = F.when(of(3, 1), F.reverse("sequence")).when(of(13, 5), F.lit("")).otherwise(F.col("sequence"))
    proteins = t.proteins()
    arrivals = [
        proteins.select(F.concat(header, "sequence")),
        proteins.where(of(3, 1) | of(13, 5) | of(4, 2)).select(F.concat(header, later)),
    ]
    for arrival in arrivals:
        arrival.write.mode("append").text(incoming)
        stream_relation(spark, incoming, log, progress).awaitTermination()
        relation = current_relation(spark, log)
        if arrival is arrivals[-1]:
            relation = stored(relation, "relation")     # read again below
        score_relation(spark, base, relation, plain_retention_model, plain_fragment_model)
    owners = relation.groupBy("PeptideSeq").agg(F.count(F.lit(1)).alias("n_proteins"))
    live = live_entries(library.read_table(spark, base, "entries"), relation)
    return live.join(owners, "PeptideSeq").select("PeptideModSeq", "PrecursorCharge", "n_proteins")

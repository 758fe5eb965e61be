"""Nearest-peak matching, normalisation, spectrum filters, training samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ionloom import constants as K
from ionloom.functions import encoding as E, masses as S, spectra as P
from ionloom.operators.frames import last_per_key, new_rows
from ionloom.operators.matching import match_arrays, normalise_matches
from ionloom.plans.catalog import sql as Q
from ionloom.plans.catalog.digestion_queries import micro
from ionloom.plans.catalog.registry import query
from ionloom.plans.catalog.tables import Tables
from ionloom.plans.training_sets import matched_channels, rejection, samples_from_tables
from ionloom.session import materialise
from ionloom.sources.samples import usable_samples


def _match_sql(resolution: str) -> str:
    return f"""WITH {Q.matches(resolution)}
SELECT spectrum_id, ion_type, CAST(ordinal AS INTEGER) AS ordinal, frag_z, round(mz, 6) AS mz, intensity FROM matches"""


def _match(t: Tables, resolution: str):
    matches = matched_channels(t.spectra(), t.peaks(), ["spectrum_id"], resolution)
    return matches.select(
        "spectrum_id", "ion_type", "ordinal", "frag_z", F.round("mz", 6).alias("mz"), "intensity"
    )


@query("nearest_peak_match_high", _match_sql("high"))
def nearest_peak_match_high(t: Tables):
    return _match(t, "high")


@query("nearest_peak_match_low", _match_sql("low"))
def nearest_peak_match_low(t: Tables):
    return _match(t, "low")


@query(
    "matched_ion_normalisation",
    f"""WITH {Q.matches("low")}
SELECT spectrum_id, ion_type, CAST(ordinal AS INTEGER) AS ordinal, frag_z,
round(intensity / (max(intensity) OVER (PARTITION BY spectrum_id) + 1e-7::DOUBLE), 9) AS norm_intensity FROM matches""",
)
def matched_ion_normalisation(t: Tables):
    matches = matched_channels(t.spectra(), t.peaks(), ["spectrum_id"], "low")
    return normalise_matches(matches, ["spectrum_id"]).select(
        "spectrum_id", "ion_type", "ordinal", "frag_z", F.round("norm_intensity", 9).alias("norm_intensity")
    )



@query(
    "spectrum_rejection_reasons",
    f"""WITH {Q.matches("high")}, best AS (SELECT spectrum_id, max(intensity) AS top FROM matches GROUP BY spectrum_id),
labelled AS (SELECT CASE WHEN doc_id IS NULL THEN 'length' WHEN s_suppkey % 7 = 0 THEN 'modification'
  WHEN coalesce(top, 0) <= 0 THEN 'no ion' ELSE 'kept' END AS reason
  FROM supplier LEFT JOIN first_peptides ON doc_id = s_suppkey LEFT JOIN best ON spectrum_id = s_suppkey)
SELECT reason, count(*) AS n FROM labelled GROUP BY reason""",
)
def spectrum_rejection_reasons(t: Tables):
    """Counts of kept and rejected spectra; every seventh carries an unknown modification."""
    owners = t.table("supplier").select(F.col("s_suppkey").alias("spectrum_id"))
    spectra = t.spectra()
    tops = (
        matched_channels(spectra, t.peaks(), ["spectrum_id"], "high")
        .groupBy("spectrum_id")
        .agg(F.max("intensity").alias("top"))
    )
    unknown = F.when(F.col("spectrum_id") % 7 == 0, F.lit("K[+99.900000]")).otherwise(F.lit(""))
    coded = E.coded_sequence(F.concat("PeptideModSeq", unknown))
    rows = owners.join(spectra, "spectrum_id", "left").join(tops, "spectrum_id", "left")
    return rows.groupBy(rejection(F.col("PeptideSeq"), coded, F.col("top") > 0).alias("reason")).agg(
        F.count(F.lit(1)).alias("n")
    )


_SAMPLES_SQL = f"""{Q.matches("low")},
normed AS (SELECT spectrum_id, ion_type, ordinal, frag_z,
  CAST(intensity / (max(intensity) OVER (PARTITION BY spectrum_id) + 1e-7::DOUBLE) AS FLOAT) AS v,
  max(intensity) OVER (PARTITION BY spectrum_id) AS top FROM matches),
usable AS (SELECT spectrum_id, '-' || replace(PeptideSeq, 'C', 'c') || '_' AS coded_seq, PeptideModSeq, PrecursorCharge,
    RT, dataset, frag_type, nce, length(PeptideSeq) AS n FROM spectra
  WHERE spectrum_id IN (SELECT spectrum_id FROM normed WHERE top > 0)),
last_ones AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, frag_type, nce, coded_seq, PrecursorCharge
  ORDER BY spectrum_id DESC) AS place FROM usable) WHERE place = 1),
grid AS (SELECT l.*, channel, i FROM last_ones l, (SELECT unnest(range(0, 4)) AS channel), (SELECT unnest(range(1, 35)) AS i)),
filled AS (SELECT g.*, CASE WHEN i >= n THEN -1.0 ELSE coalesce(v, 0.0) END::FLOAT AS cell FROM grid g LEFT JOIN normed m
  ON m.spectrum_id = g.spectrum_id AND m.ordinal = g.i AND (m.frag_z - 1) * 2 + CASE m.ion_type WHEN 'b' THEN 0 ELSE 1 END = g.channel)"""


@query(
    "training_samples",
    f"""WITH {_SAMPLES_SQL}
SELECT spectrum_id, coded_seq, PeptideModSeq AS peptide_mod_seq, CAST(PrecursorCharge AS INTEGER) AS precursor_z, RT, dataset, frag_type, nce,
string_agg(CAST({Q.micro("cell::DOUBLE")} AS VARCHAR), ' ' ORDER BY channel, i) AS ions
FROM filled GROUP BY ALL""",
)
def training_samples(t: Tables):
    samples = samples_from_tables(t.spectra(), t.peaks(), "spectrum_id", "low")
    cells = F.transform(F.flatten("ion_array"), lambda v: micro(v.cast("double")).cast("string"))
    return samples.select(
        "spectrum_id",
        "coded_seq",
        "peptide_mod_seq",
        "precursor_z",
        "RT",
        "dataset",
        "frag_type",
        "nce",
        F.array_join(cells, " ").alias("ions"),
    )


@query(
    "usable_training_samples",
    f"""WITH {_SAMPLES_SQL}
SELECT spectrum_id, count(*) FILTER (cell >= 0.01::FLOAT) AS n_strong FROM filled
WHERE n <= 35 AND PrecursorCharge BETWEEN 1 AND 6 GROUP BY spectrum_id HAVING count(*) FILTER (cell >= 0.01::FLOAT) >= 3""",
)
def usable_training_samples(t: Tables):
    samples = samples_from_tables(t.spectra(), t.peaks(), "spectrum_id", "low")
    return usable_samples(samples).select(
        "spectrum_id", P.count_strong_ions("ion_array").cast("bigint").alias("n_strong")
    )


@query(
    "low_intensity_peak_filter",
    f"""WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding))) AS i FROM embeddings)
SELECT vec_id, count(*) FILTER (v >= 0.001 AND i > 0) AS n_kept,
CAST(sum(CASE WHEN v >= 0.001 AND i > 0 THEN {Q.micro("v")} ELSE 0 END) AS BIGINT) AS intensity_micro FROM c GROUP BY vec_id""",
)
def low_intensity_peak_filter(t: Tables):
    """Intensity at least 0.001 and an m/z (here the position; the first has none)."""
    peaks = F.transform(
        "embedding", lambda v, i: F.struct(i.cast("double").alias("mz"), v.cast("double").alias("intensity"))
    )
    kept = t.embeddings().select("vec_id", P.drop_low_peaks(peaks).alias("kept"))
    return kept.select(
        "vec_id",
        F.size("kept").cast("bigint").alias("n_kept"),
        F.aggregate("kept", F.lit(0).cast("bigint"), lambda a, p: a + micro(p["intensity"])).alias("intensity_micro"),
    )


@query(
    "base_peak_normalisation",
    f"""WITH c AS (SELECT vec_id, unnest(embedding) AS v FROM embeddings),
m AS (SELECT vec_id, v, max(v) OVER (PARTITION BY vec_id) AS top FROM c)
SELECT vec_id, count(*) AS n, CAST(sum(CASE WHEN top > 0 THEN
 {Q.micro("CAST(greatest(v, 0::FLOAT)::DOUBLE / top::DOUBLE AS FLOAT)::DOUBLE")} ELSE 0 END) AS BIGINT) AS total_micro FROM m GROUP BY vec_id""",
)
def base_peak_normalisation(t: Tables):
    flat = t.embeddings().select("vec_id", P.base_peak_normalise("embedding").alias("cells"))
    return flat.select(
        "vec_id",
        F.size("cells").cast("bigint").alias("n"),
        F.aggregate("cells", F.lit(0).cast("bigint"), lambda a, v: a + micro(v.cast("double"))).alias("total_micro"),
    )


@query(
    "last_spectrum_per_key",
    """SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity, l_comment_of FROM (
SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity, l_returnflag || l_linestatus AS l_comment_of,
  row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_quantity DESC, l_returnflag || l_linestatus DESC) AS place FROM lineitem) WHERE place = 1""",
)
def last_spectrum_per_key(t: Tables):
    """The whole row of the last record of each key."""
    items = t.table("lineitem").select(
        "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity",
        F.concat("l_returnflag", "l_linestatus").alias("l_comment_of"),
    )
    order = F.struct("l_orderkey", "l_linenumber", "l_quantity", "l_comment_of")
    return last_per_key(items, ["l_partkey", "l_suppkey"], order)


@query(
    "new_peptides_for_library",
    f"""WITH {Q.DIGEST}
SELECT DISTINCT PeptideSeq FROM relation JOIN documents USING (doc_id) WHERE lang <> 'en'
EXCEPT SELECT PeptideSeq FROM relation JOIN documents USING (doc_id) WHERE lang = 'en'""",
)
def new_peptides_for_library(t: Tables):
    """Anti join: peptides of the other languages that an English library does not hold."""
    from ionloom.functions.peptides import digest

    found = t.proteins().select("lang", F.explode(digest("sequence")).alias("PeptideSeq"))
    found = materialise(found.groupBy("PeptideSeq").agg(F.bool_or(F.col("lang") == "en").alias("en"), F.bool_or(F.col("lang") != "en").alias("other")))
    library, candidates = found.where("en").select("PeptideSeq"), found.where("other").select("PeptideSeq")
    return new_rows(candidates, library, ["PeptideSeq"])


_SELF_ENTRIES = f"""{Q.FIRST}, {Q.residue_rows("first_peptides", "doc_id")}, {Q.ladder("doc_id")},
cells AS (SELECT doc_id, n, pos, 'b' AS t, {Q.mz("b", "1")} AS mz FROM ladder WHERE pos < n
  UNION ALL SELECT doc_id, n, n - pos, 'y', {Q.mz("(total - b)", "1")} FROM ladder WHERE pos < n)"""


@query(
    "array_peak_match",
    f"""WITH {_SELF_ENTRIES}, pairs AS (
  SELECT a.doc_id, a.t, a.pos, b.pos AS found, row_number() OVER (PARTITION BY a.doc_id, a.t, a.pos ORDER BY abs(b.mz - a.mz), b.pos) AS place
  FROM cells a JOIN cells b ON a.doc_id = b.doc_id AND b.t = 'y' AND abs(b.mz - a.mz) <= 0.35::DOUBLE)
SELECT doc_id, t AS ion_type, count(*) AS n_matched, CAST(sum(found) AS BIGINT) AS intensity FROM pairs WHERE place = 1 GROUP BY ALL""",
)
def array_peak_match(t: Tables):
    """The in-row match: b and y ions against a spectrum that holds the y ions only."""
    ladder = t.first_peptides().select("doc_id", S.ladder_nano("PeptideModSeq").alias("ladder"))
    arrays = ladder.select(
        "doc_id",
        F.transform("ladder.b", lambda m: S.mz_from_nano(m, 1)).alias("b"),
        F.transform("ladder.y", lambda m: S.mz_from_nano(m, 1)).alias("y"),
    )
    heights = F.transform("y", lambda _, i: (i + 1).cast("double"))
    parts = []
    for ion in ("b", "y"):
        found = arrays.select("doc_id", match_arrays(F.col(ion), F.col("y"), heights, "low").alias("found"))
        parts.append(found.select("doc_id", F.lit(ion).alias("ion_type"), F.filter("found", lambda v: v > 0).alias("hits")))
    both = parts[0].unionByName(parts[1]).where(F.size("hits") > 0)
    return both.select(
        "doc_id",
        "ion_type",
        F.size("hits").cast("bigint").alias("n_matched"),
        F.aggregate("hits", F.lit(0.0), lambda a, v: a + v).cast("bigint").alias("intensity"),
    )

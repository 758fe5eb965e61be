"""Observed spectra to training samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ionloom import constants as K
from ionloom.functions import encoding as E, masses as S, spectra as P
from ionloom.operators.frames import keep_computed, last_per_key
from ionloom.operators.ladder import fragment_ions
from ionloom.operators.matching import match_arrays, match_ions
from ionloom.sources import blobs
from ionloom.sources.dlib import PATH, ROW, read_dlib
from ionloom.sources.samples import read_samples, write_samples

CHANNELS = {"b1": 0, "y1": 1, "b2": 2, "y2": 3}
SAMPLE_KEY = ["coded_seq", "precursor_z"]
NO_REASON = "kept"


def fragment_charge_cap(charge: Column | str) -> Column:
    """Matching uses at most charge 3."""
    charge = F.col(charge) if isinstance(charge, str) else charge
    return F.least(charge, F.lit(K.MAX_FRAGMENT_CHARGE))


def rejection(peptide: Column, coded: Column, matched: Column | None = None) -> Column:
    """Why a spectrum is left out, or ``kept``."""
    reason = F.when(
        ~F.coalesce(F.length(peptide).between(K.MIN_PEPTIDE_LEN, K.MAX_PEPTIDE_LEN), F.lit(False)),
        F.lit("length"),
    ).when(coded.isNull(), F.lit("modification"))
    if matched is not None:
        reason = reason.when(~F.coalesce(matched, F.lit(False)), F.lit("no ion"))
    return reason.otherwise(F.lit(NO_REASON))


def rows_from_flat(flat: Column, n_ions: Column) -> Column:
    """A channel-major flat array as four rows."""
    return F.array(*[F.slice(flat, n_ions * c + 1, n_ions) for c in range(K.N_CHANNELS)])


def samples_from_entries(
    entries: DataFrame, frag_type: str, nce: float, dataset: str, resolution: str = "high",
    order: Column | None = None, counts: tuple[Observation, Observation] | None = None,
) -> DataFrame:
    """Samples of library entries, where a spectrum is one row with two blobs or arrays.

    Unpacking, the ladder and the match all happen in the row; the only shuffle
    is the last one, which keeps the last sample per peptide and charge. "Last" goes by ``order``,
    else by the file and row of entries read with ``provenance``, else by the order of reading.
    ``counts`` observe, in the same pass, what is rejected before and after the match.
    """
    if order is None and PATH in entries.columns:
        order = F.struct(PATH, ROW)
    arrays = F.struct("mzs", "intensities") if "mzs" in entries.columns else blobs.unpack_arrays()
    spectra = entries.select(
        F.col("PeptideModSeq").alias("peptide_mod_seq"),
        F.col("PrecursorCharge").alias("precursor_z"),
        F.col("RTInSeconds").alias("RT"),
        F.col("PeptideSeq").alias("_seq"),
        E.coded_sequence("PeptideModSeq").alias("coded_seq"),
        arrays.alias("_spectrum"),
        (F.monotonically_increasing_id() if order is None else order).alias("_order"),
    )
    reason = rejection(F.col("_seq"), F.col("coded_seq"))
    if counts:
        spectra = spectra.observe(counts[0], *[F.count_if(reason == r).alias(r) for r in ("length", "modification")])
    spectra = spectra.where(reason == NO_REASON)
    cells = F.flatten(
        S.ladder_matrix(S.ladder_nano("peptide_mod_seq"), fragment_charge_cap("precursor_z"), 2)
    )
    # the generator keeps the ladder out of the arguments of the Python call
    matched = keep_computed(spectra, "_mz", cells).withColumn(
        "_found",
        match_arrays(F.col("_mz"), F.col("_spectrum.mzs"), F.col("_spectrum.intensities"), resolution),
    )
    n_ions = F.length("_seq") - 1
    rows = rows_from_flat(P.matched_normalise("_found"), n_ions)
    any_ion = F.exists("_found", lambda v: v > 0)
    if counts:
        matched = matched.observe(counts[1], F.count_if(~any_ion).alias("no ion"), F.count_if(any_ion).alias(NO_REASON))
    samples = matched.where(any_ion).select(
        "coded_seq",
        "peptide_mod_seq",
        "precursor_z",
        E.pad_ions(rows).alias("ion_array"),
        "RT",
        F.lit(dataset).alias("dataset"),
        F.lit(frag_type).alias("frag_type"),
        F.lit(float(nce)).alias("nce"),
        "_order",
    )
    return last_per_key(samples, SAMPLE_KEY, F.col("_order")).drop("_order")


def library_to_samples(
    spark: SparkSession, files: str, path: str, frag_type: str, nce: float, dataset: str, resolution: str = "high",
) -> tuple[DataFrame, dict[str, int]]:
    """Library files to a folder of training samples: the samples written, and how many entries were kept
    and rejected for what reason. The files are read once; the counts come with the write."""
    seen = Observation(), Observation()
    entries = read_dlib(spark, files, provenance=True)
    write_samples(samples_from_entries(entries, frag_type, nce, dataset, resolution, counts=seen), path)
    return read_samples(spark, path), {**seen[0].get, **seen[1].get}


def matched_channels(
    spectra: DataFrame, peaks: DataFrame, keys: Sequence[str], resolution: str = "high"
) -> DataFrame:
    """keys + (ion_type, ordinal, frag_z, mz, intensity) of the four training channels."""
    capped = spectra.withColumn("_z", fragment_charge_cap("PrecursorCharge"))
    ions = fragment_ions(capped, keys, max_fragment_z=2, charge="_z")
    return match_ions(ions, peaks, keys, ["ion_type", "ordinal", "frag_z"], resolution)


def samples_from_tables(
    spectra: DataFrame,
    peaks: DataFrame,
    key: str = "spectrum_id",
    resolution: str = "high",
) -> DataFrame:
    """Samples of spectra whose peaks are rows of their own table.

    spectra(key, PeptideSeq, PeptideModSeq, PrecursorCharge, RT, dataset,
    frag_type, nce); peaks(key, peak_index, mz, intensity). After the match a
    spectrum has at most 4 x 34 ions, which is all that is ever gathered.
    """
    coded = spectra.withColumn("coded_seq", E.coded_sequence("PeptideModSeq")).where(
        rejection(F.col("PeptideSeq"), F.col("coded_seq")) == NO_REASON
    )
    matches = matched_channels(coded, peaks, [key], resolution)
    channel = (F.col("frag_z") - 1) * 2 + F.when(F.col("ion_type") == "b", 0).otherwise(1)
    cell = channel * K.MAX_IONS + F.col("ordinal")
    gathered = matches.groupBy(key).agg(
        F.max("intensity").alias("_top"),
        F.map_from_entries(F.collect_list(F.struct(cell.alias("cell"), F.col("intensity")))).alias("_cells"),
    )
    n_ions = F.length("PeptideSeq") - 1

    def channel_row(c: int) -> Column:
        def value(i: Column) -> Column:
            found = F.coalesce(F.try_element_at("_cells", F.lit(c * K.MAX_IONS) + i), F.lit(0.0))
            norm = found / (F.col("_top") + F.lit(K.EPSILON))
            return F.when(i > n_ions, F.lit(-1.0)).otherwise(norm).cast("float")

        return F.transform(F.sequence(F.lit(1), F.lit(K.MAX_IONS)), value)

    rows = F.array(*[channel_row(c) for c in range(K.N_CHANNELS)])
    samples = (
        coded.join(gathered, key)
        .where(F.col("_top") > 0)
        .select(
            "coded_seq",
            F.col("PeptideModSeq").alias("peptide_mod_seq"),
            F.col("PrecursorCharge").alias("precursor_z"),
            rows.alias("ion_array"),
            "RT",
            "dataset",
            "frag_type",
            "nce",
            key,
        )
    )
    names = ["dataset", "frag_type", "nce", *SAMPLE_KEY]
    return last_per_key(samples, names, F.col(key))


def sample_features(samples: DataFrame) -> DataFrame:
    """Model inputs of samples: codes, charge, energy (0 unless beam), flag, target, weight."""
    beam = F.upper("frag_type") == "HCD"
    return samples.select(
        "coded_seq",
        "precursor_z",
        E.integer_codes("coded_seq").alias("codes"),
        E.charge_one_hot("precursor_z").alias("charge"),
        F.when(beam, F.col("nce")).otherwise(F.lit(0.0)).cast("float").alias("nce"),
        beam.alias("is_beam"),
        F.col("ion_array").alias("target"),
        F.lit(1.0).cast("float").alias("weight"),
    )


def retention_features(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Model inputs of retention-time rows; ``sources`` is one row with the sorted array."""
    names = sources.select("sources").scalar()
    return rows.select(
        "PeptideModSeq",
        E.integer_codes("CodedPeptideSeq").alias("codes"),
        F.col("HI").cast("float").alias("target"),
        E.category_one_hot("Source", names).alias("source"),
    )

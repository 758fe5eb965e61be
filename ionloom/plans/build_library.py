"""Proteins to a spectral library."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ionloom import constants as K
from ionloom.functions import masses as S
from ionloom.operators import assembly, digestion, modification
from ionloom.operators.frames import BROADCAST_BYTES, measured_bytes, new_keys
from ionloom.session import kept, materialise
from ionloom.sources import library, versions
from ionloom.sources.schemas import METADATA

DEFAULT_FIXED = {"C": K.MOD_MASSES["CAM"]}
ENTRY_KEY = ["PeptideModSeq", "PrecursorCharge"]


@dataclass(frozen=True)
class Library:
    """The three tables, and how entries are made of unique peptides."""

    metadata: DataFrame
    entries: DataFrame
    peptidetoprotein: DataFrame
    score: Callable[[DataFrame], DataFrame] | None = None


def precursors(
    peptides: DataFrame,
    fixed: Mapping[str, float] | None = None,
    variable: Mapping[str, float] | None = None,
    max_variable: int = 2,
    charges: Sequence[int] = (2, 3),
    nce: float | Sequence[float] = 30.0,
) -> DataFrame:
    """Modified, charged peptides with their m/z. The mass is computed before the charges."""
    modified = modification.apply_mods(
        peptides, DEFAULT_FIXED if fixed is None else fixed, variable, max_variable
    )
    massed = modified.withColumn("mass", S.peptide_mass("PeptideModSeq"))
    charged = modification.expand_charges(massed, charges, nce)
    return charged.withColumn("PrecursorMz", S.precursor_mz("mass", "PrecursorCharge"))


def score_entries(
    peptides: DataFrame,
    retention_model: Callable,
    fragment_model: Callable,
    fixed: Mapping[str, float] | None = None,
    variable: Mapping[str, float] | None = None,
    max_variable: int = 2,
    charges: Sequence[int] = (2, 3),
    nce: float | Sequence[float] = 30.0,
    beam: bool = True,
    batch_size: int = assembly.BATCH_SIZE,
    source: str = "ionloom",
    spectrum_as: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Library entries with a ``spectrum`` struct, from unique peptides.

    What does not depend on the charge (coding, mass, retention time) is computed
    before the charges are expanded. A peptide with a modification that has no
    code cannot be scored and is left out.
    """
    modified = modification.apply_mods(
        peptides, DEFAULT_FIXED if fixed is None else fixed, variable, max_variable
    )
    return score_forms(
        modified, retention_model, fragment_model, charges, nce, beam, batch_size, source, spectrum_as=spectrum_as
    )


def score_forms(
    modified: DataFrame,
    retention_model: Callable,
    fragment_model: Callable,
    charges: Sequence[int] = (2, 3),
    nce: float | Sequence[float] = 30.0,
    beam: bool = True,
    batch_size: int = assembly.BATCH_SIZE,
    source: str = "ionloom",
    wanted: str | None = None,
    spectrum_as: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Entries of modified peptides (PeptideSeq, PeptideModSeq) at the given charges.

    ``wanted`` names a column with the array of charges each form is scored at; other
    charges of that form are left out. ``spectrum_as`` is applied to each whole spectrum, in the
    same Python call if it is an Arrow function, and its value stands in the place of the spectrum.
    """
    kept = [] if wanted is None else [wanted]
    coded = modified.withColumn("_coded", assembly.coded_texts.asNondeterministic()("PeptideModSeq")).where("_coded IS NOT NULL")
    scored = coded.select(
        "PeptideSeq",
        "PeptideModSeq",
        "_coded",
        S.daltons(assembly.mass_nano("PeptideModSeq")).alias("_mass"),
        assembly.score_coded(retention_model, "_coded", batch_size).alias("RTInSeconds"),
        *kept,
    )
    charged = modification.expand_charges(scored, charges, nce)
    if wanted is not None:
        charged = charged.where(F.array_contains(wanted, F.col("PrecursorCharge")))
    spectrum = assembly.predicted_spectrum(
        fragment_model,
        "_coded",
        "PeptideModSeq",
        "PrecursorCharge",
        "nce" if beam else None,
        batch_size=batch_size,
    )
    return charged.select(
        S.precursor_mz("_mass", "PrecursorCharge").alias("PrecursorMz"),
        "PrecursorCharge",
        "PeptideModSeq",
        "PeptideSeq",
        "RTInSeconds",
        (spectrum if spectrum_as is None else spectrum_as(spectrum)).alias("spectrum"),
        F.lit(source).alias("SourceFile"),
    )


def entry_arrays(entries: DataFrame) -> DataFrame:
    """The two arrays of ``spectrum`` as columns of the entries table."""
    rest = [c for c in entries.columns if c != "spectrum"]
    return entries.select(*rest, F.col("spectrum.mzs").alias("mzs"), F.col("spectrum.intensities").alias("intensities"))


def build_library(
    proteins: DataFrame,
    retention_model: Callable,
    fragment_model: Callable,
    protease: str = "trypsin",
    missed_cleavages: int = 1,
    decoys: bool = False,
    **scoring,
) -> Library:
    """The three library tables, lazily. One shuffle: the distinct peptides."""
    relation = digestion.peptides_to_proteins(proteins, protease, missed_cleavages, decoys)

    def score(peptides: DataFrame) -> DataFrame:
        return entry_arrays(score_entries(peptides, retention_model, fragment_model, **scoring))

    metadata = proteins.sparkSession.createDataFrame([("version", K.LIBRARY_VERSION)], METADATA)
    return Library(metadata, score(digestion.unique_peptides(relation)), relation, score)


def save_library(spark: SparkSession, built: Library, base: str, overwrite: bool = True) -> None:
    library.create_library(spark, base, overwrite)
    library.append_table(built.peptidetoprotein, "peptidetoprotein", base)
    if built.score is None:
        library.append_table(built.entries, "entries", base)
        return
    # the proteins are digested once: the peptides come from the table just written
    relation = library.read_table(spark, base, "peptidetoprotein")
    library.append_table(built.score(digestion.unique_peptides(relation)), "entries", base)


def missing_entries(
    peptides: DataFrame, known_entries: DataFrame, retention_model: Callable, fragment_model: Callable,
    charges: Sequence[int] = (2, 3), fixed: Mapping[str, float] | None = None, variable: Mapping[str, float] | None = None,
    max_variable: int = 2, limit: int = BROADCAST_BYTES, **scoring,
) -> DataFrame:
    """Entries of peptides (which may repeat) that a library lacks. Modified forms and charges that it holds are not scored.

    Both sides meet once, as one row a form with the charges it has, and a form is scored once for all it lacks.
    The forms of a small batch (checked before repeated peptides are one) are broadcast to the library, which is
    then not shuffled.
    """
    def modified(peptides: DataFrame) -> DataFrame:
        found = modification.apply_mods(peptides, DEFAULT_FIXED if fixed is None else fixed, variable, max_variable)
        return found.select("PeptideSeq", "PeptideModSeq")

    forms = modified(peptides.select("PeptideSeq").distinct())
    asked = list(dict.fromkeys(int(z) for z in charges))
    known = known_entries.select(*ENTRY_KEY).where(F.col("PrecursorCharge").isin(asked))
    if measured_bytes(modified(peptides).select("PeptideModSeq")) <= limit:
        known = known.join(F.broadcast(materialise(forms.select("PeptideModSeq"))), "PeptideModSeq", "left_semi")
    held = [F.bool_or(F.col("PrecursorCharge") == z).alias(f"_has{i}") for i, z in enumerate(asked)]
    found = forms.join(known.groupBy("PeptideModSeq").agg(*held), "PeptideModSeq", "left")
    lacking = F.array_compact(F.array(*[F.when(~F.coalesce(f"_has{i}", F.lit(False)), F.lit(z)) for i, z in enumerate(asked)]))
    wanted = found.select("PeptideSeq", "PeptideModSeq", lacking.alias("_wanted")).where(F.size("_wanted") > 0)
    return entry_arrays(score_forms(wanted, retention_model, fragment_model, charges, wanted="_wanted", **scoring))


@contextmanager
def missing_rows(
    proteins: DataFrame, known_relation: DataFrame, known_entries: DataFrame, retention_model: Callable,
    fragment_model: Callable, protease: str = "trypsin", missed_cleavages: int = 1, decoys: bool = False, **options,
) -> Iterator[tuple[DataFrame, Callable[[], DataFrame]]]:
    """What a library lacks of the precursors of proteins: rows of the relation, and a function that gives
    the entries (see ``missing_entries``). Both can be read within the block only."""
    relation = digestion.peptides_to_proteins(proteins, protease, missed_cleavages, decoys)
    with kept(relation, "relation") as relation:    # read several times, but digested once

        def entries() -> DataFrame:
            return missing_entries(relation, known_entries, retention_model, fragment_model, **options)

        yield new_keys(relation, known_relation, ["PeptideSeq", "isDecoy", "ProteinAccession"]), entries


def append_library(spark: SparkSession, proteins: DataFrame, base: str, retention_model: Callable, fragment_model: Callable, **options) -> None:
    """Add the precursors of proteins; a modified form and charge the library holds is not scored again.

    Running it twice with the same proteins adds nothing, so a repeated batch
    after a failure is harmless. Other charges or modified forms of a known
    peptide are new precursors. For the options see ``missing_rows`` and ``missing_entries``.
    """
    known = [library.read_table(spark, base, t) for t in ("peptidetoprotein", "entries")]
    with missing_rows(proteins, *known, retention_model, fragment_model, **options) as (relation, entries):
        library.append_table(relation, "peptidetoprotein", base)
        library.append_table(entries(), "entries", base)


def append_library_version(
    spark: SparkSession, proteins: DataFrame, base: str, retention_model: Callable, fragment_model: Callable, **options
) -> versions.Version:
    """The same on a library of versions: relation and entries appear together."""
    before = versions.latest(spark, base)
    known = [versions.read_version(spark, base, t, before) for t in ("peptidetoprotein", "entries")]
    with missing_rows(proteins, *known, retention_model, fragment_model, **options) as (relation, entries):
        return versions.append_version(spark, base, {"peptidetoprotein": relation, "entries": entries})

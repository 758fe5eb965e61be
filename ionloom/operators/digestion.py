"""Proteins to peptides."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ionloom import constants as K
from ionloom.functions.peptides import decoy, digest


def peptides_to_proteins(
    proteins: DataFrame,
    protease: str = "trypsin",
    missed_cleavages: int = 1,
    decoys: bool = False,
    shortest: int = K.MIN_PEPTIDE_LEN,
    longest: int = K.MAX_PEPTIDE_LEN,
) -> DataFrame:
    """(PeptideSeq, isDecoy, ProteinAccession), distinct within each protein.

    One narrow step: duplicates of a protein are removed in its own row, and a
    decoy is produced next to its target, so the digest runs once.
    """
    found = proteins.select(
        "ProteinAccession",
        F.explode(digest("sequence", protease, missed_cleavages, shortest, longest)).alias("p"),
    )
    if not decoys:
        return found.select(
            F.col("p").alias("PeptideSeq"), F.lit(False).alias("isDecoy"), "ProteinAccession"
        )
    both = F.array(
        F.struct(F.col("p").alias("PeptideSeq"), F.lit(False).alias("isDecoy")),
        F.struct(decoy("p").alias("PeptideSeq"), F.lit(True).alias("isDecoy")),
    )
    return found.select(F.inline(both), "ProteinAccession")


def unique_peptides(relation: DataFrame) -> DataFrame:
    """Distinct peptide texts; equal targets and decoys become one row.

    The partial aggregate collapses a peptide shared by many proteins before the
    shuffle.
    """
    return relation.select("PeptideSeq").distinct()


def sorted_peptides(relation: DataFrame) -> DataFrame:
    return unique_peptides(relation).orderBy("PeptideSeq")

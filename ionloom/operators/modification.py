"""Peptides to modified forms, and forms to precursors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ionloom import constants as K
from ionloom.functions import mods as M


def choose_sites(
    peptides: DataFrame, variable: Mapping[str, float], max_sites: int, column: str = "sites"
) -> DataFrame:
    """One row per combination of at most ``max_sites`` variable sites (none included).

    Each round either stops or takes one later site, so the rows stream through
    ``max_sites`` generators and no row ever holds all combinations.
    """
    empty = F.array().cast(M.SITES_TYPE)
    out = peptides.withColumn(column, empty)
    if not variable or max_sites < 1:
        return out
    out = out.withColumn("_open", M.mod_sites("PeptideSeq", variable))
    if max_sites > K.MAX_PEPTIDE_LEN:   # no more rounds than the rows have sites
        most = peptides.agg(F.max(F.size(M.mod_sites("PeptideSeq", variable)))).first()[0]
        max_sites = min(max_sites, most or 0)
    for _ in range(max_sites):
        stop = F.array(F.lit(-1))
        taken = F.col("_taken")
        options = F.concat(
            stop,
            F.when(
                F.size("_open") > 0, F.sequence(F.lit(0), F.size("_open") - 1)
            ).otherwise(F.array().cast("array<int>")),
        )
        out = out.withColumn("_taken", F.explode(options))
        out = out.withColumn(
            column,
            F.when(taken < 0, F.col(column)).otherwise(
                F.array_append(F.col(column), F.try_element_at("_open", taken + 1))
            ),
        ).withColumn(
            "_open",
            F.when(taken < 0, empty).otherwise(
                F.slice("_open", taken + 2, F.greatest(F.size("_open"), F.lit(1)))
            ),
        )
    return out.drop("_open", "_taken")


def apply_mods(
    peptides: DataFrame,
    fixed: Mapping[str, float],
    variable: Mapping[str, float] | None = None,
    max_variable: int = 2,
) -> DataFrame:
    """Add ``PeptideModSeq``: every fixed site, and all choices of variable sites.

    A chosen variable site replaces a fixed modification of the same residue.
    """
    if not variable or max_variable < 1:
        return peptides.withColumn("PeptideModSeq", M.write_fixed("PeptideSeq", fixed))
    chosen = choose_sites(peptides, variable, max_variable, "_sites")
    return chosen.withColumn(
        "PeptideModSeq", M.write_fixed(M.write_sites("PeptideSeq", F.col("_sites")), fixed)
    ).drop("_sites")


def expand_charges(
    peptides: DataFrame, charges: Sequence[int] = (2, 3), nce: float | Sequence[float] = 30.0
) -> DataFrame:
    """One row per precursor charge, with its collision energy."""
    energies = [nce] * len(charges) if isinstance(nce, (int, float)) else list(nce)
    if len(energies) != len(charges):
        raise ValueError("as many collision energies as precursor charges are needed")
    pairs = F.array(
        *[
            F.struct(F.lit(int(z)).alias("PrecursorCharge"), F.lit(float(e)).alias("nce"))
            for z, e in zip(charges, energies)
        ]
    )
    return peptides.select("*", F.inline(pairs))

"""Theoretical fragment ions as rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Window, functions as F

from ionloom import constants as K
from ionloom.functions import masses as S
from ionloom.operators import assembly
from ionloom.operators.assembly import ladder_arrays


def fragment_ions(
    peptides: DataFrame,
    keys: Sequence[str],
    max_fragment_z: int = K.MAX_FRAGMENT_CHARGE,
    phos_loss: bool = False,
    modseq: str = "PeptideModSeq",
    charge: str = "PrecursorCharge",
) -> DataFrame:
    """keys + (ion_type, ordinal, frag_z, mz) for every possible ion.

    Masses are computed once per peptide, in Arrow batches (cell by cell they took
    several times as long); charges are expanded afterwards. No shuffle. A peptide
    with a residue without a mass has no ions.
    """
    def rows(ladder: Column, name: str, shift: int = 0, keep: Column | None = None) -> Column:
        series = ladder[name[0]]
        out = F.transform(
            series,
            lambda m, i: F.struct(
                F.lit(name).alias("ion_type"),
                (i + 1).cast("int").alias("ordinal"),
                (m - F.lit(shift)).alias("nano"),
            ),
        )
        if keep is None:
            return out
        return F.filter(out, lambda s: s["ordinal"] >= keep[name[0]])

    def ions(ladder: Column) -> Column:
        parts = [rows(ladder, "b"), rows(ladder, "y")]
        if phos_loss:
            flags = F.col("_flags")
            parts += [
                rows(ladder, "b-PO4", K.PHOSPHO_NANO, flags),
                rows(ladder, "y-PO4", K.PHOSPHO_NANO, flags),
            ]
        return F.concat(*parts)

    base = peptides.select(
        *keys,
        F.least(F.col(charge), F.lit(max_fragment_z)).alias("_max_z"),
        F.col(modseq).alias("_modseq"),
    )
    if phos_loss:
        base = base.withColumn("_flags", S.phospho_ions("_modseq"))
    laddered = base.where(F.col("_max_z") >= 1).withColumn("_ladder", ladder_arrays("_modseq"))
    exploded = laddered.select(*keys, "_max_z", F.inline(ions(F.col("_ladder"))))
    return exploded.select(
        *keys,
        "ion_type",
        "ordinal",
        F.col("nano"),
        F.explode(F.sequence(F.lit(1), F.col("_max_z"))).alias("frag_z"),
    ).select(*keys, "ion_type", "ordinal", "frag_z", S.mz_from_nano(F.col("nano"), F.col("frag_z")).alias("mz"))


def ion_totals(
    peptides: DataFrame,
    max_fragment_z: int = K.MAX_FRAGMENT_CHARGE,
    phos_loss: bool = False,
    modseq: str = "PeptideModSeq",
    charge: str = "PrecursorCharge",
) -> DataFrame:
    """(ion_type, ordinal, frag_z, n, mz_micro): the ions of ``fragment_ions`` counted, and their m/z summed in whole millionths.

    Ions are made and summed per Arrow batch of peptides, so what is grouped is one row
    per batch, type, ordinal and charge, not one per ion.
    """
    rows = peptides.select(F.col(modseq), F.least(F.col(charge), F.lit(max_fragment_z)).cast("int"))
    partial_sums = rows.mapInArrow(
        partial(assembly.ion_totals, max_fragment_z=max_fragment_z, losses=phos_loss), assembly.ION_TOTALS
    )
    return partial_sums.groupBy("ion_type", "ordinal", "frag_z").agg(F.sum("n").alias("n"), F.sum("mz_micro").alias("mz_micro"))


def residue_table(spark) -> DataFrame:
    """The 37 residue masses as a table (a fixed size, safe to broadcast)."""
    rows = [(symbol, mass) for symbol, mass in K.RESIDUE_NANO.items()]
    return spark.createDataFrame(rows, "residue string, mass_nano bigint")


def residue_rows(peptides: DataFrame, keys: Sequence[str], modseq: str = "PeptideModSeq") -> DataFrame:
    """keys + (position, residue, mass_nano): the residue masses joined from their table.

    They are joined by character code, because a broadcast table is looked up much faster by a number.
    """
    tokens = peptides.select(
        *keys, F.posexplode(S.residue_tokens(modseq)).alias("position", "token")
    ).withColumn("_code", F.ascii("token").cast("bigint"))
    table = F.broadcast(residue_table(peptides.sparkSession).select(F.ascii("residue").cast("bigint").alias("_code"), "mass_nano"))
    return tokens.join(table, "_code", "left").select(
        *keys,
        "position",
        F.left("token", F.lit(1)).alias("residue"),
        (F.coalesce("mass_nano", F.lit(0)) + S._token_delta(F.col("token"))).alias("mass_nano"),
        S._is_phospho(F.col("token")).alias("is_phospho"),
    )


def running_masses(residues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long form of the ladder: running sum and running 'site seen' flag per peptide.

    A window's group is one peptide of at most 36 rows.
    """
    frame = Window.partitionBy(*keys).orderBy("position").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return residues.withColumn("running_nano", F.sum("mass_nano").over(frame)).withColumn(
        "site_seen", F.max("is_phospho").over(frame)
    )

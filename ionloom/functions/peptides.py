"""Peptide predicates, digestion and decoys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ionloom import constants as K
from ionloom.functions.expr import col, let


def has_peptide_length(
    peptide: Column | str,
    shortest: int = K.MIN_PEPTIDE_LEN,
    longest: int = K.MAX_PEPTIDE_LEN,
) -> Column:
    return F.length(col(peptide)).between(shortest, longest)


def is_canonical(peptide: Column | str) -> Column:
    """Only the twenty standard residues."""
    return col(peptide).rlike(f"^[{K.CANONICAL}]+$")


def protein_from_text(text: Column | str) -> Column:
    """Any text as a pseudo-protein: ASCII letters first, then the twenty residues."""
    letters = F.regexp_replace(col(text), "[^A-Za-z]", "")
    return F.regexp_replace(F.upper(letters), f"[^{K.CANONICAL}]", "")


def cleave(sequence: Column | str, protease: str = "trypsin") -> Column:
    """Fragments of a sequence cut at every site of the protease."""
    return F.split(F.upper(col(sequence)), K.protease_pattern(protease))


def join_adjacent(fragments: Column, missed_cleavages: int) -> Column:
    """All runs of one to ``missed_cleavages + 1`` neighbouring fragments."""
    if missed_cleavages < 0:
        raise ValueError("missed_cleavages must not be negative")
    runs, levels = fragments, [fragments]
    for step in range(1, missed_cleavages + 1):
        later = F.slice(fragments, step + 1, F.greatest(F.size(fragments), F.lit(1)))
        # a run that leaves the sequence is NULL and falls out of the length filter
        runs = F.zip_with(runs, later, lambda left, right: F.concat(left, right))
        levels.append(runs)
    return F.concat(*levels) if len(levels) > 1 else fragments


def digest(
    sequence: Column | str,
    protease: str = "trypsin",
    missed_cleavages: int = 1,
    shortest: int = K.MIN_PEPTIDE_LEN,
    longest: int = K.MAX_PEPTIDE_LEN,
) -> Column:
    """Distinct valid peptides of one sequence, as an array.

    The filters run inside the array, before anything is exploded, because
    Catalyst does not push a predicate below a generator.
    """
    # fragments of a canonical sequence are canonical, so they are looked at one by one only in others
    whole = F.struct(cleave(sequence, protease).alias("fragments"), is_canonical(F.upper(col(sequence))).alias("canonical"))
    return let(
        whole,
        lambda s: F.array_distinct(
            F.filter(
                join_adjacent(s["fragments"], missed_cleavages),
                lambda p: has_peptide_length(p, shortest, longest) & (s["canonical"] | is_canonical(p)),
            )
        ),
    )


def decoy(peptide: Column | str) -> Column:
    """The interior reversed, first and last residue kept."""
    p = col(peptide)
    inner = F.substr(p, F.lit(2), F.length(p) - 2)
    return F.when(F.length(p) < 2, p).otherwise(
        F.concat(F.left(p, F.lit(1)), F.reverse(inner), F.right(p, F.lit(1)))
    )

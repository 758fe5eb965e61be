"""Peptide masses, fragment ladders and m/z.

Sums are taken over whole nano-daltons and divided once, so every engine and
every partitioning gives the same double.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ionloom import constants as K
from ionloom.functions.expr import chars, col, let, symbol_lookup

LONG_ARRAY = "array<bigint>"
PHOSPHO_WINDOW_NANO = K.nano(0.001)
PHOSPHO_SYMBOLS = "sty"
TOKEN_NANO = {**K.RESIDUE_NANO, "[": 0}  # a token that starts with a bracket has no residue


def residue_nano(symbol: Column) -> Column:
    return symbol_lookup(symbol, K.RESIDUE_NANO, "bigint")


def delta_nano(delta: Column) -> Column:
    return F.round(delta * K.NANO).cast("bigint")


def residue_tokens(modseq: Column | str) -> Column:
    """``C[+57.021464]``-like tokens, one per residue; an N-terminal mod stands alone."""
    text = col(modseq)
    return F.when(F.instr(text, "[") == 0, chars(text)).otherwise(F.split(text, "(?=[A-Za-z])"))


def _token_delta(token: Column) -> Column:
    closed = F.substring_index(F.substring_index(token, "[", -1), "]", 1)
    return F.when(F.endswith(token, F.lit("]")), delta_nano(closed.cast("double"))).otherwise(
        F.lit(0).cast("bigint")
    )


def _token_nano(token: Column) -> Column:
    mass = symbol_lookup(token, TOKEN_NANO, "bigint")
    return F.when(F.length(token) == 1, mass).otherwise(mass + _token_delta(token))


def _is_phospho(token: Column) -> Column:
    near = F.abs(_token_delta(token) - K.PHOSPHO_NANO) < PHOSPHO_WINDOW_NANO
    return near | F.left(token, F.lit(1)).isin(*PHOSPHO_SYMBOLS)


def peptide_mass_nano(modseq: Column | str) -> Column:
    """Water, residues and modification deltas (the N-terminal one too)."""
    return F.aggregate(
        residue_tokens(modseq),
        F.lit(K.WATER_NANO).cast("bigint"),
        lambda total, token: total + _token_nano(token),
    )


def sequence_mass_nano(peptide: Column | str) -> Column:
    """Mass of an unmodified sequence (no bracket parsing)."""
    return F.aggregate(
        chars(col(peptide)),
        F.lit(K.WATER_NANO).cast("bigint"),
        lambda total, c: total + residue_nano(c),
    )


def daltons(nano: Column) -> Column:
    return nano.cast("double") / F.lit(float(K.NANO))


def peptide_mass(modseq: Column | str) -> Column:
    return daltons(peptide_mass_nano(modseq))


def mz_from_nano(nano: Column, charge: Column | int) -> Column:
    z = charge if isinstance(charge, Column) else F.lit(charge)
    return (daltons(nano) + z * F.lit(K.PROTON_MASS)) / z


def precursor_mz(mass: Column | str, charge: Column | str) -> Column:
    z = col(charge)
    return (col(mass) + z * F.lit(K.PROTON_MASS)) / z


def running_sums(values: Column, value_of=lambda x: x) -> Column:
    """Prefix sums of a short array (a peptide has at most 35 residues)."""
    return F.aggregate(
        values,
        F.array().cast(LONG_ARRAY),
        lambda done, x: F.array_append(
            done,
            value_of(x) + F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0).cast("bigint")),
        ),
    )


def ladder_nano(modseq: Column | str) -> Column:
    """struct(b, y): neutral fragment masses of the prefixes and suffixes 1..n-1."""
    text = col(modseq)
    # an N-terminal mod is a token of its own: it adds to every b ion but is no ion
    first = F.when(F.startswith(text, F.lit("[")), F.lit(2)).otherwise(F.lit(1))

    def series(sums: Column) -> Column:
        n_ions = F.greatest(F.size(sums) - first, F.lit(0))
        return let(
            F.slice(sums, first, n_ions),
            lambda b: F.struct(
                b.alias("b"),
                F.transform(
                    F.reverse(b),
                    lambda m: F.element_at(sums, -1) + F.lit(K.WATER_NANO) - m,
                ).alias("y"),
            ),
        )

    return let(running_sums(residue_tokens(text), _token_nano), series)


def phospho_ions(modseq: Column | str) -> Column:
    """struct(b, y): the first ordinal whose prefix / suffix holds a phosphosite, or NULL.

    Every longer ion of the series holds the site too.
    """

    def first_ordinals(flags: Column) -> Column:
        first = lambda series: F.nullif(F.array_position(series, F.lit(True)), F.lit(0))
        return F.struct(first(flags).alias("b"), first(F.reverse(flags)).alias("y"))

    residues = F.filter(residue_tokens(modseq), lambda t: ~F.startswith(t, F.lit("[")))
    return let(F.transform(residues, _is_phospho), first_ordinals)


def ladder_matrix(
    ladder: Column | str,
    charge: Column | str,
    max_fragment_z: int = 2,
    phospho: Column | None = None,
) -> Column:
    """Ion m/z rows, charge-major and type-minor (b1, y1, b2, y2, ...).

    Cells of a charge above the precursor's are 0. With ``phospho`` (see
    ``phospho_ions``) the two neutral-loss rows follow b and y of each charge.
    """
    if phospho is None:
        phospho = F.lit(None).cast("struct<b:bigint,y:bigint>")
        losses = ()
    else:
        losses = ("b", "y")

    def cells(both: Column) -> Column:
        rows = []
        for z in range(1, max_fragment_z + 1):
            # without a possible charge there is nothing to compute per cell
            possible = F.lit(z) <= both["charge"]
            for ion in ("b", "y"):
                masses = both["ladder"][ion]
                rows.append(
                    F.when(possible, F.transform(masses, lambda m: mz_from_nano(m, z))).otherwise(
                        F.array_repeat(F.lit(0.0), F.size(masses))
                    )
                )
            for ion in losses:
                start = F.coalesce(both["phospho"][ion], F.lit(K.MAX_PEPTIDE_LEN))
                rows.append(
                    F.transform(
                        both["ladder"][ion],
                        lambda m, i: F.when(
                            possible & (i + 1 >= start), mz_from_nano(m - F.lit(K.PHOSPHO_NANO), z)
                        ).otherwise(F.lit(0.0)),
                    )
                )
        return F.array(*rows)

    bound = F.struct(
        col(ladder).alias("ladder"), col(charge).alias("charge"), phospho.alias("phospho")
    )
    return let(bound, cells)


def tolerance(mz: Column | str, resolution: str = "high") -> Column:
    if resolution not in K.MASS_TOLERANCES:
        raise ValueError(f"resolution must be one of {sorted(K.MASS_TOLERANCES)}")
    width = F.lit(K.MASS_TOLERANCES[resolution])
    return width * col(mz) if resolution == "high" else width

"""Coded sequences and the fixed-size arrays that scoring models take."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ionloom import constants as K
from ionloom.functions.expr import chars, col, let, literal_array, symbol_lookup


def rename_mods(modseq: Column | str) -> Column:
    """Replace each known modified residue by its one-letter symbol.

    The rules are folded over the text in order. A plain substring test comes
    before each pattern, so a rule that cannot apply costs no regex scan.
    """
    rules = F.array(
        *[
            F.struct(
                F.lit(f"{residue}[{prefix}").alias("opening"),
                F.lit(K.coded_mod_pattern(residue, prefix)).alias("pattern"),
                F.lit(symbol).alias("symbol"),
            )
            for residue, prefix, symbol in K.CODED_MODS
        ]
    )
    text = col(modseq)
    coded = F.aggregate(
        rules,
        text,
        lambda done, rule: F.when(
            F.contains(done, rule["opening"]),
            F.regexp_replace(done, rule["pattern"], rule["symbol"]),
        ).otherwise(done),
    )
    return F.when(F.instr(text, "[") == 0, text).otherwise(coded)


def coded_sequence(modseq: Column | str, terminals: bool = True) -> Column:
    """One symbol per residue plus terminal tokens; NULL if a modification is unknown."""
    if not terminals:
        return rename_mods(modseq)

    def with_tokens(text: Column) -> Column:
        first = F.left(text, F.lit(1))
        token = F.lit(None).cast("string")
        for prefix, symbol in K.NTERM_TOKENS.items():
            token = F.when(F.startswith(text, F.lit(f"[{prefix}")), F.lit(symbol)).otherwise(token)
        rest = F.substr(text, F.instr(text, "]") + 1)
        started = F.when(first == "[", F.concat(token, rest))
        for residue, symbol in K.NTERM_RESIDUE_TOKENS.items():
            started = started.when(first == residue, F.concat(F.lit(symbol), text))
        return F.concat(started.otherwise(F.concat(F.lit("-"), text)), F.lit("_"))

    return let(
        let(rename_mods(modseq), with_tokens),
        lambda whole: F.when(F.instr(whole, "[") == 0, whole),
    )


def integer_codes(coded: Column | str, size: int = K.MAX_CODED_LEN) -> Column:
    """Symbols as 1..44, padded on the right with 0."""
    symbols = chars(col(coded))
    codes = F.transform(symbols, lambda c: symbol_lookup(c, K.SYMBOL_CODES, "int"))
    padding = F.array_repeat(F.lit(0), F.greatest(F.lit(size) - F.size(symbols), F.lit(0)))
    return F.concat(codes, padding)


def charge_one_hot(charge: Column | str) -> Column:
    charges = range(K.MIN_PRECURSOR_CHARGE, K.MAX_PRECURSOR_CHARGE + 1)
    return F.transform(
        literal_array(list(charges), "int"), lambda z: (z == col(charge)).cast("float")
    )


def category_one_hot(value: Column | str, categories: Column) -> Column:
    """One position per entry of the sorted category array; all 0 for an unknown value."""
    place = F.array_position(categories, col(value)).cast("int")
    width = F.size(categories)
    zero, one = F.lit(0.0).cast("float"), F.array(F.lit(1.0).cast("float"))
    return F.when(place > 0, F.concat(F.array_repeat(zero, place - 1), one, F.array_repeat(zero, width - place))).otherwise(
        F.array_repeat(zero, width)
    )


def pad_ions(rows: Column | str, size: int = K.MAX_IONS) -> Column:
    """Each ion row padded with -1 (an ion the peptide cannot have)."""
    return F.transform(
        col(rows),
        lambda r: F.concat(
            r.cast("array<float>"),
            F.array_repeat(F.lit(-1.0).cast("float"), F.greatest(F.lit(size) - F.size(r), F.lit(0))),
        ),
    )


def trim_ions(rows: Column | str, peptide: Column | str) -> Column:
    """Keep the ions that the peptide has: the first length - 1 of each row."""
    keep = F.greatest(F.length(col(peptide)) - 1, F.lit(0))
    return F.transform(col(rows), lambda r: F.slice(r, F.lit(1), keep))

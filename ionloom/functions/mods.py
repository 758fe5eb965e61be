"""Modification strings: writing, stripping, parsing and labelling."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from ionloom import constants as K
from ionloom.functions.expr import chars, col, let

SITE_TYPE = "struct<site:int,delta:double>"
SITES_TYPE = f"array<{SITE_TYPE}>"


def delta_text(delta: Column) -> Column:
    return F.format_string("[%+f]", delta)


def check_mods(mods: Mapping[str, float]) -> None:
    for residue in mods:
        if residue not in K.RESIDUE_MASSES:
            raise ValueError(f"modification of an unknown residue {residue!r}")


def mod_sites(peptide: Column | str, mods: Mapping[str, float]) -> Column:
    """Every residue named in ``mods`` as (site, delta), sites counted from 1."""
    check_mods(mods)
    if not mods:
        return F.array().cast(SITES_TYPE)
    table = F.create_map(*[F.lit(x) for pair in mods.items() for x in pair])
    sites = F.transform(
        chars(col(peptide)),
        lambda c, i: F.struct(
            (i + 1).cast("int").alias("site"), F.try_element_at(table, c).alias("delta")
        ),
    )
    found = F.filter(sites, lambda s: s["delta"].isNotNull()).cast(SITES_TYPE)
    # a sequence without such a residue is not taken apart
    absent = F.lit(True)
    for residue in mods:
        absent = absent & ~F.contains(col(peptide), F.lit(residue))
    return F.when(absent, F.array().cast(SITES_TYPE)).otherwise(found)


def write_sites(peptide: Column | str, sites: Column) -> Column:
    """Insert ``[+d.dddddd]`` after each site (0 is the N-terminus).

    Sites are taken from last to first, so earlier positions stay valid; the
    work grows with the number of modifications, not with the peptide.
    """
    last_first = F.reverse(F.array_sort(sites))
    written = F.aggregate(
        last_first,
        col(peptide),
        lambda text, s: F.concat(
            F.left(text, s["site"]),
            delta_text(s["delta"]),
            F.substr(text, s["site"] + 1),
        ),
    )
    return F.when(F.size(sites) == 0, col(peptide)).otherwise(written)


def write_fixed(modseq: Column | str, fixed: Mapping[str, float]) -> Column:
    """Modify every occurrence of a residue that carries no modification yet."""
    check_mods(fixed)
    text = col(modseq)
    for residue, delta in fixed.items():
        text = F.regexp_replace(text, rf"{residue}(?!\[)", f"{residue}[{delta:+f}]")
    return text


def strip_mods(modseq: Column | str) -> Column:
    return F.regexp_replace(col(modseq), r"\[.+?\]", "")


def parse_mods(modseq: Column | str) -> Column:
    """(site, delta) of each modification; the last one at a site wins."""
    opened = F.split(col(modseq), r"\[")  # text before the first mod, then one item per mod

    def sites(parts: Column) -> Column:
        # each later part is 'delta]residues': the residues add to the next site
        lengths = F.transform(parts, lambda p: F.length(p) - F.instr(p, "]"))
        return let(
            lengths,
            lambda n: F.transform(
                F.sequence(F.lit(1), F.size(parts) - 1),
                lambda i: F.struct(
                    F.aggregate(F.slice(n, 1, i), F.lit(0), lambda a, x: a + x).alias("site"),
                    F.substring_index(F.element_at(parts, i + 1), "]", 1)
                    .cast("double")
                    .alias("delta"),
                ),
            ),
        )

    def last_per_site(found: Column) -> Column:
        return F.filter(
            found,
            lambda s, i: F.coalesce(
                F.try_element_at(found, i + 2)["site"] != s["site"], F.lit(True)
            ),
        )

    none = F.array().cast(SITES_TYPE)
    return (
        F.when(F.instr(col(modseq), "[") == 0, none)
        .otherwise(let(opened, lambda parts: let(sites(parts), last_per_site)))
        .cast(SITES_TYPE)
    )


def mod_label(
    peptide: Column | str,
    sites: Column,
    start_site: Column | int,
    end_site: Column | int,
    offset: Column | int = 0,
) -> Column:
    """Text such as ``7C+57 9M+15`` for the modifications inside a site range."""
    start_site, end_site, offset = (
        x if isinstance(x, Column) else F.lit(x) for x in (start_site, end_site, offset)
    )
    inside = F.filter(sites, lambda s: s["site"].between(start_site, end_site))
    return F.array_join(
        F.transform(
            inside,
            lambda s: F.concat(
                (s["site"] - offset).cast("string"),
                F.substr(col(peptide), s["site"] - offset, F.lit(1)),
                F.format_string("%+d", s["delta"].cast("int")),
            ),
        ),
        " ",
    )

"""Filters, digestion, decoys, modifications."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ionloom import constants as K
from ionloom.functions import masses as S, mods as M, peptides as P
from ionloom.functions.expr import let
from ionloom.operators import digestion, modification
from ionloom.operators.cleavage import digest_totals
from ionloom.operators.frames import keep_computed, union_frames
from ionloom.plans.build_library import precursors
from ionloom.plans.catalog import sql as Q
from ionloom.plans.catalog.registry import query
from ionloom.plans.catalog.tables import CAM, OXIDATION, Tables
from ionloom.plans.training_sets import fragment_charge_cap

ORACLE_RULES = ["trypsin", "lysc", "arg-c", "glutamyl endopeptidase", "asp-n", "chymotrypsin high specificity", "cnbr"]


def some(array):
    """NULL for an empty array."""
    return let(array, lambda a: F.when(F.size(a) > 0, a))


def micro(x):
    return F.floor(x * F.lit(1e6) + F.lit(0.5)).cast("bigint")


@query(
    "library_precursors",
    f"""WITH {Q.MODIFIED}, {Q.residue_rows("modified", "PeptideSeq, PeptideModSeq")},
mass AS (SELECT PeptideModSeq, CAST(sum(nano) AS BIGINT) + {K.WATER_NANO} AS nano FROM residues GROUP BY ALL)
SELECT PeptideModSeq, z AS PrecursorCharge, round(nano / 1e9, 9) AS mass, round({Q.mz("nano", "z")}, 6) AS PrecursorMz
FROM mass, (VALUES (2), (3)) c(z)""",
)
def library_precursors(t: Tables):
    """Flagship: text to peptides to modified, charged precursors with their m/z."""
    return precursors(t.peptides(), CAM).select(
        "PeptideModSeq",
        "PrecursorCharge",
        F.round("mass", 9).alias("mass"),
        F.round("PrecursorMz", 6).alias("PrecursorMz"),
    )


@query(
    "missed_cleavage_digest",
    f"WITH {Q.DIGEST} SELECT doc_id, PeptideSeq FROM relation",
)
def missed_cleavage_digest(t: Tables):
    return t.proteins().select("doc_id", F.explode(P.digest("sequence")).alias("PeptideSeq"))


def _rule_sql(rule: str) -> str:
    return f"""SELECT '{rule}' AS protease, doc_id, count(DISTINCT p) AS n_peptides,
  CAST(sum(length(p)) AS BIGINT) AS n_residues FROM (
  SELECT DISTINCT doc_id, p FROM (
    SELECT doc_id, unnest(f) AS p FROM (SELECT doc_id, string_split({Q.marked(rule)}, '|') AS f FROM proteins)
    UNION ALL
    SELECT doc_id, unnest(list_transform(list_zip(f[:-2], f[2:]), lambda z: z[1] || z[2]))
    FROM (SELECT doc_id, string_split({Q.marked(rule)}, '|') AS f FROM proteins))
  WHERE {Q.VALID}) GROUP BY doc_id"""


@query(
    "digest_per_protease",
    f"WITH {Q.PROTEINS} " + " UNION ALL ".join(_rule_sql(r) for r in ORACLE_RULES),
)
def digest_per_protease(t: Tables):
    """All rules in one pass over the proteins."""
    found = t.proteins().select("doc_id", digest_totals("sequence", ORACLE_RULES).alias("found"))
    return found.select("doc_id", F.inline("found")).select("protease", "doc_id", "n_peptides", "n_residues")


def _site_sql(rule: str) -> str:
    """Where a rule cuts, from the four residues before and the two after each place."""
    sides = re.findall(r"\(\?<=(.*?)\)\(\?=(.*?)\)(?:\||$)", K.PROTEASES[rule])
    either = " OR ".join(f"(regexp_matches(l, '({a})$') AND regexp_matches(r, '^({b})'))" for a, b in sides)
    return f"SELECT '{rule}' AS protease, doc_id, i FROM places WHERE {either}"


@query(
    "digest_every_protease",
    f"""WITH {Q.PROTEINS},
places AS MATERIALIZED (SELECT doc_id, i, sequence[greatest(i - 3, 1):i] AS l, sequence[i + 1:i + 2] AS r
  FROM (SELECT doc_id, sequence, unnest(range(1, length(sequence))) AS i FROM proteins)),
sites AS ({" UNION ALL ".join(_site_sql(r) for r in K.PROTEASES)}),
rules AS (SELECT unnest([{", ".join(repr(r) for r in K.PROTEASES)}]) AS protease),
ends AS (SELECT * FROM sites UNION ALL SELECT protease, doc_id, 0 FROM rules, proteins
  UNION ALL SELECT protease, doc_id, length(sequence) FROM rules, proteins WHERE length(sequence) > 0),
next AS (SELECT *, lead(i) OVER w AS one, lead(i, 2) OVER w AS two FROM ends WINDOW w AS (PARTITION BY protease, doc_id ORDER BY i)),
pieces AS (SELECT protease, doc_id, i, one AS j FROM next WHERE one - i BETWEEN {K.MIN_PEPTIDE_LEN} AND {K.MAX_PEPTIDE_LEN}
  UNION ALL SELECT protease, doc_id, i, two FROM next WHERE two - i BETWEEN {K.MIN_PEPTIDE_LEN} AND {K.MAX_PEPTIDE_LEN}),
found AS (SELECT DISTINCT protease, doc_id, sequence[i + 1:j] AS p FROM pieces JOIN proteins USING (doc_id))
SELECT protease, doc_id, count(*) AS n_peptides, CAST(sum(length(p)) AS BIGINT) AS n_residues FROM found GROUP BY ALL""",
)
def digest_every_protease(t: Tables):
    """Every rule of the table, each document in one pass."""
    found = t.proteins().select("doc_id", digest_totals("sequence", list(K.PROTEASES)).alias("found"))
    return found.select("doc_id", F.inline("found")).select("protease", "doc_id", "n_peptides", "n_residues")


TWO_MISSED = f"""{Q.PROTEINS}, {Q.fragments()},
runs AS (
  SELECT doc_id, unnest(f) AS p FROM fragments UNION ALL
  SELECT doc_id, unnest(list_transform(list_zip(f[:-2], f[2:]), lambda z: z[1] || z[2])) FROM fragments UNION ALL
  SELECT doc_id, unnest(list_transform(list_zip(f[:-3], f[2:-2], f[3:]), lambda z: z[1] || z[2] || z[3]))
  FROM fragments WHERE len(f) > 2)"""


@query(
    "digest_two_missed_cleavages",
    f"""WITH {TWO_MISSED} SELECT doc_id, count(DISTINCT p) AS n_peptides,
md5(string_agg(DISTINCT p, ',' ORDER BY p)) AS peptides FROM runs WHERE {Q.VALID} GROUP BY doc_id""",
)
def digest_two_missed_cleavages(t: Tables):
    found = keep_computed(t.proteins(), "found", some(P.digest("sequence", missed_cleavages=2)))
    return found.select(
        "doc_id",
        F.size("found").cast("bigint").alias("n_peptides"),
        F.md5(F.array_join(F.array_sort("found"), ",")).alias("peptides"),
    )


@query(
    "peptide_to_protein_with_decoys",
    f"""WITH {Q.DIGEST}
SELECT PeptideSeq, FALSE AS isDecoy, CAST(doc_id AS VARCHAR) AS ProteinAccession FROM relation
UNION ALL
SELECT PeptideSeq[1] || reverse(substr(PeptideSeq, 2, length(PeptideSeq) - 2)) || PeptideSeq[-1], TRUE,
       CAST(doc_id AS VARCHAR) FROM relation""",
)
def peptide_to_protein_with_decoys(t: Tables):
    return t.relation(decoys=True)


@query(
    "unique_peptides_sorted",
    f"""WITH {Q.DIGEST}, both_kinds AS (
SELECT PeptideSeq FROM relation UNION
SELECT PeptideSeq[1] || reverse(substr(PeptideSeq, 2, length(PeptideSeq) - 2)) || PeptideSeq[-1] FROM relation)
SELECT PeptideSeq FROM both_kinds ORDER BY PeptideSeq""",
)
def unique_peptides_sorted(t: Tables):
    """Targets and decoys with equal text become one row."""
    return digestion.sorted_peptides(t.relation(decoys=True))


@query(
    "distinct_peptides_per_protein",
    f"""WITH {Q.PROTEINS}, {Q.fragments()}, {Q.RUNS}
SELECT doc_id, count(*) AS n_runs, count(DISTINCT p) AS n_distinct FROM runs WHERE {Q.VALID} GROUP BY doc_id""",
)
def distinct_peptides_per_protein(t: Tables):
    valid = lambda p: P.has_peptide_length(p) & P.is_canonical(p)
    runs = let(P.cleave("sequence"), lambda f: F.filter(P.join_adjacent(f, 1), valid))
    return keep_computed(t.proteins(), "runs", some(runs)).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.size(F.array_distinct("runs")).cast("bigint").alias("n_distinct"),
    )


@query(
    "decoy_sequences",
    f"""WITH {Q.PEPTIDES} SELECT PeptideSeq,
PeptideSeq[1] || reverse(substr(PeptideSeq, 2, length(PeptideSeq) - 2)) || PeptideSeq[-1] AS decoy FROM peptides""",
)
def decoy_sequences(t: Tables):
    return t.peptides().select("PeptideSeq", P.decoy("PeptideSeq").alias("decoy"))


@query(
    "target_decoy_union",
    f"""WITH {Q.DIGEST} SELECT doc_id, PeptideSeq, false AS isDecoy FROM relation
UNION ALL SELECT doc_id, PeptideSeq[1] || reverse(PeptideSeq[2:-2]) || PeptideSeq[-1], true FROM relation""",
)
def target_decoy_union(t: Tables):
    """Set union of separate target and decoy frames, by column name; the targets have no flag yet."""
    targets = t.relation().drop("isDecoy")
    decoys = targets.select(F.lit(True).alias("isDecoy"), "ProteinAccession", P.decoy("PeptideSeq").alias("PeptideSeq"))
    return union_frames(targets, decoys).select(
        F.col("ProteinAccession").cast("bigint").alias("doc_id"),
        "PeptideSeq",
        F.coalesce("isDecoy", F.lit(False)).alias("isDecoy"),
    )


@query(
    "peptide_length_filter",
    f"""WITH {Q.PROTEINS}, {Q.fragments()}, parts AS (SELECT doc_id, unnest(f) AS p FROM fragments)
SELECT doc_id, count(*) AS n_fragments, count(*) FILTER ({Q.VALID}) AS n_kept FROM parts GROUP BY doc_id""",
)
def peptide_length_filter(t: Tables):
    parts = t.proteins().select("doc_id", F.explode(P.cleave("sequence")).alias("p"))
    return parts.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_fragments"), F.count_if(P.has_peptide_length("p")).alias("n_kept")
    )


@query(
    "canonical_residue_filter",
    f"""WITH words AS (SELECT doc_id, upper(unnest(regexp_split_to_array(text, '[^A-Za-z]+'))) AS w FROM documents)
SELECT doc_id, count(*) AS n_words, count(*) FILTER (length(translate(w, '{Q.LETTERS}', '')) = 0) AS n_canonical
FROM words WHERE w <> '' GROUP BY doc_id""",
)
def canonical_residue_filter(t: Tables):
    words = t.documents().select(
        "doc_id", F.explode(F.split("text", "[^A-Za-z]+")).alias("w")
    ).where(F.col("w") != "")
    return words.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_words"),
        F.count_if(P.is_canonical(F.upper("w"))).alias("n_canonical"),
    )


@query(
    "fixed_modification_sites",
    f"""WITH {Q.PEPTIDES}, sites AS (
SELECT PeptideSeq, unnest(list_filter(range(1, length(PeptideSeq) + 1), lambda i: PeptideSeq[i] = 'C')) AS site FROM peptides)
SELECT PeptideSeq, CAST(site AS INTEGER) AS site, 57.0214635::DOUBLE AS delta FROM sites""",
)
def fixed_modification_sites(t: Tables):
    return t.peptides().select("PeptideSeq", F.inline(M.mod_sites("PeptideSeq", CAM)))


@query("variable_modification_forms", f"WITH {Q.VARIANTS} SELECT PeptideSeq, PeptideModSeq FROM variants")
def variable_modification_forms(t: Tables):
    return t.variants().select("PeptideSeq", "PeptideModSeq")


@query(
    "modification_site_choices",
    f"""WITH {Q.VARIANTS} SELECT PeptideSeq, array_to_string(sites, '+') AS sites FROM chosen""",
)
def modification_site_choices(t: Tables):
    chosen = modification.choose_sites(t.peptides(), OXIDATION, 2)
    return chosen.select(
        "PeptideSeq",
        F.array_join(F.transform("sites", lambda s: s["site"].cast("string")), "+").alias("sites"),
    )


@query(
    "modseq_writer",
    f"""WITH {Q.PEPTIDES}, m AS (SELECT PeptideSeq, string_split(PeptideSeq, '') AS c FROM peptides)
SELECT PeptideSeq, array_to_string(list_transform(c, lambda x: CASE x WHEN 'C' THEN 'C' || printf('[%+f]', 57.0214635::DOUBLE)
WHEN 'M' THEN 'M' || printf('[%+f]', 15.994915::DOUBLE) WHEN 'Q' THEN 'Q' || printf('[%+f]', -17.0265491::DOUBLE) ELSE x END), '')
AS PeptideModSeq FROM m""",
)
def modseq_writer(t: Tables):
    """The general writer, from a list of sites (positive and negative deltas)."""
    deltas = {**CAM, **OXIDATION, "Q": -K.MOD_MASSES["NH3"]}
    return t.peptides().select(
        "PeptideSeq", M.write_sites("PeptideSeq", M.mod_sites("PeptideSeq", deltas)).alias("PeptideModSeq")
    )


@query("strip_modifications", f"WITH {Q.VARIANTS} SELECT PeptideModSeq, PeptideSeq AS stripped FROM variants")
def strip_modifications(t: Tables):
    return t.variants().select("PeptideModSeq", M.strip_mods("PeptideModSeq").alias("stripped"))


@query(
    "parse_modifications",
    f"""WITH {Q.VARIANT_SITES}
SELECT PeptideModSeq, CAST(site AS INTEGER) AS site, CAST(delta AS DOUBLE) AS delta FROM variant_sites""",
)
def parse_modifications(t: Tables):
    return t.variants().select("PeptideModSeq", F.inline(M.parse_mods("PeptideModSeq")))


@query(
    "modification_labels",
    f"""WITH {Q.VARIANT_SITES}
SELECT PeptideModSeq, string_agg(CAST(site - 1 AS VARCHAR) || substr(PeptideSeq, site - 1, 1) || printf('%+d', CAST(floor(delta) AS INTEGER)),
' ' ORDER BY site) AS label FROM variant_sites WHERE site BETWEEN 3 AND 20 GROUP BY PeptideModSeq""",
)
def modification_labels(t: Tables):
    label = M.mod_label("PeptideSeq", M.parse_mods("PeptideModSeq"), 3, 20, 1)
    return t.variants().select("PeptideModSeq", label.alias("label")).where(F.col("label") != "")


@query(
    "charge_energy_expansion",
    f"""WITH {Q.PEPTIDES} SELECT PeptideSeq, z AS PrecursorCharge, e::DOUBLE AS nce
FROM peptides, (VALUES (2, 27.0), (3, 30.0), (4, 33.0)) c(z, e)""",
)
def charge_energy_expansion(t: Tables):
    return modification.expand_charges(t.peptides(), [2, 3, 4], [27, 30.0, 33]).select(
        "PeptideSeq", "PrecursorCharge", "nce"
    )


@query(
    "precursor_mz_per_supplier",
    f"""WITH {Q.SPECTRA}, {Q.residue_rows("spectra", "spectrum_id, PrecursorCharge")},
m AS (SELECT spectrum_id, PrecursorCharge AS z, CAST(sum(nano) AS BIGINT) + {K.WATER_NANO} AS nano FROM residues GROUP BY ALL)
SELECT spectrum_id, CAST(z AS INTEGER) AS PrecursorCharge, CAST(least(z, 3) AS INTEGER) AS fragment_charge, round({Q.mz("nano", "z")}, 6) AS PrecursorMz FROM m""",
)
def precursor_mz_per_supplier(t: Tables):
    """Precursor m/z and the fragment charge cap for every charge from 1 to 6."""
    mass = S.peptide_mass("PeptideModSeq")
    return t.spectra().select(
        "spectrum_id",
        "PrecursorCharge",
        fragment_charge_cap("PrecursorCharge").alias("fragment_charge"),
        F.round(S.precursor_mz(mass, "PrecursorCharge"), 6).alias("PrecursorMz"),
    )

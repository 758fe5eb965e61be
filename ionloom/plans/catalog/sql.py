"""Building blocks of the SQL checks, worked out independently of the Spark plans.

The SQL side has no lookaround, so sites are marked with '|' by plain string
replacement and taken back where the rule forbids the cut.
"""

from __future__ import annotations

from ionloom import constants as K

LETTERS = K.CANONICAL

PROTEINS = f"""proteins AS (
  SELECT doc_id, lang, source, n_chars,
         regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^{LETTERS}]', '', 'g') AS sequence
  FROM documents)"""


def marked(rule: str = "trypsin", s: str = "sequence") -> str:
    def replace_all(text: str, pairs) -> str:
        for old, new in pairs:
            text = f"replace({text}, '{old}', '{new}')"
        return text

    after = {
        "trypsin": ("KR", [("K|P", "KP"), ("R|P", "RP"), ("WKP", "WK|P"), ("MRP", "MR|P")]),
        "lysc": ("K", []),
        "arg-c": ("R", []),
        "glutamyl endopeptidase": ("E", []),
        "cnbr": ("M", []),
        "chymotrypsin high specificity": ("FYW", [("F|P", "FP"), ("Y|P", "YP"), ("W|P", "WP"), ("W|M", "WM")]),
    }
    if rule == "asp-n":
        return f"regexp_replace(replace({s}, 'D', '|D'), '^\\|', '')"
    letters, undo = after[rule]
    cuts = replace_all(s, [(c, c + "|") for c in letters])
    return f"regexp_replace({replace_all(cuts, undo)}, '\\|$', '')"


def fragments(rule: str = "trypsin") -> str:
    return f"fragments AS (SELECT doc_id, lang, source, n_chars, string_split({marked(rule)}, '|') AS f FROM proteins)"


VALID = f"length(p) BETWEEN {K.MIN_PEPTIDE_LEN} AND {K.MAX_PEPTIDE_LEN}"
RUNS = """runs AS (
  SELECT doc_id, unnest(f) AS p FROM fragments
  UNION ALL
  SELECT doc_id, unnest(list_transform(list_zip(f[:-2], f[2:]), lambda z: z[1] || z[2])) AS p FROM fragments)"""
RELATION = f"relation AS (SELECT DISTINCT doc_id, p AS PeptideSeq FROM runs WHERE {VALID})"
DIGEST = ",\n".join([PROTEINS, fragments(), RUNS, RELATION])
PEPTIDES = DIGEST + ",\npeptides AS (SELECT DISTINCT PeptideSeq FROM relation)"

CAM_TEXT, OX_TEXT = "[+57.021464]", "[+15.994915]"
MODIFIED = (
    PEPTIDES
    + f""",
modified AS (SELECT PeptideSeq, replace(PeptideSeq, 'C', 'C{CAM_TEXT}') AS PeptideModSeq FROM peptides)"""
)
FIRST = (
    DIGEST
    + f""",
first_peptides AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars, r.PeptideSeq, replace(r.PeptideSeq, 'C', 'C{CAM_TEXT}') AS PeptideModSeq
  FROM documents d JOIN (SELECT doc_id, min(PeptideSeq) AS PeptideSeq FROM relation GROUP BY doc_id) r USING (doc_id))"""
)

# no, one or two oxidised M per peptide; sites lists the chosen ones
VARIANTS = (
    PEPTIDES
    + f""",
m_sites AS (
  SELECT PeptideSeq, unnest(list_filter(range(1, length(PeptideSeq) + 1), lambda i: PeptideSeq[i] = 'M')) AS s
  FROM peptides),
chosen AS (
  SELECT PeptideSeq, CAST([] AS BIGINT[]) AS sites, PeptideSeq AS ox FROM peptides
  UNION ALL
  SELECT PeptideSeq, [s], substr(PeptideSeq, 1, s) || '{OX_TEXT}' || substr(PeptideSeq, s + 1) FROM m_sites
  UNION ALL
  SELECT a.PeptideSeq, [a.s, b.s],
         substr(a.PeptideSeq, 1, a.s) || '{OX_TEXT}' || substr(a.PeptideSeq, a.s + 1, b.s - a.s)
         || '{OX_TEXT}' || substr(a.PeptideSeq, b.s + 1)
  FROM m_sites a JOIN m_sites b ON a.PeptideSeq = b.PeptideSeq AND a.s < b.s),
variants AS (SELECT PeptideSeq, sites, replace(ox, 'C', 'C{CAM_TEXT}') AS PeptideModSeq FROM chosen)"""
)
VARIANT_SITES = (
    VARIANTS
    + """,
variant_sites AS (
  SELECT PeptideSeq, PeptideModSeq, site, delta FROM (
    SELECT PeptideSeq, PeptideModSeq, unnest(sites) AS site, 15.994915 AS delta FROM variants
    UNION ALL
    SELECT PeptideSeq, PeptideModSeq,
           unnest(list_filter(range(1, length(PeptideSeq) + 1), lambda i: PeptideSeq[i] = 'C')) AS site, 57.021464
    FROM variants))"""
)

RESIDUES = "residue_mass(residue, nano) AS (VALUES " + ", ".join(
    f"('{r}', CAST({n} AS BIGINT))" for r, n in K.RESIDUE_NANO.items()
) + ")"


def residue_rows(source: str, keys: str, deltas: str = "CASE residue WHEN 'C' THEN 57021464000 ELSE 0 END") -> str:
    """residues(keys, pos, residue, nano, n): one row per residue, with its modification."""
    return f"""{RESIDUES},
letters AS (
  SELECT {keys}, length(PeptideSeq) AS n, unnest(string_split(PeptideSeq, '')) AS residue,
         unnest(range(1, length(PeptideSeq) + 1)) AS pos FROM {source}),
residues AS (SELECT {keys}, n, pos, residue, nano + {deltas} AS nano FROM letters JOIN residue_mass USING (residue))"""


def ladder(keys: str) -> str:
    """ladder(keys, n, pos, b, total): running sums of residues and the whole mass."""
    return f"""ladder AS (
  SELECT {keys}, n, pos, residue,
         CAST(sum(nano) OVER (PARTITION BY {keys} ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS b,
         CAST(sum(nano) OVER (PARTITION BY {keys}) AS BIGINT) + {K.WATER_NANO} AS total
  FROM residues)"""


def mz(nano: str, z: str) -> str:
    return f"((CAST({nano} AS DOUBLE) / 1e9 + {z} * CAST({K.PROTON_MASS} AS DOUBLE)) / {z})"


def micro(x: str) -> str:
    """Whole millionths, so that sums are exact."""
    return f"CAST(floor({x} * CAST(1e6 AS DOUBLE) + 0.5) AS BIGINT)"


PEAKS = """peaks AS (
  SELECT l_suppkey AS spectrum_id, l_orderkey * 8 + l_linenumber AS peak_index,
         50.0::DOUBLE + l_extendedprice % 1950 AS mz, CAST(l_quantity AS FLOAT) AS intensity FROM lineitem)"""
SPECTRA = (
    FIRST
    + """,
spectra AS (
  SELECT s_suppkey AS spectrum_id, PeptideSeq, PeptideModSeq, 1 + s_suppkey % 6 AS PrecursorCharge,
         CAST(n_chars AS DOUBLE) AS RT, 'set' || (s_suppkey % 3) AS dataset,
         CASE WHEN s_suppkey % 2 = 0 THEN 'hcd' ELSE 'cid' END AS frag_type,
         CASE WHEN s_suppkey % 2 = 0 THEN 30.0 ELSE 35.0 END::DOUBLE AS nce
  FROM supplier JOIN first_peptides ON doc_id = s_suppkey)"""
)
TOLERANCES = {"high": "CAST(20e-6 AS DOUBLE) * i.mz", "low": "CAST(0.35 AS DOUBLE)"}


def matches(resolution: str) -> str:
    """matches(spectrum_id, ion_type, ordinal, frag_z, mz, intensity): all pairs of a spectrum."""
    tol = TOLERANCES[resolution]
    return f"""{SPECTRA},
{PEAKS},
{residue_rows("spectra", "spectrum_id, PrecursorCharge")},
{ladder("spectrum_id, PrecursorCharge")},
ions AS (
  SELECT spectrum_id, ion_type, ordinal, frag_z, {mz("nano", "frag_z")} AS mz FROM (
    SELECT spectrum_id, PrecursorCharge, 'b' AS ion_type, pos AS ordinal, b AS nano FROM ladder WHERE pos < n
    UNION ALL
    SELECT spectrum_id, PrecursorCharge, 'y', n - pos, total - b FROM ladder WHERE pos < n),
    (VALUES (1), (2)) z(frag_z) WHERE frag_z <= PrecursorCharge),
pairs AS (
  SELECT i.*, p.intensity AS found,
         row_number() OVER (PARTITION BY i.spectrum_id, ion_type, ordinal, frag_z
                            ORDER BY abs(p.mz - i.mz), peak_index, p.intensity) AS place
  FROM ions i JOIN peaks p ON p.spectrum_id = i.spectrum_id AND abs(p.mz - i.mz) <= {tol}),
matches AS (
  SELECT i.*, coalesce(CAST(found AS DOUBLE), 0.0) AS intensity FROM ions i
  LEFT JOIN (SELECT * FROM pairs WHERE place = 1) USING (spectrum_id, ion_type, ordinal, frag_z, mz))"""


RETENTION = (
    FIRST
    + """,
rt AS (SELECT doc_id, lang, PeptideSeq, PeptideModSeq, CAST(n_chars AS DOUBLE) AS HI, source AS Source FROM first_peptides),
retention AS (SELECT rt.*, pred FROM rt JOIN (SELECT lang, avg(HI) AS pred FROM rt GROUP BY lang) USING (lang))"""
)

VECTORS = """cells AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
means AS (SELECT label, i, avg(v) AS m FROM cells GROUP BY label, i),
vectors AS (SELECT vec_id, i, m AS pred, CASE WHEN v < -0.2 THEN -1.0 ELSE v END::DOUBLE AS t FROM cells JOIN means USING (label, i))"""

DATASETS = """datasets AS (
  SELECT event_id, event_type AS dataset, CASE WHEN user_id % 2 = 1 THEN 'HCD' ELSE 'CID' END AS frag_type,
         CASE WHEN user_id % 2 = 1 THEN 30.0 ELSE 35.0 END::DOUBLE AS nce, value FROM events)"""


def shuffle_key(*columns: str) -> str:
    """The hash that orders rows like a shuffle: each value with its length before it."""
    parts = [f"coalesce(';' || length({c}::VARCHAR) || ':' || {c}, ';-')" for c in columns]
    return "md5('2447' || " + " || ".join(parts) + ")"


def codes(text: str, size: int = K.MAX_CODED_LEN) -> str:
    """Integer codes of a coded sequence as a list."""
    return (
        f"list_transform(string_split(rpad({text}, {size}, '0'), ''), lambda ch: strpos('{K.ALPHABET}', ch))"
    )

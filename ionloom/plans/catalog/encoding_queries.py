"""Coded sequences, integer vectors, one-hot features, padded ion arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from ionloom import constants as K
from ionloom.functions import encoding as E, masses as S
from ionloom.operators import assembly
from ionloom.plans.catalog import sql as Q
from ionloom.plans.catalog.digestion_queries import micro
from ionloom.plans.catalog.matching_queries import _SAMPLES_SQL
from ionloom.plans.catalog.registry import query
from ionloom.plans.catalog.tables import Tables
from ionloom.plans.training_sets import retention_features, sample_features, samples_from_tables
from ionloom.sources.retention import sorted_sources

# every kind of terminal and an unknown modification, chosen by the length
_VARIED = """CASE length(PeptideSeq) % 7 WHEN 0 THEN '[+42.010565]' || PeptideModSeq
WHEN 1 THEN '[+224.152478]' || PeptideModSeq WHEN 2 THEN 'Q[-17.026549]' || PeptideModSeq
WHEN 3 THEN PeptideModSeq || 'K[+99.900000]' WHEN 4 THEN 'C[+39.994914]' || PeptideModSeq || 'K[+229.162932]'
WHEN 5 THEN '[+12.300000]' || PeptideModSeq ELSE PeptideModSeq || 'S[+79.966331]' END"""


def _varied(t: Tables):
    m = F.col("PeptideModSeq")
    kind = F.length("PeptideSeq") % 7
    text = (
        F.when(kind == 0, F.concat(F.lit("[+42.010565]"), m))
        .when(kind == 1, F.concat(F.lit("[+224.152478]"), m))
        .when(kind == 2, F.concat(F.lit("Q[-17.026549]"), m))
        .when(kind == 3, F.concat(m, F.lit("K[+99.900000]")))
        .when(kind == 4, F.concat(F.lit("C[+39.994914]"), m, F.lit("K[+229.162932]")))
        .when(kind == 5, F.concat(F.lit("[+12.300000]"), m))
        .otherwise(F.concat(m, F.lit("S[+79.966331]")))
    )
    return t.variants().select(text.alias("m"))


def _coded_sql(source: str, text: str) -> str:
    """coded(m, coded): the rules one after the other, then the terminal tokens."""
    body = text
    for residue, prefix, symbol in K.CODED_MODS:
        body = f"regexp_replace({body}, '{K.coded_mod_pattern(residue, prefix)}', '{symbol}', 'g')"
    tokens = " ".join(
        f"WHEN starts_with(c, '[{p}') THEN '{s}' || substr(c, strpos(c, ']') + 1) || '_'"
        for p, s in K.NTERM_TOKENS.items()
    )
    return f"""renamed AS (SELECT {text} AS m, {body} AS c FROM {source}),
tokened AS (SELECT m, c, CASE {tokens} WHEN starts_with(c, '[') THEN NULL
  WHEN starts_with(c, 'd') THEN ')' || c || '_' WHEN starts_with(c, 'e') THEN '(' || c || '_'
  ELSE '-' || c || '_' END AS w FROM renamed),
coded AS (SELECT m, c, CASE WHEN strpos(w, '[') = 0 THEN w END AS coded FROM tokened)"""


@query("coded_sequences", f"WITH {Q.VARIANTS}, {_coded_sql('variants', _VARIED)} SELECT m, c AS renamed, coalesce(coded, 'unknown') AS coded FROM coded")
def coded_sequences(t: Tables):
    return _varied(t).select(
        "m",
        assembly.renamed_texts("m").alias("renamed"),
        F.coalesce(assembly.coded_texts("m"), F.lit("unknown")).alias("coded"),
    )


@query(
    "integer_encoded_peptides",
    f"""WITH {Q.VARIANTS}, {_coded_sql('variants', 'PeptideModSeq')}
SELECT m AS PeptideModSeq, array_to_string({Q.codes('coded')}, ' ') AS codes FROM coded""",
)
def integer_encoded_peptides(t: Tables):
    codes = assembly.code_arrays(assembly.coded_texts("PeptideModSeq"))
    return t.variants().select("PeptideModSeq", F.array_join(codes.cast("array<string>"), " ").alias("codes"))


@query(
    "charge_one_hot",
    """SELECT l_orderkey, l_linenumber, 1 + l_partkey % 8 AS charge,
array_to_string(list_transform(range(1, 7), lambda z: CASE WHEN z = 1 + l_partkey % 8 THEN '1.0' ELSE '0.0' END), ' ') AS one_hot
FROM lineitem""",
)
def charge_one_hot(t: Tables):
    charged = t.table("lineitem").select(
        "l_orderkey", "l_linenumber", (1 + F.col("l_partkey") % 8).alias("charge")
    )
    hot = F.transform(E.charge_one_hot("charge"), lambda v: v.cast("string"))
    return charged.select("*", F.array_join(hot, " ").alias("one_hot"))


@query(
    "source_one_hot",
    """WITH s AS (SELECT list(DISTINCT source ORDER BY source) AS all_sources FROM documents)
SELECT doc_id, source, len(all_sources) AS width, list_position(all_sources, source) AS position FROM documents, s""",
)
def source_one_hot(t: Tables):
    docs = t.table("documents").select("doc_id", "source")
    names = sorted_sources(docs, "source").scalar()
    hot = docs.select("doc_id", "source", E.category_one_hot("source", names).alias("hot"))
    return hot.select(
        "doc_id",
        "source",
        F.size("hot").cast("bigint").alias("width"),
        F.array_position("hot", F.lit(1.0).cast("float")).cast("int").alias("position"),
    )


@query(
    "retention_feature_table",
    f"""WITH {Q.FIRST}, s AS (SELECT list(DISTINCT source ORDER BY source) AS names FROM first_peptides)
SELECT PeptideModSeq, CAST(n_chars AS FLOAT) AS target,
array_to_string({Q.codes("'-' || replace(PeptideSeq, 'C', 'c') || '_'")}, ' ') AS codes,
array_to_string(list_transform(names, lambda x: CASE WHEN x = source THEN '1.0' ELSE '0.0' END), ' ') AS source
FROM first_peptides, s""",
)
def retention_feature_table(t: Tables):
    rows = t.retention().withColumn("CodedPeptideSeq", E.coded_sequence("PeptideModSeq"))
    table = retention_features(rows, sorted_sources(rows))
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ")
    return table.select("PeptideModSeq", "target", text("codes").alias("codes"), text("source").alias("source"))


@query(
    "sample_feature_table",
    f"""WITH {_SAMPLES_SQL}
SELECT coded_seq, CAST(PrecursorCharge AS INTEGER) AS precursor_z,
array_to_string({Q.codes("coded_seq")}, ' ') AS codes,
array_to_string(list_transform(range(1, 7), lambda z: CASE WHEN z = PrecursorCharge THEN '1.0' ELSE '0.0' END), ' ') AS charge,
CASE WHEN frag_type = 'hcd' THEN nce ELSE 0 END::FLOAT AS nce, frag_type = 'hcd' AS is_beam, 1.0::FLOAT AS weight,
string_agg(CAST({Q.micro("cell::DOUBLE")} AS VARCHAR), ' ' ORDER BY channel, i) AS target
FROM filled GROUP BY ALL""",
)
def sample_feature_table(t: Tables):
    """Model inputs of the training samples, with the ion matrix as target."""
    samples = samples_from_tables(t.spectra(), t.peaks(), "spectrum_id", "low")
    features = sample_features(samples)
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ")
    cells = F.transform(F.flatten("target"), lambda v: micro(v.cast("double")).cast("string"))
    return features.select(
        "coded_seq",
        "precursor_z",
        text("codes").alias("codes"),
        text("charge").alias("charge"),
        "nce",
        "is_beam",
        "weight",
        F.array_join(cells, " ").alias("target"),
    )


_SPLIT_ROWS = "UNION ALL ".join(
    f"SELECT vec_id, {c} AS channel, embedding[{c * 16 + 1}:{c * 16 + 16}] AS r FROM embeddings " for c in range(4)
)


def _four_rows(t: Tables):
    rows = F.array(*[F.slice("embedding", c * 16 + 1, 16) for c in range(4)])
    return t.embeddings().select("vec_id", rows.alias("rows"))


@query(
    "pad_ion_matrix",
    f"""WITH rows AS ({_SPLIT_ROWS}), micros AS (
SELECT vec_id, channel, list_transform(r, lambda v: {Q.micro('v::DOUBLE')}) AS m FROM rows)
SELECT vec_id, channel, array_to_string(m, ' ') || repeat(' -1000000', 18) AS cells FROM micros""",
)
def pad_ion_matrix(t: Tables):
    padded = _four_rows(t).select("vec_id", F.posexplode(E.pad_ions("rows")).alias("channel", "r"))
    cells = F.transform("r", lambda v: micro(v.cast("double")).cast("string"))
    return padded.select("vec_id", "channel", F.array_join(cells, " ").alias("cells"))


@query(
    "trim_ion_matrix",
    f"""WITH {Q.FIRST}, rows AS ({_SPLIT_ROWS}), kept AS (
SELECT vec_id, channel, list_transform(r[1:length(PeptideSeq) - 1], lambda v: {Q.micro('v::DOUBLE')}) AS m
FROM rows JOIN first_peptides ON doc_id = vec_id)
SELECT vec_id, channel, array_to_string(m, ' ') AS cells FROM kept""",
)
def trim_ion_matrix(t: Tables):
    peptides = t.first_peptides().select(F.col("doc_id").alias("vec_id"), "PeptideSeq")
    trimmed = _four_rows(t).join(peptides, "vec_id").select(
        "vec_id", F.posexplode(E.trim_ions("rows", "PeptideSeq")).alias("channel", "r")
    )
    cells = F.transform("r", lambda v: micro(v.cast("double")).cast("string"))
    return trimmed.select("vec_id", "channel", F.array_join(cells, " ").alias("cells"))

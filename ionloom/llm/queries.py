"""One registered query per training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ionloom.llm import collocations, fingerprints, hash_forest, jaccard, language, merkle, packing, pieces, quality, sequences, token_counts, toxicity, warc
from ionloom.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(run: Callable[[SparkSession, str], DataFrame]):
    def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return run(spark, sf_dir)

    QUERIES[run.__name__] = shipped
    return run


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


SQL["op1_ngram_jaccard_join"] = r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS words FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(words) - 4, least(len(words), 1)) + 1),
  lambda i: array_to_string(words[i:i + 4], ' ')))) AS grams FROM w),
c AS (SELECT grams, min(doc_id) AS id, count(*) AS copies FROM s GROUP BY grams),
g AS MATERIALIZED (SELECT id, len(grams) AS n, unnest(grams) AS gram FROM c),
shared AS MATERIALIZED (SELECT a.id AS u, b.id AS v, a.n AS p, b.n AS q, count(*) AS k
  FROM g a JOIN g b ON a.gram = b.gram AND a.id <> b.id GROUP BY ALL),
links AS MATERIALIZED (SELECT u, v FROM shared WHERE k / (p + q - k) >= 0.8),
reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
root AS (SELECT u AS id, least(u, min(v)) AS root FROM reach GROUP BY u),
near AS (SELECT l.u AS id, CAST(sum(c.copies) AS BIGINT) AS links FROM links l JOIN c ON c.id = l.v GROUP BY l.u)
SELECT s.doc_id, coalesce(root, c.id) AS class_id, c.id AS copy_class, c.copies - 1 + coalesce(links, 0) AS n_links
FROM s JOIN c ON s.grams = c.grams LEFT JOIN root ON root.id = c.id LEFT JOIN near ON near.id = c.id"""


@query
def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op3_warc"] = """WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f"""


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file(), limit=512)


@query
def op5_token_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.round_trip(table(spark, sf_dir, "documents"), tokenizer_file(), end_id=2)


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language.held_out(F.col("doc_id"), 4, 2)
    model = language.fit_languages(docs.where(~held_out).select("doc_id", "text", "lang"))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


@query
def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file(), end_id=0)


@query
def op8_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    held_out = language.held_out(F.col("doc_id"), 5, 0)
    model = quality.fit_quality(docs, labels.where(~held_out))
    found = quality.score_quality(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op10_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.segmentations(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), n=4)


@query
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = language.held_out(F.col("doc_id"), 3, 1)
    model = toxicity.fit_toxicity(docs, labels.where(~held_out))
    found = toxicity.score_toxicity(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted", "sentence")


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_manifest(table(spark, sf_dir, "documents"))


SQL["op12_merkle_manifest"] = r"""WITH RECURSIVE
crc_table AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
    lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT))),
    lambda c, b: xor(c // 256, t[1 + xor(c, b) % 256])), 4294967295) % 2 = 0 AS hit
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), crc_table),
raw AS (SELECT d.doc_id, source, text, coalesce(hit, false) AS hit,
    coalesce(strlen(CAST(d.doc_id AS VARCHAR)) || ':' || d.doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
  FROM documents d LEFT JOIN crc ON crc.doc_id = d.doc_id),
hashed AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(own) || ':' || own, '-')) AS now
  FROM (SELECT *, CASE WHEN hit THEN replace(text, chr(10), '') ELSE text END AS own FROM raw)),
leaves AS MATERIALIZED (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, count(*) OVER (PARTITION BY source) AS n,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM hashed),
nodes(s, level, i, n, h) AS (SELECT s, 0, i, n, leaf FROM leaves UNION ALL
  SELECT s, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY s, level, i // 3, n),
kept AS MATERIALIZED (SELECT * FROM nodes),
subroots AS MATERIALIZED (SELECT s, h, level AS top, count(*) OVER () AS n FROM kept WHERE n = 1),
upper(level, i, n, h) AS (SELECT 0, s, n, h FROM subroots UNION ALL
  SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY level, i // 3, n),
kept_upper AS MATERIALIZED (SELECT * FROM upper),
steps AS MATERIALIZED (
  SELECT l.s, l.i, k.level, string_agg(k.h, '' ORDER BY k.i) FILTER (k.i < l.i // CAST(3 ** k.level AS BIGINT)) AS a,
    string_agg(k.h, '' ORDER BY k.i) FILTER (k.i > l.i // CAST(3 ** k.level AS BIGINT)) AS b
  FROM leaves l JOIN kept k ON k.s = l.s AND k.n > 1 AND k.i // 3 = l.i // CAST(3 ** (k.level + 1) AS BIGINT) GROUP BY ALL
  UNION ALL
  SELECT l.s, l.i, r.top + k.level, string_agg(k.h, '' ORDER BY k.i) FILTER (k.i < l.s // CAST(3 ** k.level AS BIGINT)),
    string_agg(k.h, '' ORDER BY k.i) FILTER (k.i > l.s // CAST(3 ** k.level AS BIGINT))
  FROM leaves l JOIN subroots r ON r.s = l.s JOIN kept_upper k ON k.n > 1 AND k.i // 3 = l.s // CAST(3 ** (k.level + 1) AS BIGINT) GROUP BY ALL),
folded(s, i, level, h) AS (SELECT s, i, 0, now FROM leaves UNION ALL
  SELECT f.s, f.i, f.level + 1, sha256(coalesce(a, '') || h || coalesce(b, '')) FROM folded f JOIN steps p ON p.s = f.s AND p.i = f.i AND p.level = f.level),
ends AS (SELECT s, i, max_by(h, level) AS folded_root FROM folded GROUP BY s, i),
proofs AS (SELECT s, i, string_agg(coalesce(a, '') || coalesce(b, ''), '' ORDER BY level) AS path FROM steps GROUP BY s, i),
root AS (SELECT h AS root FROM kept_upper WHERE n = 1)
SELECT doc_id, leaf, r.h AS subroot, root, sha256(coalesce(path, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN subroots r ON r.s = l.s JOIN ends e ON e.s = l.s AND e.i = l.i
LEFT JOIN proofs p ON p.s = l.s AND p.i = l.i CROSS JOIN root"""


@query
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


SQL["op13_phrase_collocations"] = r"""WITH
texts AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
pieces AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM texts),
total AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
f AS MATERIALIZED (SELECT lang, phrase, count(*) AS a FROM (SELECT lang,
    unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM pieces, range(1, 5) r(k) WHERE len(w) >= k) GROUP BY ALL),
often AS MATERIALIZED (SELECT lang, string_split(phrase, ' ') AS phrase, a FROM f WHERE a >= 30 AND contains(phrase, ' ')),
part AS MATERIALIZED (SELECT lang, phrase, a, k, array_to_string(phrase[1:k], ' ') AS x, array_to_string(phrase[k + 1:], ' ') AS y
  FROM often JOIN range(1, 4) t(k) ON k < len(phrase)),
half AS MATERIALIZED (SELECT p.*, f.a AS l FROM part p JOIN f ON f.lang = p.lang AND f.phrase = x),
cut AS MATERIALIZED (SELECT p.lang, p.phrase, p.a, k, l, f.a AS r, 2000000 * CAST(p.a AS HUGEINT) // (l + f.a) AS score
  FROM half p JOIN f ON f.lang = p.lang AND f.phrase = y),
lowest AS MATERIALIZED (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS MATERIALIZED (SELECT lang, a, unnest(list_transform(range(1, len(phrase) - k + 2), lambda i: array_to_string(phrase[i:i + k - 1], ' '))) AS phrase
  FROM often JOIN range(2, 4) t(k) ON k < len(phrase)),
covers AS MATERIALIZED (SELECT lang, phrase, max(a) AS most FROM inside GROUP BY ALL),
kept AS MATERIALIZED (SELECT w.lang, array_to_string(w.phrase, ' ') AS phrase, a, l, r, score FROM lowest w
  LEFT JOIN covers c ON c.lang = w.lang AND c.phrase = array_to_string(w.phrase, ' ') WHERE coalesce(100 * most < 80 * a, true)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""

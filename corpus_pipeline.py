"""From documents to packed training sequences, in stages that each read what the one before kept.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of ``docs``.
Null and empty texts, repeated rows and extra columns are allowed in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ionloom.llm import jaccard, language, packing, quality
from ionloom.llm.files import written
from ionloom.llm.queries import table, tokenizer_file
from ionloom.session import ship_package

LEAST_LANGUAGE_SCORE = 0.5


def _judged(docs: DataFrame) -> list[str]:
    """The columns of ``docs`` by position-safe names (a dot in a name is part of it)."""
    return [f"`{c}`" for c in docs.columns]


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and texts whose nearest codeword has a score below one half.

    Where no language could be learned, only texts without a letter are rejected.
    """
    ship_package(spark)
    model = language.fit_languages(docs.select("doc_id", "text", "lang"))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    whole = docs.select(F.struct(*_judged(docs)).alias("doc"))
    found = language.identify(whole, model, ["doc"], F.col("doc.text"))
    known = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return found.where(known).select("doc.*")


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the classifier does not predict as quality 1."""
    ship_package(spark)
    model = quality.fit_quality(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    whole = docs.select(F.struct(*_judged(docs)).alias("doc"))
    found = quality.score_quality(whole, model, ["doc"], F.col("doc.text"))
    return found.where("predicted = 1").select("doc.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, of the smallest id; one without an id if none has one."""
    ship_package(spark)
    first = jaccard.first_of_groups(docs.select("doc_id", "text"))
    whole = docs.select(F.struct(*_judged(docs)).alias("doc"))
    doc_id, text_hash = F.col("doc.doc_id").cast("long"), jaccard.text_hash(F.col("doc.text"))
    of_first = doc_id.eqNullSafe(F.col("first_id")) & (text_hash == F.col("first_hash"))
    same_text = Window.partitionBy(doc_id, text_hash).orderBy(F.xxhash64("doc"))
    kept = whole.join(first, of_first, "left_semi").withColumn("place", F.row_number().over(same_text))
    return kept.where("place = 1").select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document's pieces and their places in sequences of 2048 tokens."""
    ship_package(spark)
    return packing.pack_documents(docs, tokenizer_file(), end_id=0)


STAGES = [
    ("language_id", keep_known_language),
    ("quality_classifier", keep_good_quality),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("best_fit_packing", pack),
]
# SQL cannot express the models, so each stage is tested by itself.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

"""Retention-time tables (gzip TSV)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ionloom import constants as K
from ionloom.functions.encoding import coded_sequence
from ionloom.sources.schemas import RT_TABLE


def with_coded(rows: DataFrame) -> DataFrame:
    """Add the coded sequence and its length; keep codable peptides of valid length."""
    coded = rows.withColumn("CodedPeptideSeq", coded_sequence("PeptideModSeq"))
    return coded.withColumn("PeptideLength", F.length("CodedPeptideSeq") - 2).where(
        F.col("CodedPeptideSeq").isNotNull()
        & F.col("PeptideLength").between(K.MIN_PEPTIDE_LEN, K.MAX_PEPTIDE_LEN)
    )


def read_rt_table(spark: SparkSession, path: str | list[str], partitions: int | None = None) -> DataFrame:
    """A gzip file is one task to read, so the rows of few files are spread before they are coded."""
    rows = spark.read.csv(path, sep="\t", header=True, schema=RT_TABLE)
    wanted = partitions or spark.sparkContext.defaultParallelism
    return with_coded(rows if rows.rdd.getNumPartitions() >= wanted else rows.repartition(wanted))


MAX_SOURCES = 10_000    # a one-hot vector of more is refused


def sorted_sources(rows: DataFrame, column: str = "Source") -> DataFrame:
    """All distinct sources in alphabetical order, as one array (fitted before any split)."""
    found = rows.select(column).distinct().agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(column)).alias("sources"))
    too_many = F.raise_error(F.lit(f"more than {MAX_SOURCES} sources")).cast("array<string>")
    return found.select(F.when(F.col("n") > MAX_SOURCES, too_many).otherwise(F.col("sources")).alias("sources"))

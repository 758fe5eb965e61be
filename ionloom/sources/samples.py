"""Training samples, partitioned by dataset, fragmentation type and collision energy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ionloom import constants as K
from ionloom.functions.spectra import count_strong_ions
from ionloom.sources.schemas import SAMPLES

PARTITIONS = ["dataset", "frag_type", "nce"]


def write_samples(samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per set; rows are brought together first, so a set has few files and a hot set is split."""
    samples.hint("rebalance", *PARTITIONS).write.mode(mode).partitionBy(*PARTITIONS).parquet(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """A partitioned folder; a filter on the three keys prunes folders."""
    return spark.read.schema(SAMPLES).parquet(path)


def dataset_from_name(df: DataFrame, file_name: str = "file_name") -> DataFrame:
    """dataset, frag_type and nce from flat names ``dataset_type_nce_rest``."""
    parts = F.split(F.element_at(F.split(F.col(file_name), "/"), -1), "_")
    return df.select(
        "*",
        F.element_at(parts, 1).alias("dataset"),
        F.element_at(parts, 2).alias("frag_type"),
        F.element_at(parts, 3).cast("double").alias("nce"),
    )


def read_named_samples(spark: SparkSession, path: str) -> DataFrame:
    """A flat folder of Parquet files (or folders) that carry their keys in the name."""
    files = spark.read.option("recursiveFileLookup", "true").parquet(path)
    inside = F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+)/[^/]*$", 1)
    own = F.col("_metadata.file_name")
    named = files.withColumn("file_name", F.when(F.size(F.split(own, "_")) >= 4, own).otherwise(inside))
    return dataset_from_name(named).drop("file_name")


def usable_samples(samples: DataFrame) -> DataFrame:
    """Valid length and charge, and at least three ladder values of 0.01 or more."""
    return samples.where(
        (F.length("coded_seq") - 2 <= K.MAX_PEPTIDE_LEN)
        & F.col("precursor_z").between(K.MIN_PRECURSOR_CHARGE, K.MAX_PRECURSOR_CHARGE)
        & (count_strong_ions("ion_array") >= 3)
    )

"""The given tables seen as proteins, spectra, peaks, retention times and ion vectors.

Text becomes a pseudo-protein, a supplier's line items become the peaks of one
spectrum, a document's first peptide carries its retention time (text length),
and an embedding is a vector of ion intensities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ionloom import constants as K
from ionloom.functions.mods import write_fixed
from ionloom.functions.peptides import digest, protein_from_text
from ionloom.operators.digestion import peptides_to_proteins, unique_peptides
from ionloom.operators.frames import attach, keep_computed, spread
from ionloom.operators.modification import apply_mods
from ionloom.session import materialise, ship_package

CAM = {"C": K.MOD_MASSES["CAM"]}
OXIDATION = {"M": K.MOD_MASSES["Ox"]}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")
        ship_package(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def documents(self) -> DataFrame:
        return spread(self.table("documents"))

    def proteins(self) -> DataFrame:
        return self.documents().select(
            "doc_id",
            F.col("doc_id").cast("string").alias("ProteinAccession"),
            protein_from_text("text").alias("sequence"),
            "lang",
            "source",
            "n_chars",
        )

    def relation(self, decoys: bool = False) -> DataFrame:
        return peptides_to_proteins(self.proteins(), decoys=decoys)

    def peptides(self) -> DataFrame:
        return unique_peptides(self.relation())

    def modified(self) -> DataFrame:
        """Unique peptides with carbamidomethylated C."""
        return apply_mods(self.peptides(), CAM)

    def variants(self) -> DataFrame:
        """Fixed C, and up to two oxidised M."""
        return apply_mods(self.peptides(), CAM, OXIDATION, 2)

    def first_peptides(self) -> DataFrame:
        """The alphabetically first peptide of each document that has one."""
        found = keep_computed(self.proteins(), "PeptideSeq", F.array_min(digest("sequence")))
        return found.select("doc_id", "lang", "source", "n_chars", "PeptideSeq").withColumn(
            "PeptideModSeq", write_fixed("PeptideSeq", CAM)
        )

    def peaks(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_suppkey").alias("spectrum_id"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("peak_index"),
            (50.0 + F.col("l_extendedprice") % 1950).alias("mz"),
            F.col("l_quantity").cast("float").alias("intensity"),
        )

    def spectra(self) -> DataFrame:
        """One spectrum per supplier that has peaks, with the peptide of its document."""
        owners = self.table("supplier").select(F.col("s_suppkey").alias("spectrum_id"))
        peptides = self.first_peptides().withColumnRenamed("doc_id", "spectrum_id")
        key = F.col("spectrum_id")
        spectra = owners.join(peptides, "spectrum_id").select(
            "spectrum_id",
            "PeptideSeq",
            "PeptideModSeq",
            (1 + key % 6).cast("int").alias("PrecursorCharge"),
            F.col("n_chars").cast("double").alias("RT"),
            F.concat(F.lit("set"), (key % 3).cast("string")).alias("dataset"),
            F.when(key % 2 == 0, F.lit("hcd")).otherwise(F.lit("cid")).alias("frag_type"),
            F.when(key % 2 == 0, F.lit(30.0)).otherwise(F.lit(35.0)).alias("nce"),
        )
        return materialise(spectra)  # read several times, but digested once

    def retention(self) -> DataFrame:
        """Peptide, measured value, source and a rough prediction (the mean of the language)."""
        rows = self.first_peptides().select(
            "doc_id",
            "lang",
            "PeptideSeq",
            "PeptideModSeq",
            F.col("n_chars").cast("double").alias("HI"),
            F.col("source").alias("Source"),
        )
        rows = materialise(rows)  # read several times, but digested once
        return attach(rows, rows.groupBy("lang").agg(F.avg("HI").alias("pred")), ["lang"])

    def embeddings(self) -> DataFrame:
        return spread(self.table("embeddings"))

    def ion_vectors(self) -> DataFrame:
        """vec_id, true (values below -0.2 are incompatible ions) and pred (the label's mean)."""
        vectors = self.embeddings().withColumn(
            "embedding", F.transform("embedding", lambda v: v.cast("double"))
        )
        cells = vectors.select("label", F.posexplode("embedding").alias("i", "v"))
        means = cells.groupBy("label", "i").agg(F.avg("v").alias("m"))
        # at most 64 cells per label are gathered
        centroids = means.groupBy("label").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("pred")
        )
        return attach(vectors, centroids, ["label"]).select(
            "vec_id",
            "label",
            "pred",
            F.transform("embedding", lambda v: F.when(v < -0.2, F.lit(-1.0)).otherwise(v)).alias("true"),
        )

    def datasets(self) -> DataFrame:
        """Events as rows of named training sets."""
        odd = F.col("user_id") % 2 == 1
        return self.table("events").select(
            "event_id",
            F.col("event_type").alias("dataset"),
            F.when(odd, F.lit("HCD")).otherwise(F.lit("CID")).alias("frag_type"),
            F.when(odd, F.lit(30.0)).otherwise(F.lit(35.0)).alias("nce"),
            "value",
        )

"""Round trips through every file format: what is written from the tables is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ionloom import constants as K
from ionloom.functions import masses as S
from ionloom.operators.frames import union_frames
from ionloom.plans.catalog import sql as Q
from ionloom.plans.catalog.digestion_queries import micro
from ionloom.plans.catalog.matching_queries import _SAMPLES_SQL, _SELF_ENTRIES
from ionloom.plans.catalog.registry import query
from ionloom.plans.catalog.tables import Tables
from ionloom.plans.training_sets import library_to_samples, samples_from_tables
from ionloom.session import scratch_path
from ionloom.sources import blobs, library
from ionloom.sources.dlib import read_dlib, write_dlib
from ionloom.sources.fasta import read_fasta
from ionloom.sources.retention import read_rt_table
from ionloom.sources.samples import dataset_from_name, read_named_samples, read_samples, write_samples


@query(
    "fasta_scan",
    f"""WITH {Q.PROTEINS} SELECT 'doc' || doc_id || ' ' || source AS ProteinAccession, CAST(length(sequence) AS INTEGER) AS n_residues,
md5(sequence) AS digest FROM proteins""",
)
def fasta_scan(t: Tables):
    """Pseudo-proteins written as FASTA with 60-residue lines, read back as records."""
    header = F.concat(F.lit(">doc"), F.col("doc_id").cast("string"), F.lit(" "), F.col("source"))
    lines = F.regexp_replace("sequence", "(.{60})", "$1\n")
    path = scratch_path(t.spark, "fasta")
    t.proteins().select(F.concat(header, F.lit("\n"), lines)).write.text(path)
    return read_fasta(t.spark, path).select(
        "ProteinAccession", F.length("sequence").alias("n_residues"), F.md5("sequence").alias("digest")
    )


@query(
    "retention_table_scan",
    f"""WITH {Q.FIRST} SELECT PeptideModSeq, CAST(n_chars AS DOUBLE) AS HI, source AS Source,
'-' || replace(PeptideSeq, 'C', 'c') || '_' AS CodedPeptideSeq, CAST(length(PeptideSeq) AS INTEGER) AS PeptideLength
FROM first_peptides WHERE n_chars % 5 <> 0""",
)
def retention_table_scan(t: Tables):
    """A gzip TSV in which every fifth row has an unknown modification and is dropped on reading."""
    unknown = F.when(F.col("HI") % 5 == 0, F.lit("K[+99.900000]")).otherwise(F.lit(""))
    path = scratch_path(t.spark, "rt")
    rows = t.retention().select(F.concat("PeptideModSeq", unknown).alias("PeptideModSeq"), "HI", "Source")
    rows.write.csv(path, sep="\t", header=True, compression="gzip")
    return read_rt_table(t.spark, path)


def _entries(t: Tables):
    """First peptides with their b and y ladder as an observed spectrum."""
    ladder = t.first_peptides().select(
        "doc_id", "PeptideSeq", "PeptideModSeq", "n_chars", S.ladder_nano("PeptideModSeq").alias("l")
    )
    peak = lambda m, i: F.struct(
        S.mz_from_nano(m, 1).alias("mz"), (i + 1).cast("float").alias("intensity")
    )
    peaks = F.concat(F.transform("l.b", peak), F.transform("l.y", peak))
    return ladder.select(
        "doc_id", "PeptideSeq", "PeptideModSeq", "n_chars", blobs.pack_peaks(peaks).alias("blob")
    )


@query(
    "spectrum_blob_round_trip",
    f"""WITH {_SELF_ENTRIES} SELECT doc_id, CAST(8 * count(*) AS INTEGER) AS MassEncodedLength, CAST(4 * count(*) AS INTEGER) AS IntensityEncodedLength,
CAST(sum({Q.micro("mz")}) AS BIGINT) AS mz_micro, CAST(sum(pos) AS BIGINT) AS intensity FROM cells GROUP BY doc_id""",
)
def spectrum_blob_round_trip(t: Tables):
    packed = _entries(t).select("doc_id", "blob.*")
    back = packed.withColumn("arrays", blobs.unpack_arrays())
    return back.select(
        "doc_id",
        "MassEncodedLength",
        "IntensityEncodedLength",
        F.aggregate("arrays.mzs", F.lit(0).cast("bigint"), lambda a, m: a + micro(m)).alias("mz_micro"),
        F.aggregate("arrays.intensities", F.lit(0.0), lambda a, v: a + v).cast("bigint").alias("intensity"),
    )


@query(
    "library_file_round_trip",
    f"""WITH {_SELF_ENTRIES}, spectra AS (SELECT doc_id, count(*) AS n_peaks, CAST(sum({Q.micro("mz")}) AS BIGINT) AS mz_micro FROM cells GROUP BY doc_id)
SELECT PeptideModSeq, PeptideSeq, 2 AS PrecursorCharge, CAST(n_chars AS DOUBLE) AS RTInSeconds, TRUE AS no_copies, n_peaks, mz_micro
FROM first_peptides JOIN spectra USING (doc_id)""",
)
def library_file_round_trip(t: Tables):
    """Entries written as SQLite library shards, one per task, and read back by rowid ranges."""
    entries = _entries(t).select(
        "PeptideSeq",
        "PeptideModSeq",
        F.lit(2).alias("PrecursorCharge"),
        F.col("n_chars").cast("double").alias("RTInSeconds"),
        "blob.*",
    )
    path = scratch_path(t.spark, "dlib")
    write_dlib(entries, path)
    back = read_dlib(t.spark, path).withColumn("arrays", blobs.unpack_arrays())
    return back.select(
        "PeptideModSeq",
        "PeptideSeq",
        "PrecursorCharge",
        "RTInSeconds",
        F.col("Copies").isNull().alias("no_copies"),
        F.size("arrays.mzs").cast("bigint").alias("n_peaks"),
        F.aggregate("arrays.mzs", F.lit(0).cast("bigint"), lambda a, m: a + micro(m)).alias("mz_micro"),
    )


@query(
    "library_create_and_append",
    f"""WITH {Q.DIGEST}
SELECT 'metadata' AS name, 1 AS n_rows, 0 AS n_null UNION ALL
SELECT 'peptidetoprotein', count(*), 0 FROM relation UNION ALL
SELECT 'entries', count(DISTINCT PeptideSeq), count(DISTINCT PeptideSeq) FROM relation""",
)
def library_create_and_append(t: Tables):
    """Create the three tables, append to two of them; columns that are not given are NULL."""
    base = scratch_path(t.spark, "library")
    library.create_library(t.spark, base)
    library.append_table(t.relation(), "peptidetoprotein", base)
    library.append_table(t.peptides(), "entries", base)
    nullable = {"metadata": "Value", "peptidetoprotein": "ProteinAccession", "entries": "PrecursorMz"}
    counts = [
        library.read_table(t.spark, base, name).agg(
            F.lit(name).alias("name"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col(column).isNull()).alias("n_null"),
        )
        for name, column in nullable.items()
    ]
    return union_frames(*counts)


@query(
    "training_sample_write",
    f"""WITH {_SAMPLES_SQL}
SELECT dataset, frag_type, nce, coded_seq, CAST(PrecursorCharge AS INTEGER) AS precursor_z, RT,
CAST(sum({Q.micro("cell::DOUBLE")}) AS BIGINT) AS ion_micro FROM filled GROUP BY ALL""",
)
def training_sample_write(t: Tables):
    """Samples partitioned by dataset, fragmentation type and energy, then read back."""
    samples = samples_from_tables(t.spectra(), t.peaks(), "spectrum_id", "low").drop("spectrum_id")
    path = scratch_path(t.spark, "samples")
    write_samples(samples, path)
    return read_samples(t.spark, path).select(
        "dataset",
        "frag_type",
        "nce",
        "coded_seq",
        "precursor_z",
        "RT",
        F.aggregate(
            F.flatten("ion_array"), F.lit(0).cast("bigint"), lambda a, v: a + micro(v.cast("double"))
        ).alias("ion_micro"),
    )


@query(
    "named_training_set_scan",
    f"""WITH {Q.DATASETS} SELECT dataset, frag_type, nce, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event
FROM datasets GROUP BY ALL""",
)
def named_training_set_scan(t: Tables):
    """A folder whose names carry dataset, fragmentation type and energy."""
    named = t.datasets().select(
        "event_id",
        F.concat_ws("_", "dataset", "frag_type", F.col("nce").cast("string"), F.lit("part")).alias("set"),
    )
    path = scratch_path(t.spark, "named")
    named.write.partitionBy("set").parquet(path)
    return (
        read_named_samples(t.spark, path)
        .groupBy("dataset", "frag_type", "nce")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("event_id").alias("first_event"),
            F.max("event_id").alias("last_event"),
        )
    )


@query(
    "dataset_from_file_name",
    f"""WITH {Q.DATASETS} SELECT event_id, dataset, frag_type, nce FROM datasets""",
)
def dataset_from_file_name(t: Tables):
    names = t.datasets().select(
        "event_id",
        F.concat(
            F.lit("/data/sets/"),
            F.concat_ws("_", "dataset", "frag_type", F.col("nce").cast("string"), F.lit("part.pkl")),
        ).alias("file_name"),
    )
    return dataset_from_name(names).select("event_id", "dataset", "frag_type", "nce")


_OBSERVED = f"""{Q.FIRST}, observed AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS RT, PeptideSeq, '-' || replace(PeptideSeq, 'C', 'c') || '_' AS coded_seq,
  CASE WHEN doc_id % 13 = 3 THEN 'length' WHEN doc_id % 7 = 0 THEN 'modification' WHEN doc_id % 11 = 5 THEN 'no ion' ELSE 'kept' END AS reason
  FROM first_peptides)"""


def library_samples(t: Tables, shards: int):
    """Spectra of first peptides exported as so many library files and made into samples.

    Some entries are no samples: every thirteenth has a sequence that is too short, every
    seventh an unknown modification, every eleventh a spectrum without an ion.
    """
    of = lambda n, i: F.col("doc_id") % n == i
    peak = lambda m, i: F.struct(
        F.when(of(11, 5), F.lit(1.0)).otherwise(S.mz_from_nano(m, 1)).alias("mz"), (i + 1).cast("float").alias("intensity")
    )
    ladder = t.first_peptides().withColumn("l", S.ladder_nano("PeptideModSeq"))
    entries = ladder.select(
        "doc_id",
        F.when(of(13, 3), F.substr("PeptideSeq", F.lit(1), F.lit(4))).otherwise(F.col("PeptideSeq")).alias("PeptideSeq"),
        F.concat("PeptideModSeq", F.when(of(7, 0), "[+99.900000]").otherwise("")).alias("PeptideModSeq"),
        F.lit(2).alias("PrecursorCharge"),
        F.col("n_chars").cast("double").alias("RTInSeconds"),
        blobs.pack_peaks(F.concat(F.transform("l.b", peak), F.transform("l.y", peak))).alias("blob"),
    )
    ordered = entries.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id")
    files = scratch_path(t.spark, "observed")
    write_dlib(ordered.select("PeptideSeq", "PeptideModSeq", "PrecursorCharge", "RTInSeconds", "blob.*"), files)
    return library_to_samples(t.spark, files, scratch_path(t.spark, "samples"), "hcd", 30.0, "observed")


@query(
    "library_files_to_samples",
    f"""WITH {_OBSERVED}, last_ones AS (SELECT coded_seq, max_by(RT, doc_id) AS RT, any_value(length(PeptideSeq)) AS n
  FROM observed WHERE reason = 'kept' GROUP BY coded_seq)
SELECT coded_seq, 2 AS precursor_z, RT, n - 1 AS n_b, n - 1 AS n_y, 34 - (n - 1) AS n_padded, 'observed' AS dataset, 'hcd' AS frag_type, 30.0::DOUBLE AS nce FROM last_ones""",
)
def library_files_to_samples(t: Tables):
    """Of entries with one peptide and charge, in whichever of 50 files, the last one is the sample."""
    samples, _ = library_samples(t, 50)
    ions = lambda c: F.filter(F.element_at("ion_array", c), lambda v: v > 0)
    return samples.select(
        "coded_seq",
        "precursor_z",
        "RT",
        F.size(ions(1)).cast("bigint").alias("n_b"),
        F.size(ions(2)).cast("bigint").alias("n_y"),
        F.size(F.filter(F.element_at("ion_array", 1), lambda v: v < 0)).cast("bigint").alias("n_padded"),
        "dataset",
        "frag_type",
        "nce",
    )


@query(
    "library_file_rejections",
    f"""WITH {_OBSERVED} SELECT r.reason, count(o.reason) AS n FROM (VALUES ('length'), ('modification'), ('no ion'), ('kept')) r(reason)
LEFT JOIN observed o ON o.reason = r.reason GROUP BY r.reason""",
)
def library_file_rejections(t: Tables):
    """What the job counts while it writes the samples."""
    _, counts = library_samples(t, 5)
    return t.spark.createDataFrame(sorted(counts.items()), "reason string, n long")

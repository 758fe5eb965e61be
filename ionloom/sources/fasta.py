"""Protein FASTA files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ionloom.operators.frames import BROADCAST_BYTES, measured_bytes
from ionloom.session import stored

RECORD_SEPARATOR = "\n>"


def parse_records(records: DataFrame, *carried: Column) -> DataFrame:
    """(ProteinAccession, sequence) of raw records.

    Only the record that opens a file still has its '>'. Which one that is
    cannot be told from a split, so one leading '>' is removed everywhere.
    """
    body = F.regexp_replace("value", "^>", "")
    start = F.instr(body, "\n")
    rest = F.when(start > 0, F.substr(body, start + 1)).otherwise("")
    return records.where(F.length("value") > 0).select(
        F.regexp_replace(F.substring_index(body, "\n", 1), r"\s+$", "").alias("ProteinAccession"),
        F.regexp_replace(rest, "\\s*\n|\\s+$", "").alias("sequence"),
        *carried,
    )


def raw_records(reader) -> DataFrame:
    """Raw records of a (streaming) reader with the file and the split each comes from."""
    return reader.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def _seen_twice(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hashes of headers that occur more than once, and (file, hash) of what a file opens with where that is no record.

    Only hashes and places are kept of each record, and none of its sequence is moved.
    """
    heads = stored(placed.select(_name("ProteinAccession"), "file", "place", "opened"), "headers")
    repeated = heads.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
    first = F.min_by(F.struct("name", "opened"), "place").alias("first")
    opening = heads.where("place.block = 0").groupBy("file").agg(first)
    return stored(repeated, "repeated"), stored(opening.where("NOT first.opened").select("file", "first.name"), "stray")


def _name(header: str) -> Column:
    return F.unhex(F.md5(F.col(header).cast("binary"))).alias("name")


def proteins_of(records: DataFrame) -> DataFrame:
    """(ProteinAccession, sequence) of raw records.

    Text before a file's first '>' is no record, and a record without a header is
    dropped. Of records with one header the last one is kept, by file, then by
    position in the file.

    Records with a header of their own stay where they are. A first reading finds the
    headers that repeat, and what stands before a file's first record; only the records
    of these are brought together. If the repeated headers are too many to be broadcast,
    all records are.
    """
    place = F.struct("file", "block", F.monotonically_increasing_id().alias("row"))
    placed = records.select("value", "file", place.alias("place"), F.startswith("value", F.lit(">")).alias("opened"))
    parsed = parse_records(placed, *map(F.col, ("file", "place", "opened")))
    repeated, stray = _seen_twice(parsed)
    special = stored(repeated.union(stray.select("name")).distinct(), "special")
    named = parsed.withColumn("name", _name("ProteinAccession"))
    alone = named.where(F.length("ProteinAccession") > 0)
    if special.isEmpty():
        return alone.select("ProteinAccession", "sequence")
    few = measured_bytes(special) <= BROADCAST_BYTES
    together = stored(named.join(F.broadcast(special), "name", "left_semi"), "together") if few else named
    # the opening text is the first of all rows of its file, so also of those with its header
    firsts = together.join(stray, ["file", "name"], "left_semi").groupBy("file", "name").agg(F.min("place").alias("place"))
    together = together.join(firsts, ["file", "name", "place"], "left_anti").where(F.length("ProteinAccession") > 0)
    last = together.groupBy("ProteinAccession").agg(F.max_by("sequence", "place").alias("sequence"))
    if not few:
        return last
    alone = alone.join(F.broadcast(special), "name", "left_anti")
    return alone.select("ProteinAccession", "sequence").union(last)


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(ProteinAccession, sequence); see ``proteins_of``.

    The reader splits files at record boundaries, so a file of any size is read
    in parallel.
    """
    return proteins_of(raw_records(spark.read.option("lineSep", RECORD_SEPARATOR).text(path)))


def stream_fasta(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """FASTA files that arrive in a folder, as a stream of raw records for ``proteins_of``."""
    reader = spark.readStream.option("lineSep", RECORD_SEPARATOR)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return raw_records(reader.text(path))

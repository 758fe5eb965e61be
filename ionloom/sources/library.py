"""The spectral library as three Parquet tables; spectra are plain arrays to who reads them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from ionloom import constants as K
from ionloom.session import drop_folder
from ionloom.sources.blobs import PACKED, pack_arrays
from ionloom.sources.dlib import write_dlib
from ionloom.sources.ions import restore_mzs, store_ions
from ionloom.sources.schemas import LIBRARY_TABLES, table_schema


STORED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9"}     # whatever the session's settings are
ROWS_PER_FILE = 100_000     # of entries, some 6 MB in Parquet and 70 MB as library files
PIECE_BYTES = 64 << 20      # of a table's Parquet files that are exported as one piece, or a single larger file


def _path(base: str, table: str) -> str:
    return f"{base.rstrip('/')}/{table}"


def conform(df: DataFrame, table: str, packed: bool = False) -> DataFrame:
    """The columns of the table in order; a missing one is NULL, an unknown one an error."""
    schema = table_schema(table, packed)
    unknown = set(df.columns) - set(schema.names)
    if unknown:
        raise ValueError(f"columns not in {table}: {sorted(unknown)}")
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def create_library(spark: SparkSession, base: str, overwrite: bool = True) -> None:
    """Three empty tables and the version row."""
    mode = "overwrite" if overwrite else "errorifexists"
    for table in LIBRARY_TABLES:
        rows = [("version", K.LIBRARY_VERSION)] if table == "metadata" else []
        spark.createDataFrame(rows, table_schema(table, packed=False)).coalesce(1).write.mode(mode).parquet(
            _path(base, table)
        )


def as_stored(df: DataFrame, table: str) -> DataFrame:
    """The rows of a table as its files hold them."""
    rows = conform(df, table)
    names = table_schema(table, stored=True).names
    return store_ions(rows).select(*names) if "ions" in names else rows


def read_stored(spark: SparkSession, table: str, *paths: str) -> DataFrame:
    return spark.read.schema(table_schema(table, stored=True)).parquet(*paths)


def read_files(spark: SparkSession, table: str, *paths: str) -> DataFrame:
    """Explicit schema, so filters and columns reach the Parquet scan (but filters on m/z of peaks)."""
    rows = read_stored(spark, table, *paths)
    return restore_mzs(rows) if "ions" in rows.columns else rows


def write_stored(rows: DataFrame, table: str, path: str, mode: str = "errorifexists") -> None:
    """Write rows in the form of a table's files. Those of entries are bounded, so that a part of a table can be taken by files."""
    limit = {"maxRecordsPerFile": ROWS_PER_FILE} if table == "entries" else {}
    rows.write.mode(mode).options(**STORED, **limit).parquet(path)


def append_table(df: DataFrame, table: str, base: str) -> None:
    write_stored(as_stored(df, table), table, _path(base, table), "append")


def read_table(spark: SparkSession, base: str, table: str) -> DataFrame:
    return read_files(spark, table, _path(base, table))


def pack_entries(entries: DataFrame) -> DataFrame:
    """Replace the arrays of a spectrum by the four blob columns of a library file."""
    packed = entries.withColumn("_blob", pack_arrays(F.col("mzs"), F.col("intensities")))
    return packed.select(
        *[c for c in entries.columns if c not in ("mzs", "intensities")],
        *[F.col("_blob")[n].alias(n) for n in PACKED.names],
    )


def export_library(spark: SparkSession, base: str, path: str, overwrite: bool = True) -> None:
    """Write the Parquet library as library-file shards (entries, then the relation)."""
    write_dlib(pack_entries(read_table(spark, base, "entries")), path, "entries", overwrite)
    write_dlib(read_table(spark, base, "peptidetoprotein"), path, "peptidetoprotein", overwrite=False)


def _file_groups(spark: SparkSession, path: str, size: int) -> list[list[str]]:
    """The Parquet files of a folder in groups of about ``size`` bytes, a larger file alone."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    files = sorted((s.getPath().toString(), s.getLen()) for s in listed if not s.getPath().getName().startswith(("_", ".")))
    groups, held = [], size + 1
    for name, length in files:
        if held + length > size:
            groups.append([])
            held = 0
        groups[-1].append(name)
        held += length
    return groups


def export_pieces(spark: SparkSession, base: str, path: str, size: int = PIECE_BYTES) -> Iterator[tuple[str, str]]:
    """Library files of a whole Parquet library, piece by piece: (table, folder) of the entries, then of the relation.

    For who passes the files on as they come: those of a piece are deleted when the next one is asked for. Library
    files take some twelve times the disk of the Parquet files, and so only one piece of them is ever there.
    """
    for table in ("entries", "peptidetoprotein"):
        for n, files in enumerate(_file_groups(spark, _path(base, table), size)):
            rows, piece = read_files(spark, table, *files), f"{path.rstrip('/')}/{table}-{n:06d}"
            try:
                write_dlib(pack_entries(rows) if table == "entries" else rows, piece, table)
                yield table, piece
            finally:
                drop_folder(spark, piece)

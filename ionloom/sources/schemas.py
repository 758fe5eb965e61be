"""Explicit schemas of every table this package reads or writes."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    BooleanType,
    DoubleType,
    FloatType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

TYPES = {
    "string": StringType(),
    "double": DoubleType(),
    "int": IntegerType(),
    "boolean": BooleanType(),
    "binary": BinaryType(),
    "doubles": ArrayType(DoubleType()),
    "floats": ArrayType(FloatType()),
}

METADATA = "Key string, Value string"
ENTRIES = (
    "PrecursorMz double, PrecursorCharge int, PeptideModSeq string, PeptideSeq string, "
    "Copies int, RTInSeconds double, Score double, "
    "MassEncodedLength int, MassArray binary, IntensityEncodedLength int, IntensityArray binary, "
    "CorrelationEncodedLength int, CorrelationArray binary, "
    "RTInSecondsStart double, RTInSecondsStop double, "
    "MedianChromatogramEncodedLength int, MedianChromatogramArray binary, SourceFile string"
)
PEPTIDE_TO_PROTEIN = "PeptideSeq string, isDecoy boolean, ProteinAccession string"
LIBRARY_TABLES = {
    "metadata": METADATA,
    "entries": ENTRIES,
    "peptidetoprotein": PEPTIDE_TO_PROTEIN,
}
# In Parquet a spectrum is a pair of arrays; it is packed only for a library file.
BLOBS = "MassEncodedLength int, MassArray binary, IntensityEncodedLength int, IntensityArray binary"
PARQUET_TABLES = {**LIBRARY_TABLES, "entries": ENTRIES.replace(BLOBS, "mzs doubles, intensities floats")}
# On disk most m/z are bits (see ``sources.ions``); files without that column are read too.
STORED_TABLES = {**PARQUET_TABLES, "entries": ENTRIES.replace(BLOBS, "ions binary, mzs doubles, intensities floats")}
RT_TABLE = "PeptideModSeq string, HI double, Source string"
SAMPLES = (
    "coded_seq string, peptide_mod_seq string, precursor_z int, ion_array array<array<float>>, "
    "RT double, dataset string, frag_type string, nce double"
)


def struct(columns: str) -> StructType:
    """Schema of plain columns; worked out without a session, so tasks can use it too."""
    pairs = (column.split() for column in columns.split(","))
    return StructType([StructField(name, TYPES[kind]) for name, kind in pairs])


def table_schema(table: str, packed: bool = True, stored: bool = False) -> StructType:
    """Columns of a table in a library file (``packed``), as a Parquet library gives it, or as its files hold it (``stored``)."""
    if table not in LIBRARY_TABLES:
        raise ValueError(f"unknown library table {table!r}; known: {sorted(LIBRARY_TABLES)}")
    return struct((STORED_TABLES if stored else LIBRARY_TABLES if packed else PARQUET_TABLES)[table])

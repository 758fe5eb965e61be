"""Spectra as the compressed arrays of a library file, packed and unpacked in Arrow batches.

Numbers are converted for a whole batch at once; only zlib is called per spectrum.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    DoubleType,
    FloatType,
    IntegerType,
    StructField,
    StructType,
)

MZ_DTYPE, INTENSITY_DTYPE = ">f8", ">f4"  # big-endian
PACKED = StructType(
    [
        StructField("MassEncodedLength", IntegerType()),
        StructField("MassArray", BinaryType()),
        StructField("IntensityEncodedLength", IntegerType()),
        StructField("IntensityArray", BinaryType()),
    ]
)
UNPACKED = StructType(
    [
        StructField("mzs", ArrayType(DoubleType())),
        StructField("intensities", ArrayType(FloatType())),
    ]
)


def _compress(data: memoryview) -> bytes:
    packer = zlib.compressobj()  # cheaper than zlib.compress for a few hundred bytes
    return packer.compress(data) + packer.flush()


def _pack(lists: pa.ListArray, dtype: str) -> tuple[pa.Array, pa.Array]:
    """(uncompressed byte lengths, compressed arrays) of a list array."""
    width = np.dtype(dtype).itemsize
    ends = lists.offsets.to_numpy().astype("int64") * width
    values = lists.values.to_numpy(zero_copy_only=False).astype(dtype)
    data = memoryview(values.tobytes())
    missing = np.asarray(lists.is_null())
    blobs = [
        None if gone else _compress(data[a:b]) for gone, a, b in zip(missing, ends[:-1], ends[1:])
    ]
    return pa.array(np.diff(ends), pa.int32(), mask=missing), pa.array(blobs, pa.binary())


@arrow_udf(PACKED)
def _pack_arrays(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for mzs, intensities in parts:
        columns = [*_pack(mzs, MZ_DTYPE), *_pack(intensities, INTENSITY_DTYPE)]
        yield pa.StructArray.from_arrays(columns, names=PACKED.names)


def pack_arrays(mzs: Column, intensities: Column) -> Column:
    """struct of the four blob columns."""
    return _pack_arrays.asNondeterministic()(mzs, intensities)  # evaluated once, never copied


def pack_peaks(peaks: Column) -> Column:
    """The same for an array of (mz, intensity)."""
    return pack_arrays(peaks["mz"], peaks["intensity"])


def _unpack(lengths: pa.Array, blobs: pa.Array, dtype: str, out: str) -> pa.ListArray:
    missing = np.asarray(blobs.is_null())
    raw = [
        b"" if gone else zlib.decompress(blob)[: int(n)]
        for gone, blob, n in zip(missing, blobs.to_pylist(), lengths.to_pylist())
    ]
    width = np.dtype(dtype).itemsize
    ends = np.cumsum([0, *[len(r) // width for r in raw]]).astype("int32")
    values = np.frombuffer(b"".join(raw), dtype).astype(out)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=pa.array(missing))


@arrow_udf(UNPACKED)
def _unpack_arrays(
    parts: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]],
) -> Iterator[pa.Array]:
    for mass_n, mass, intensity_n, intensity in parts:
        columns = [
            _unpack(mass_n, mass, MZ_DTYPE, "float64"),
            _unpack(intensity_n, intensity, INTENSITY_DTYPE, "float32"),
        ]
        yield pa.StructArray.from_arrays(columns, names=UNPACKED.names)


def unpack_arrays() -> Column:
    """struct(mzs, intensities) of the four blob columns of an entries table."""
    return _unpack_arrays.asNondeterministic()(
        "MassEncodedLength", "MassArray", "IntensityEncodedLength", "IntensityArray"
    )


def as_peaks(arrays: Column) -> Column:
    return F.zip_with(
        arrays["mzs"],
        arrays["intensities"],
        lambda m, i: F.struct(m.alias("mz"), i.alias("intensity")),
    )

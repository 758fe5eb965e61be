"""How the Parquet library stores the m/z of a spectrum: as one bit for each ion that its peptide can have.

Most of a spectrum's bytes are its m/z, which hardly compress, but those of a predicted spectrum follow from the
modified sequence and the charge. ``ions`` says which cells of b1, y1, b2, y2 are peaks, and reading computes their
m/z by the step that made them. An entry whose m/z are not exactly, in all bits, those of its ladder keeps them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, BinaryType, DoubleType

from ionloom.operators.assembly import BATCH_SIZE, ion_masses, ion_mz

# what the ladder is computed for; other texts, say with names for modifications, keep their m/z
_DELTA = r"(\[[+-]?[0-9]{1,6}(\.[0-9]{1,9})?\])?"
_PLAIN = f"^{_DELTA}([A-Z]{_DELTA})+$"


def _cells(modseqs: pa.Array, charges: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(m/z [n, 136] with 0 where there is no ion, which cells are ions)."""
    masses, possible = ion_masses(modseqs, charges.to_numpy(zero_copy_only=False))
    mz = np.zeros(possible.shape)
    mz[possible] = ion_mz(masses, possible)
    return mz.reshape(len(mz), -1), possible.reshape(len(mz), -1)


def _bit_places(possible: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each row and one more, bit of each possible cell), every row beginning a byte."""
    counts = possible.sum(axis=1)
    starts = np.concatenate([[0], np.cumsum((counts + 7) // 8)])
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return starts, np.repeat(starts[:-1] * 8, counts) + inside


def _found(mz: np.ndarray, possible: np.ndarray, values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cells whose m/z are the values of each row, in order; rows of which no value is left)."""
    wanted = np.concatenate([values, [np.nan]]).view("int64")   # one more, which no cell is
    cells, real = np.ascontiguousarray(mz.T).view("int64"), np.ascontiguousarray(possible.T)
    found, at = np.zeros(cells.shape, bool), begin.copy()
    for row, ions, hits in zip(cells, real, found):
        hits[:] = ions & (at < end) & (wanted[np.minimum(at, len(values))] == row)
        at += hits
    return found.T, at == end


@arrow_udf(BinaryType())
def _ladder_ions(modseqs: pa.Array, charges: pa.Array, mzs: pa.Array) -> pa.Array:
    usable = pc.fill_null(pc.match_substring_regex(modseqs, _PLAIN), False)
    usable = pc.and_(usable, pc.and_(charges.is_valid(), mzs.is_valid()))
    kept = usable.to_numpy(zero_copy_only=False)
    values, offsets = mzs.values.to_numpy(zero_copy_only=False), mzs.offsets.to_numpy().astype("int64")
    begin, end = offsets[:-1][kept], offsets[1:][kept]
    modseqs, charges = modseqs.filter(usable), charges.filter(usable)
    blobs: list[bytes | None] = []
    for i in range(0, len(modseqs), BATCH_SIZE):
        mz, possible = _cells(modseqs.slice(i, BATCH_SIZE), charges.slice(i, BATCH_SIZE))
        found, whole = _found(mz, possible, values, begin[i : i + BATCH_SIZE], end[i : i + BATCH_SIZE])
        starts, bits = _bit_places(possible)
        flags = np.zeros(starts[-1] * 8, bool)
        flags[bits] = found[possible]
        data = np.packbits(flags).tobytes()
        blobs += [data[a:b] if ok else None for a, b, ok in zip(starts[:-1], starts[1:], whole)]
    rows = np.full(len(kept), None, object)
    rows[kept] = np.array([*blobs, None], object)[:-1]
    return pa.array(rows, pa.binary())


@arrow_udf(ArrayType(DoubleType()))
def _ladder_mzs(modseqs: pa.Array, charges: pa.Array, ions: pa.Array) -> pa.Array:
    usable = ions.is_valid()
    kept = usable.to_numpy(zero_copy_only=False)
    modseqs, charges, blobs = modseqs.filter(usable), charges.filter(usable), ions.filter(usable)
    values, counts = [np.zeros(0)], np.zeros(len(kept), "int64")
    sizes = [np.zeros(0, "int64")]
    for i in range(0, len(modseqs), BATCH_SIZE):
        z = charges.slice(i, BATCH_SIZE).to_numpy(zero_copy_only=False)
        masses, possible = ion_masses(modseqs.slice(i, BATCH_SIZE), z)
        flags = np.unpackbits(np.frombuffer(b"".join(blobs.slice(i, BATCH_SIZE).to_pylist()), "uint8"))
        chosen = possible.copy()
        chosen[possible] = flags[_bit_places(possible.reshape(len(z), -1))[1]] > 0
        values.append(ion_mz(masses, chosen))
        sizes.append(chosen.sum(axis=(1, 2)))
    counts[kept] = np.concatenate(sizes)
    ends = np.concatenate([[0], np.cumsum(counts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values), pa.float64()), mask=pa.array(~kept))


def ladder_ions(modseq: Column | str, charge: Column | str, mzs: Column | str) -> Column:
    """The bits of the ions that are peaks; NULL where the m/z are not those of the ladder."""
    return _ladder_ions.asNondeterministic()(modseq, charge, mzs)   # evaluated once, never copied


def ladder_mzs(modseq: Column | str, charge: Column | str, ions: Column | str) -> Column:
    """The m/z of which ``ladder_ions`` made bits."""
    return _ladder_mzs(modseq, charge, ions)


def store_ions(entries: DataFrame) -> DataFrame:
    """Entries with ``ions`` in the place of the m/z, where they give them."""
    known = entries.withColumn("ions", ladder_ions("PeptideModSeq", "PrecursorCharge", "mzs"))
    return known.withColumn("mzs", F.when(F.col("ions").isNull(), F.col("mzs")))


def restore_mzs(stored: DataFrame) -> DataFrame:
    """Entries with all their m/z. They are computed only where the column is read."""
    known = ladder_mzs("PeptideModSeq", "PrecursorCharge", "ions")
    return stored.withColumn("mzs", F.when(F.col("ions").isNull(), F.col("mzs")).otherwise(known)).drop("ions")

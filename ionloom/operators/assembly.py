"""Scoring precursors and assembling their spectra in Arrow batches.

The same steps exist as column expressions (``functions.masses.ladder_matrix``,
``functions.spectra``); those are interpreted cell by cell. A model is called
from Python anyway, so the cells it predicts are normalised, trimmed and paired
with their m/z there, and only real peaks travel back to the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from ionloom import constants as K
from ionloom.functions.expr import col
from ionloom.functions.masses import PHOSPHO_SYMBOLS, PHOSPHO_WINDOW_NANO

BATCH_SIZE = 2048
SPECTRUM = StructType(
    [StructField("mzs", ArrayType(DoubleType())), StructField("intensities", ArrayType(FloatType()))]
)
_OPEN, _CLOSE = ord("["), ord("]")
_PHOSPHO = np.frombuffer(PHOSPHO_SYMBOLS.encode(), "uint8")


def _table(values: dict[str, int]) -> np.ndarray:
    table = np.zeros(256, "int64")
    for symbol, value in values.items():
        table[ord(symbol)] = value
    return table


_CODES, _NANO = _table(K.SYMBOL_CODES), _table(K.RESIDUE_NANO)
_CODED, _WEIGHED = (_table(dict.fromkeys(t, 1)) > 0 for t in (K.SYMBOL_CODES, K.RESIDUE_NANO))


def unknown(data: np.ndarray, starts: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which texts hold a symbol that is not known; their codes and masses mean nothing."""
    wrong = np.concatenate([[0], np.cumsum(~known[data])])
    return wrong[starts[1:]] > wrong[starts[:-1]]


def uncoded(coded: pa.Array) -> np.ndarray:
    """Which coded sequences hold a symbol without a code."""
    return unknown(*_bytes(coded), _CODED)


def unweighed(modseqs: pa.Array) -> np.ndarray:
    """Which modified sequences hold a residue without a mass."""
    data, starts = _bytes(modseqs)
    inside = np.cumsum(data == _OPEN) - np.cumsum(data == _CLOSE) > 0
    known = _WEIGHED[data] | inside | (data == _CLOSE)
    wrong = np.concatenate([[0], np.cumsum(~known)])
    return wrong[starts[1:]] > wrong[starts[:-1]]


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All characters of a string array, and where each text starts and ends."""
    texts = texts.cast(pa.large_string())
    starts = np.frombuffer(texts.buffers()[1], "int64")[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", "uint8")[starts[0] : starts[-1]]
    return data, starts - starts[0]


def code_matrix(coded: pa.Array) -> np.ndarray:
    """Integer codes [n, 37] of coded sequences."""
    data, starts = _bytes(coded)
    out = np.zeros((len(coded), K.MAX_CODED_LEN), "int64")
    out[np.arange(K.MAX_CODED_LEN) < np.diff(starts)[:, None]] = _CODES[data]
    return out


def _residues(modseqs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first residue of each text and one more, symbols, masses with modifications, modification of each residue itself)."""
    data, starts = _bytes(modseqs)
    opened, closed = data == _OPEN, data == _CLOSE
    inside = np.cumsum(opened) - np.cumsum(closed) > 0
    residue = ~(inside | closed)
    before = np.concatenate([[0], np.cumsum(residue)])  # residues before each character
    first = before[starts]                              # first residue of each text
    symbols = data[residue]
    values, site_delta = _NANO[symbols], np.zeros(len(symbols), "int64")

    begins, ends = np.flatnonzero(opened), np.flatnonzero(closed)
    if len(begins):
        raw = data.tobytes()
        texts = [raw[a + 1 : b] for a, b in zip(begins, ends)]
        known = {t: K.nano(float(t)) for t in set(texts)}  # few distinct deltas
        deltas = np.array([known[t] for t in texts], "int64")
        owner = np.searchsorted(starts, begins, side="right") - 1
        at_start = before[begins] == first[owner]
        start_delta = np.zeros(len(modseqs), "int64")
        # a later modification of the same site replaces the earlier one
        site_delta[before[begins[~at_start]] - 1] = deltas[~at_start]
        start_delta[owner[at_start]] = deltas[at_start]
        values = values + site_delta
        some = np.diff(first) > 0
        values[first[:-1][some]] += start_delta[some]
    return first, symbols, values, site_delta


def residue_sums(modseqs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(first residue of each text and one more, running masses of all residues from 0) in nano-daltons."""
    first, _, values, _ = _residues(modseqs)
    return first, np.concatenate([[0], np.cumsum(values)])


def _mask(values: pa.Array) -> pa.Array:
    return pc.fill_null(values, False)


def renamed(modseqs: pa.Array) -> pa.Array:
    """``functions.encoding.rename_mods`` for a batch: a rule runs only over a batch that holds its modification."""
    out = modseqs
    for residue, prefix, symbol in K.CODED_MODS:
        if pc.any(pc.match_substring(out, f"{residue}[{prefix}")).as_py():
            out = pc.replace_substring_regex(out, K.coded_mod_pattern(residue, prefix), symbol)
    return out


def coded(modseqs: pa.Array) -> pa.Array:
    """``functions.encoding.coded_sequence`` for a batch; NULL if a modification is unknown."""
    texts = renamed(modseqs)
    start = pa.array(["-"] * len(texts), texts.type)
    for residue, symbol in K.NTERM_RESIDUE_TOKENS.items():
        start = pc.if_else(_mask(pc.starts_with(texts, residue)), pa.scalar(symbol, texts.type), start)
    opened = _mask(pc.starts_with(texts, "["))
    body = texts
    if pc.any(opened).as_py():
        start = pc.if_else(opened, pa.scalar(None, texts.type), start)
        for prefix, symbol in K.NTERM_TOKENS.items():
            start = pc.if_else(_mask(pc.starts_with(texts, f"[{prefix}")), pa.scalar(symbol, texts.type), start)
        body = pc.if_else(opened, pc.replace_substring_regex(texts, r"^[^\]]*\]", ""), texts)
    whole = pc.binary_join_element_wise(start, body, pa.scalar("_", texts.type), pa.scalar("", texts.type))
    return pc.if_else(_mask(pc.match_substring(whole, "[")), pa.scalar(None, texts.type), whole)


@arrow_udf(StringType())
def renamed_texts(modseqs: pa.Array) -> pa.Array:
    """Modified sequences with one-letter symbols, without terminal tokens."""
    return renamed(modseqs)


@arrow_udf(StringType())
def coded_texts(modseqs: pa.Array) -> pa.Array:
    """Coded sequences of modified ones."""
    return coded(modseqs)


@arrow_udf(ArrayType(IntegerType()))
def code_arrays(texts: pa.Array) -> pa.Array:
    """``functions.encoding.integer_codes`` for a batch: symbols as 1..44, at least 37 places, NULL for an unknown symbol."""
    none = texts.is_null().to_numpy(zero_copy_only=False)
    data, starts = _bytes(texts.fill_null(""))
    width = np.maximum(np.diff(starts), K.MAX_CODED_LEN)
    ends = np.concatenate([[0], np.cumsum(width)])
    codes, unknown_symbol = np.zeros(ends[-1], "int32"), np.zeros(ends[-1], bool)
    place = np.arange(len(data)) + np.repeat(ends[:-1] - starts[:-1], np.diff(starts))
    codes[place], unknown_symbol[place] = _CODES[data], ~_CODED[data]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(codes, mask=unknown_symbol), mask=pa.array(none))


@arrow_udf(LongType())
def mass_nano(modseqs: pa.Array) -> pa.Array:
    """``functions.masses.peptide_mass_nano`` for a batch; NULL with a residue without a mass."""
    none = modseqs.is_null().to_numpy(zero_copy_only=False)
    texts = modseqs.fill_null("")
    first, sums = residue_sums(texts)
    return pa.array(sums[first[1:]] - sums[first[:-1]] + K.WATER_NANO, pa.int64(), mask=none | unweighed(texts))


TOTALS = StructType([StructField(n, LongType()) for n in ("n", "positive", "zero", "micro")])


def _totals(cells: pa.Array) -> dict[str, pa.Array]:
    ends = cells.offsets.to_numpy().astype("int64")
    values = cells.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype("float64")
    ends = ends - ends[0]

    def totals(x: np.ndarray) -> pa.Array:
        sums = np.concatenate([[0], np.cumsum(x, dtype="int64")])
        return pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64())

    micro = totals(np.floor(values * 1e6 + 0.5).astype("int64"))
    return {"n": pa.array(np.diff(ends)), "positive": totals(values > 0), "zero": totals(values == 0), "micro": micro}


@arrow_udf(TOTALS)
def array_totals(cells: pa.Array) -> pa.Array:
    """Of each array of numbers: how many it holds, how many are positive or 0, and the sum of all in whole millionths.

    Applied to what another function of this module gives, it runs in the same Python call and no array travels.
    """
    found = _totals(cells)
    return pa.StructArray.from_arrays(list(found.values()), names=list(found), mask=cells.is_null())


SPECTRUM_TOTALS = StructType([StructField(n, LongType()) for n in ("n_peaks", "mz_micro", "intensity_micro")])


@arrow_udf(SPECTRUM_TOTALS)
def spectrum_totals(spectra: pa.Array) -> pa.Array:
    """Of each spectrum: its number of peaks, and the sums of m/z and of intensities in whole millionths."""
    mzs, intensities = _totals(spectra.field("mzs")), _totals(spectra.field("intensities"))
    columns = [mzs["n"], mzs["micro"], intensities["micro"]]
    return pa.StructArray.from_arrays(columns, names=SPECTRUM_TOTALS.names, mask=spectra.is_null())


LADDER = StructType([StructField("b", ArrayType(LongType())), StructField("y", ArrayType(LongType()))])


@arrow_udf(LADDER)
def ladder_arrays(modseqs: pa.Array) -> pa.Array:
    """struct(b, y) as ``functions.masses.ladder_nano`` gives it, for a batch of peptides of any length.

    NULL, and a residue without a mass, give NULL.
    """
    none = modseqs.is_null().to_numpy(zero_copy_only=False)
    texts = modseqs.fill_null("")
    first, sums = residue_sums(texts)
    n_ions = np.maximum(np.diff(first) - 1, 0)
    starts = np.concatenate([[0], np.cumsum(n_ions)])
    owner = np.repeat(np.arange(len(texts)), n_ions)
    ion = np.arange(starts[-1]) - starts[owner]
    b = sums[first[owner] + ion + 1] - sums[first[owner]]
    whole = sums[first[1:]] - sums[first[:-1]] + K.WATER_NANO
    y = whole[owner] - b[starts[owner] + n_ions[owner] - 1 - ion]
    offsets = pa.array(starts.astype("int32"))
    series = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (b, y)]
    return pa.StructArray.from_arrays(series, names=["b", "y"], mask=pa.array(none | unweighed(texts)))


ION_TOTALS = StructType(
    [StructField("ion_type", StringType()), StructField("ordinal", IntegerType()), StructField("frag_z", IntegerType())]
    + [StructField(n, LongType()) for n in ("n", "mz_micro")]
)


def sums_by(places: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of whole numbers at each of ``size`` places."""
    if len(values) == 0 or float(np.abs(values).max()) * len(values) < 2**53:  # doubles hold every partial sum
        return np.bincount(places, values, size).astype("int64")
    out = np.zeros(size, "int64")
    np.add.at(out, places, values)
    return out


def ion_totals(
    batches: Iterator[pa.RecordBatch], max_fragment_z: int, losses: bool, batch_size: int = BATCH_SIZE
) -> Iterator[pa.RecordBatch]:
    """Partial totals of ions: how many of each type, ordinal and charge, and the sum of their m/z in whole millionths.

    Batches hold modified sequences and the largest charge of their ions. No ion travels.
    A sequence that is NULL or has a residue without a mass has no ions.
    """
    names = ION_TOTALS.names
    for batch in batches:
        for modseqs, charges in _chunks(tuple(batch.columns), batch_size):
            usable = pc.and_(modseqs.is_valid(), pc.greater_equal(charges, 1))
            modseqs, charges = modseqs.filter(usable), charges.filter(usable)
            weighed = pa.array(~unweighed(modseqs), pa.bool_())
            modseqs, z = modseqs.filter(weighed), charges.filter(weighed).to_numpy(zero_copy_only=False)
            first, symbols, values, site_delta = _residues(modseqs)
            sums = np.concatenate([[0], np.cumsum(values)])
            n_ions = np.maximum(np.diff(first) - 1, 0)
            begin, end = np.repeat(first[:-1], n_ions), np.repeat(first[1:], n_ions)
            ion = np.arange(len(begin)) - np.repeat(np.cumsum(n_ions) - n_ions, n_ions)
            whole = np.repeat(sums[first[1:]] - sums[first[:-1]] + K.WATER_NANO, n_ions)
            b = sums[begin + ion + 1] - sums[begin]
            y = whole - (sums[end - ion - 1] - sums[begin])
            series = [("b", b, ion, np.repeat(z, n_ions)), ("y", y, ion, np.repeat(z, n_ions))]
            if losses:
                sites = np.concatenate([[0], np.cumsum(phosphosites(symbols, site_delta))])
                for kind, masses, places, most in series[:2]:
                    some = (sites[begin + ion + 1] > sites[begin]) if kind == "b" else (sites[end] > sites[end - ion - 1])
                    series.append((f"{kind}-PO4", masses[some] - K.PHOSPHO_NANO, places[some], most[some]))
            size = int(n_ions.max(initial=0))
            for kind, masses, places, most in series:
                for k in range(1, max_fragment_z + 1):
                    possible = most >= k
                    here = places[possible]
                    counts = np.bincount(here, minlength=size)
                    mz = (masses[possible] / float(K.NANO) + k * K.PROTON_MASS) / k
                    micro = sums_by(here, np.floor(mz * 1e6 + 0.5).astype("int64"), size)
                    found = np.flatnonzero(counts)
                    if len(found):
                        columns = [
                            pa.array([kind] * len(found)),
                            pa.array(found + 1, pa.int32()),
                            pa.array([k] * len(found), pa.int32()),
                            pa.array(counts[found], pa.int64()),
                            pa.array(micro[found], pa.int64()),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, names=names)


def phosphosites(symbols: np.ndarray, site_delta: np.ndarray) -> np.ndarray:
    """Which residues hold a phosphate, by their symbol or their modification."""
    return np.isin(symbols, _PHOSPHO) | (np.abs(site_delta - K.PHOSPHO_NANO) < PHOSPHO_WINDOW_NANO)


def ladder_cells(modseq: Column | str, charge: Column | str, max_fragment_z: int = 2) -> Column:
    """``functions.masses.ladder_matrix`` as one flat array: rows b1, y1, b2, y2, ..., those above the charge 0.

    NULL, and a residue without a mass, give NULL.
    """

    @arrow_udf(ArrayType(DoubleType()))
    def cells(modseqs: pa.Array, charges: pa.Array) -> pa.Array:
        none = (modseqs.is_null() if charges.null_count == 0 else pc.or_(modseqs.is_null(), charges.is_null())).to_numpy(zero_copy_only=False)
        texts, z = modseqs.fill_null(""), charges.fill_null(0).to_numpy(zero_copy_only=False)
        first, sums = residue_sums(texts)
        n_ions = np.maximum(np.diff(first) - 1, 0)
        width = n_ions * 2 * max_fragment_z
        ends = np.concatenate([[0], np.cumsum(width)])
        owner = np.repeat(np.arange(len(texts)), n_ions)
        ion = np.arange(len(owner)) - np.repeat(np.cumsum(n_ions) - n_ions, n_ions)
        b = sums[first[owner] + ion + 1] - sums[first[owner]]
        # y is the whole without the prefix that ends where it starts
        y = (sums[first[1:]] - sums[first[:-1]] + K.WATER_NANO)[owner] - (sums[first[owner] + n_ions[owner] - ion] - sums[first[owner]])
        out = np.zeros(ends[-1])
        for k in range(1, max_fragment_z + 1):
            possible = z[owner] >= k
            for row, masses in enumerate((b, y)):
                place = ends[owner] + (2 * (k - 1) + row) * n_ions[owner] + ion
                out[place[possible]] = (masses[possible] / float(K.NANO) + k * K.PROTON_MASS) / k
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out), mask=pa.array(none | unweighed(texts)))

    return cells(col(modseq), col(charge).cast("int"))


def prefix_masses(modseqs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, b masses [n, 34] padded with 0, whole masses) in nano-daltons."""
    first, sums = residue_sums(modseqs)
    lengths = np.diff(first)
    ions = np.arange(1, K.MAX_IONS + 1)
    real = ions < lengths[:, None]
    b = np.where(real, sums[np.minimum(first[:-1, None] + ions, len(sums) - 1)] - sums[first[:-1], None], 0)
    return lengths, b, sums[first[1:]] - sums[first[:-1]] + K.WATER_NANO


CHANNEL_CHARGES = np.array([1, 1, 2, 2])[None, :, None]


def ion_masses(modseqs: pa.Array, charge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(neutral masses [n, 4, 34], which cells are ions) of the channels b1, y1, b2, y2."""
    lengths, b, whole = prefix_masses(modseqs)
    ions = np.arange(K.MAX_IONS)
    real = ions < (lengths - 1)[:, None]
    mirrored = np.clip(lengths[:, None] - 2 - ions, 0, K.MAX_IONS - 1)
    y = whole[:, None] - np.take_along_axis(b, mirrored, axis=1)
    possible = real[:, None, :] & (CHANNEL_CHARGES <= charge[:, None, None])
    return np.stack([b, y, b, y], axis=1), possible


def ion_mz(masses: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """m/z of the chosen cells, row by row."""
    z = np.broadcast_to(CHANNEL_CHARGES, masses.shape)[cells]
    return (masses[cells] / float(K.NANO) + z * K.PROTON_MASS) / z


def normalise_cells(predicted: np.ndarray) -> np.ndarray:
    """Clamp at 0 and divide by the largest of each row; all 0 without one."""
    cells = np.maximum(np.asarray(predicted, "float32").reshape(len(predicted), -1), 0)
    top = cells.max(axis=1, keepdims=True)
    cells /= np.where(top > 0, top, 1)
    return cells.reshape(len(predicted), K.N_CHANNELS, K.MAX_IONS)


def _chunks(arrays: tuple[pa.Array, ...], size: int) -> Iterator[tuple[pa.Array, ...]]:
    for start in range(0, len(arrays[0]), size):
        yield tuple(a.slice(start, size) for a in arrays)


def _once(make_model: Callable) -> Callable:
    """A function that makes the model when a task first asks for it."""
    made = []

    def load():
        if not made:
            made.append(make_model())
        return made[0]

    return load


def score_coded(make_model: Callable, coded: Column | str, batch_size: int = BATCH_SIZE) -> Column:
    """Retention time of coded sequences, encoded and scored in one pass; NULL with an unknown symbol."""

    @arrow_udf(DoubleType())
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predict = make_model()
        for texts in parts:
            values = [
                np.asarray(predict(code_matrix(chunk)), "float64").reshape(-1)
                for (chunk,) in _chunks((texts,), batch_size)
            ]
            none = uncoded(texts)
            yield pa.array(np.concatenate(values) if values else [], pa.float64(), mask=none if values else None)

    return score.asNondeterministic()(col(coded))  # evaluated once, never copied


def _predicted_cells(predict: Callable, texts: pa.Array, z: np.ndarray, energy: pa.Array | None) -> np.ndarray:
    """Normalised cells [n, 4, 34] that a model gives coded sequences."""
    hot = (z[:, None] == np.arange(K.MIN_PRECURSOR_CHARGE, K.MAX_PRECURSOR_CHARGE + 1)).astype("float32")
    inputs = [code_matrix(texts), hot]
    if energy is not None:
        inputs.append(energy.to_numpy(zero_copy_only=False).astype("float32"))
    return normalise_cells(predict(*inputs))


def predicted_cells(
    make_model: Callable, coded: Column | str, charge: Column | str, nce: Column | str | None = "nce", batch_size: int = BATCH_SIZE
) -> Column:
    """Normalised intensities of one precursor, trimmed to the ions that its peptide has, flat (b1, y1, b2, y2).

    ``make_model()`` is as for ``predicted_spectrum``. A sequence with an unknown symbol gives NULL.
    """
    with_energy, load = nce is not None, _once(make_model)

    @arrow_udf(ArrayType(FloatType()))
    def score(coded: pa.Array, charges: pa.Array, energies: pa.Array) -> pa.Array:
        predict = load()
        values, counts = [np.zeros(0, "float32")], []
        for texts, z, energy in _chunks((coded, charges, energies), batch_size):
            z = z.to_numpy(zero_copy_only=False)
            cells = _predicted_cells(predict, texts, z, energy if with_energy else None)
            n_ions = np.maximum(np.diff(_bytes(texts)[1]) - 3, 0)   # two of the symbols are terminal tokens
            real = np.broadcast_to(np.arange(K.MAX_IONS) < n_ions[:, None, None], cells.shape)
            values.append(cells[real])
            counts.append(K.N_CHANNELS * n_ions)
        ends = pa.array(np.cumsum(np.concatenate([[0], *counts])), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(values), pa.float32()), mask=pa.array(uncoded(coded)))

    energy = F.lit(0.0) if nce is None else col(nce).cast("double")
    return score.asNondeterministic()(col(coded), col(charge).cast("int"), energy)


def predicted_spectrum(
    make_model: Callable,
    coded: Column | str,
    modseq: Column | str,
    charge: Column | str,
    nce: Column | str | None = "nce",
    threshold: float = K.MIN_INTENSITY,
    batch_size: int = BATCH_SIZE,
) -> Column:
    """struct(mzs, intensities) of one precursor: the peaks the model gives it.

    A sequence with an unknown residue gives NULL, as in the column form.
    ``make_model()`` returns ``predict(codes[n, 37], charge[n, 6], nce[n])`` (no
    ``nce`` for trap fragmentation) -> [n, 4 * 34].
    """

    with_energy, load = nce is not None, _once(make_model)

    @arrow_udf(SPECTRUM)
    def assemble(coded: pa.Array, modseqs: pa.Array, charges: pa.Array, energies: pa.Array) -> pa.Array:
        predict = load()
        mzs, intensities, counts = [], [], []
        for texts, mods, z, energy in _chunks((coded, modseqs, charges, energies), batch_size):
            z = z.to_numpy(zero_copy_only=False)
            cells = _predicted_cells(predict, texts, z, energy if with_energy else None)
            masses, possible = ion_masses(mods, z)
            kept = possible & (cells >= np.float32(threshold))
            mzs.append(ion_mz(masses, kept))
            intensities.append(cells[kept])
            counts.append(kept.sum(axis=(1, 2)))
        offsets = pa.array(np.cumsum(np.concatenate([[0], *counts])).astype("int32"), pa.int32())
        lists = [
            pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([[], *mzs]), pa.float64())),
            pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, "float32"), *intensities]), pa.float32())),
        ]
        none = pa.array(uncoded(coded) | unweighed(modseqs))
        return pa.StructArray.from_arrays(lists, names=["mzs", "intensities"], mask=none)

    energy = F.lit(0.0) if nce is None else col(nce).cast("double")
    return assemble.asNondeterministic()(col(coded), col(modseq), col(charge).cast("int"), energy)

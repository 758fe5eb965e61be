"""Peptides of many cleavage rules counted per protein, in Arrow batches.

``functions.peptides.digest`` gives the peptides themselves. Where only their number and
size are asked, for every rule of a table, no peptide has to be made: rules become flags
between residues, and peptides are told apart by their residues packed into whole numbers.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ionloom import constants as K
from ionloom.functions.expr import col
from ionloom.operators.assembly import _bytes, sums_by

CHUNK = 1 << 18             # symbols that are looked at together; a longer protein is a chunk of its own
PACKED = 12                 # residues of five bits in a word of 64
_OTHER, _LINE_END, _BETWEEN = 0x80, 0x85, 0xFF     # any other symbol; line ends beyond ASCII; between proteins
_MARGIN = 8                 # no rule looks farther

FOUND = ArrayType(
    StructType([StructField("protease", StringType()), StructField("n_peptides", LongType()), StructField("n_residues", LongType())])
)
_SIDES = re.compile(r"\(\?<=(.*?)\)\(\?=(.*?)\)(?:\||$)")
_SYMBOL = re.compile(r"(\[\^?[^\]]+\]|\\w|\.|[A-Z])(?:\{(\d+)\})?")


def _known(symbol: str) -> np.ndarray:
    """Which codes a symbol of a rule stands for."""
    if symbol == ".":
        table = np.ones(256, bool)
        table[[ord("\n"), ord("\r"), _LINE_END]] = False
    elif symbol == r"\w":
        table = np.array([c < 128 and (chr(c).isalnum() or c == ord("_")) for c in range(256)])
    else:
        letters = symbol.strip("[]").removeprefix("^")
        table = np.isin(np.arange(256), [ord(c) for c in letters]) != symbol.startswith("[^")
    table[_BETWEEN] = False
    return table


def _symbols(side: str) -> list[str]:
    found = list(_SYMBOL.finditer(side))
    if "".join(m[0] for m in found) != side:
        raise ValueError(f"cannot read {side!r} of a cleavage rule")
    return [m[1] for m in found for _ in range(int(m[2] or 1))]


def rule_sides(protease: str) -> list[list[tuple[int, str]]]:
    """The alternatives of a rule: (distance from the cut, symbol) of every residue that they look at."""
    pattern = K.protease_pattern(protease)
    sides = _SIDES.findall(pattern)
    if "|".join(f"(?<={a})(?={b})" for a, b in sides) != pattern:
        raise ValueError(f"cannot read the rule of {protease!r}")
    out = []
    for before, after in sides:
        left, right = _symbols(before), _symbols(after)
        out.append([(i - len(left), s) for i, s in enumerate(left)] + list(enumerate(right)))
    return out


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All symbols of the texts as codes, and the length of each text."""
    data, starts = _bytes(texts)
    if len(data) == 0 or data.max() < 128:
        return data, np.diff(starts)
    parts = texts.to_pylist()
    points = np.frombuffer("".join(parts).encode("utf-32-le"), "uint32")
    beyond = np.where(np.isin(points, [0x85, 0x2028, 0x2029]), _LINE_END, _OTHER)
    return np.where(points < 128, points, beyond).astype("uint8"), np.array([len(p) for p in parts])


def _packed(codes: np.ndarray) -> np.ndarray:
    """At every place the next twelve residues in one word; a symbol that is no residue is 0."""
    table = np.zeros(256, "uint64")
    for number, residue in enumerate(K.CANONICAL, start=1):
        table[ord(residue)] = number

    def joined(words: np.ndarray, later: np.ndarray, by: int) -> np.ndarray:
        out = words.copy()
        out[:-by] |= later[by:] << np.uint64(5 * by)
        return out

    one = table[codes]
    two = joined(one, one, 1)
    four = joined(two, two, 2)
    return joined(joined(four, four, 4), four, 8)


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], "uint64")


def distinct(keys: Sequence[np.ndarray]) -> np.ndarray:
    """One index of each distinct row of the key columns.

    Rows are sorted by a mix of their keys, and neighbours compared by the keys themselves;
    should different rows share a mix, all are sorted by their keys.
    """
    mixed = np.zeros(len(keys[0]), "uint64")
    for i, key in enumerate(keys):
        mixed = (mixed ^ (mixed >> np.uint64(29)) ^ key.astype("uint64")) * _MIX[i % 3]
    order = np.argsort(mixed)
    if len(order) < 2:
        return order
    same = np.logical_and.reduce([key[order[1:]] == key[order[:-1]] for key in keys])
    if ((mixed[order[1:]] == mixed[order[:-1]]) & ~same).any():
        order = np.lexsort(list(keys))
        same = np.logical_and.reduce([key[order[1:]] == key[order[:-1]] for key in keys])
    return order[np.concatenate([[True], ~same])]


def _count(texts: pa.Array, rules: Sequence[list], missed: int, shortest: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, residues) of the distinct peptides of each text by each rule."""
    symbols, lengths = _codes(texts)
    ends = _MARGIN + np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    codes = np.full(_MARGIN + len(symbols) + len(texts) + _MARGIN + longest, _BETWEEN, "uint8")
    owner = np.repeat(np.arange(len(texts), dtype="int32"), lengths + 1)
    codes[_MARGIN + np.flatnonzero(np.arange(len(owner)) != (ends - _MARGIN)[owner])] = symbols
    inner = slice(_MARGIN, _MARGIN + len(owner))
    edge, at_end = np.zeros(len(owner), bool), np.zeros(len(owner), bool)
    edge[starts - _MARGIN], edge[ends - _MARGIN], at_end[ends - _MARGIN] = True, True, True
    odd = np.concatenate([[0], np.cumsum(~_known(f"[{K.CANONICAL}]")[codes[inner]])])
    words = _packed(codes)
    matches: dict[str, np.ndarray] = {}

    def match(symbol: str) -> np.ndarray:
        found = matches.get(symbol)
        if found is None:
            found = _known(symbol).take(codes)
            if len(codes) <= 4 * CHUNK:
                matches[symbol] = found
        return found

    number, residues = np.zeros((2, len(texts), len(rules)), "int64")
    for column, alternatives in enumerate(rules):
        cut = edge.copy()
        for looks in alternatives:
            hit = np.ones(len(owner), bool)
            for away, symbol in looks:
                hit &= match(symbol)[_MARGIN + away : _MARGIN + away + len(owner)]
            cut |= hit
        edges = np.flatnonzero(cut)
        open_ = ~at_end[edges]
        begin, size, running = [], [], open_
        for step in range(1, missed + 2):   # runs of so many fragments
            running = open_[: len(edges) - step] & running[1 : len(edges) - step + 1] if step > 1 else open_[: len(edges) - step]
            width = edges[step:] - edges[:-step]
            kept = running & (width >= shortest) & (width <= longest)
            a = edges[: len(edges) - step][kept]
            begin.append(a)
            size.append(width[kept])
        a, n = np.concatenate(begin), np.concatenate(size)
        plain = odd[a + n] == odd[a]
        if not plain.all():
            a, n = a[plain], n[plain]
        keys = [owner[a]]
        for done in range(0, longest, PACKED):
            bits = np.clip(n - done, 0, PACKED).astype("uint64") * np.uint64(5)
            keys.append(words[a + _MARGIN + done] & ((np.uint64(1) << bits) - np.uint64(1)))
        one = distinct(keys)
        number[:, column] = np.bincount(owner[a[one]], minlength=len(texts))
        residues[:, column] = sums_by(owner[a[one]], n[one], len(texts))
    return number, residues


def digest_totals(
    sequence: Column | str,
    proteases: Sequence[str],
    missed_cleavages: int = 1,
    shortest: int = K.MIN_PEPTIDE_LEN,
    longest: int = K.MAX_PEPTIDE_LEN,
) -> Column:
    """Of each rule that gives a sequence peptides: its name, the number of peptides that ``digest`` gives, and their residues.

    An array in the order of the rules; empty for a NULL sequence.
    """
    if missed_cleavages < 0:
        raise ValueError("missed_cleavages must not be negative")
    if shortest < 1:
        raise ValueError("a peptide has at least one residue")
    rules = [rule_sides(p) for p in proteases]
    names = pa.array(list(proteases), pa.string())

    @arrow_udf(FOUND)
    def totals(sequences: pa.Array) -> pa.Array:
        texts = sequences.fill_null("")
        parts = [(np.zeros((0, len(rules)), "int64"),) * 2]
        before = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype="int64")])
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(before, before[at] + CHUNK, side="right")) - 1)
            parts.append(_count(texts.slice(at, stop - at), rules, missed_cleavages, shortest, longest))
            at = stop
        number, residues = (np.concatenate(p) for p in zip(*parts, strict=True))
        some = number > 0
        ends = np.concatenate([[0], np.cumsum(some.sum(axis=1))])
        columns = [names.take(pa.array(np.nonzero(some)[1])), pa.array(number[some]), pa.array(residues[some])]
        rows = pa.StructArray.from_arrays(columns, names=FOUND.elementType.names)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return totals.asNondeterministic()(F.upper(col(sequence)))  # evaluated once, never copied

"""Sum-of-squares packing of tokenised documents into sequences of bounded length.

Only a document longer than a sequence is cut: its last pieces are full, its first
piece takes the rest. Every piece that is not full is placed, longest first, into
the open bin that makes the sum of squared numbers of open bins per
residual gap smallest. Pieces are dealt by hash into groups of bounded size, which
are packed independently, so no task sees more than one group.

Null text counts as empty, so it has only the end id. Rows that repeat are packed
each for themselves; an empty table gives no row. Without an end id an empty text
has no ids and gives one piece of length 0. Other columns of the input are not read, so
their names may be any; a text of megabytes is only cut into more pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ionloom.llm.files import written
from ionloom.llm.memory import bounded_batches
from ionloom.llm.rows import slices
from ionloom.llm.tokens import blocks, encode_texts

CAPACITY = 2048
GROUP_PIECES = 100_000      # pieces that are packed together, about

WEIGHED, LATE = "weighed", "if none fits"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECE_NAMES = [part.split()[0] for part in PIECES.split(", ")]
PLACES = "sequence_id long, offset long"


def _pieces(
    batches: Iterator[pa.RecordBatch], path: str, end_id: int | None, capacity: int, with_ids: bool
) -> Iterator[pa.RecordBatch]:
    end = np.array([] if end_id is None else [end_id], dtype="<u4").tobytes()
    for batch in slices(batches):
        texts, rows, kept = [t or "" for t in batch.column(1).to_pylist()], [], []
        for start, stop in blocks(texts):
            for i, ids in enumerate(encode_texts(path, texts[start:stop]), start):
                raw = ids + end
                n, at, piece = len(raw) // 4, 0, 0
                while True:
                    take = (n - at) % capacity or min(capacity, n - at)
                    rows.append((i, piece, at, take, zlib.crc32(raw[4 * at : 4 * (at + take)])))
                    if with_ids:
                        kept.append(np.frombuffer(raw, "<u4", take, 4 * at).astype(np.int32))
                    at, piece = at + take, piece + 1
                    if at >= n:
                        break
        row, piece, start, length, crc = np.array(rows, np.int64).reshape(-1, 5).T
        columns = [batch.column(0).take(pa.array(row)), piece.astype(np.int32), start, length, crc]
        names = PIECE_NAMES
        if with_ids:
            ends = np.concatenate([[0], length.cumsum()]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(ends, np.concatenate([*kept, np.array([], np.int32)])))
            names = [*names, "ids"]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def sum_of_squares(
    lengths: np.ndarray, capacity: int = CAPACITY, new_bins: str = LATE
) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece, placed in the given order.

    ``open_bins[g]`` counts the open bins with gap ``g``. Moving a bin from gap g to
    g - s changes the sum of squares by 2 (open[g - s] - open[g]) + 2, or by
    1 - 2 open[g] if that fills it; a new bin changes it by 2 open[capacity - s] + 1. On a
    tie the smallest gap wins and a new bin (if weighed) loses. A piece of length 0 changes nothing
    and opens a bin only if none is open.
    """
    if new_bins not in (WEIGHED, LATE):
        raise ValueError(f"new_bins is {WEIGHED!r} or {LATE!r}")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for i, size in enumerate(lengths.tolist()):
        if size > capacity:
            raise ValueError("a piece is longer than a sequence")
        gap = -1
        if size < capacity:
            gaps = np.flatnonzero(open_bins[max(size, 1) : capacity]) + max(size, 1)
            if len(gaps):
                change = 2 * (open_bins[gaps - size] - open_bins[gaps]) + 2
                change[gaps == size] = 1 - 2 * open_bins[size]
                best = change.argmin()
                if new_bins == LATE or size == 0 or change[best] <= 2 * open_bins[capacity - size] + 1:
                    gap = int(gaps[best])
        if gap < 0:
            gap, number, made = capacity, made, made + 1
        else:
            number = stacks[gap].pop()
            open_bins[gap] -= 1
        bins[i], offsets[i] = number, capacity - gap
        if gap - size > 0:
            stacks[gap - size].append(number)
            open_bins[gap - size] += 1
    return bins, offsets


def _pack(group: pa.Table, capacity: int, new_bins: str) -> pa.Table:
    order = [("length", "descending"), *[(c, "ascending") for c in ("doc_id", "piece", "ids_crc32")]]
    group = group.sort_by(order)
    bins, offsets = sum_of_squares(group["length"].to_numpy(), capacity, new_bins)
    numbers = (group["pack"].to_numpy() << 32) + bins
    return (
        group.drop_columns(["pack"])
        .append_column("sequence_id", pa.array(numbers))
        .append_column("offset", pa.array(offsets))
    )


def _cut(docs: DataFrame, path: str, end_id: int | None, capacity: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """The written pieces, each with its turn."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = partial(_pieces, path=path, end_id=end_id, capacity=capacity, with_ids=with_ids)
    pieces = rows.mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))
    return written(pieces.withColumn("turn", F.monotonically_increasing_id()), "pieces")


def _place(pieces: DataFrame, capacity: int, new_bins: str) -> DataFrame:
    groups = -(-pieces.count() // GROUP_PIECES) or 1
    # by turns, so that equal rows do not meet; the turns are those of the written table
    dealt = pieces.withColumn("pack", F.pmod("turn", F.lit(groups)))
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)

    def pack(group: pa.Table) -> pa.Table:
        return _pack(group, capacity, new_bins)

    return dealt.groupBy("pack").applyInArrow(pack, f"{shape}, {PLACES}")


def pack_documents(
    docs: DataFrame,
    path: str,
    end_id: int | None = None,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    new_bins: str = LATE,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = _cut(docs, path, end_id, capacity, id_col, text_col, with_ids=False)
    return _place(pieces, capacity, new_bins).drop("turn")


def packed_sequences(
    docs: DataFrame,
    path: str,
    end_id: int | None = None,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    new_bins: str = LATE,
) -> DataFrame:
    """Per sequence: sequence_id, its ids, and its pieces (doc_id, piece, start, length, offset) in order.

    Places are found without the ids, which come back by the turns of the written pieces. With
    an end id no piece is empty, so a sequence gathers at most ``capacity`` ids.
    """
    pieces = _cut(docs, path, end_id, capacity, id_col, text_col, with_ids=True)
    places = _place(pieces.drop("ids"), capacity, new_bins)
    whole = places.join(pieces.select("turn", "ids"), "turn")
    part = F.struct("offset", "length", "turn", "doc_id", "piece", "start", "ids")
    gathered = whole.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    names = ("doc_id", "piece", "start", "length", "offset")
    return gathered.select(
        "sequence_id",
        F.flatten("parts.ids").alias("ids"),
        F.transform("parts", lambda p: F.struct(*[p[n].alias(n) for n in names])).alias("pieces"),
    )

"""Columns computed from a text in Arrow batches; all other columns pass through untouched."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ionloom.llm.memory import bounded_batches
from ionloom.llm.tokens import blocks


SLICE_ROWS = 500


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, so that only few texts are Python strings at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _apply(batches: Iterator[pa.RecordBatch], compute: Callable, columns: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
        parts = [compute(texts[start:stop]) for start, stop in blocks(texts)]
        new = [pa.concat_arrays([pa.array(p[i]) for p in parts]) for i in range(len(parts[0]))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=columns)


def with_text_columns(
    df: DataFrame,
    keep: Sequence[str],
    text: str | Column,
    compute: Callable[[list[str]], Sequence],
    fields: Sequence[T.StructField],
) -> DataFrame:
    """The columns ``keep`` and the arrays that ``compute`` gives for blocks of texts (null: empty)."""
    bounded_batches(df.sparkSession)
    rows = df.select(*keep, (F.col(text) if isinstance(text, str) else text).alias("_text"))
    shape = [*rows.schema.fields[:-1], *fields]
    # by place while Python works, so that no name clashes and a dot is no path
    places = [f"c{i}" for i in range(len(shape))]
    inside = T.StructType([T.StructField(p, f.dataType) for p, f in zip(places, shape, strict=True)])
    placed = rows.toDF(*places[: len(keep)], "_text")
    out = placed.mapInArrow(partial(_apply, compute=compute, columns=places), inside)
    return out.toDF(*[f.name for f in shape])

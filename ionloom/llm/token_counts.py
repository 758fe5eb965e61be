"""Token counts by a two-tier lookup on the map side; no pre-token is ever shuffled.

Tier one is a compact table, broadcast once, of the lengths of frequent pre-tokens.
Tier two is a cache in each worker; what it misses, the library encodes.

Null text counts as empty: no bytes, no tokens. Rows that repeat are counted each
for themselves, and other columns are left as they are.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ionloom.llm.memory import bounded_batches, worker_cache
from ionloom.llm.rows import slices, with_text_columns
from ionloom.llm.tokens import TextEncoder, blocks, id_counts

TABLE_ENTRIES = 50_000      # pre-tokens in the broadcast table
TABLE_WORD_BYTES = 48       # longer pre-tokens are left to the caches, so the table has at most 2.5 MB
SUMMARY = 20_000            # pre-tokens each task reports


class LengthTable:
    """Pre-token lengths as one text of words and one byte per word."""

    def __init__(self, lengths: dict[str, int]):
        fit = {w: n for w, n in lengths.items() if n < 256}
        self.words = "\x00".join(fit).encode()
        self.lengths = bytes(fit.values())

    def lookup(self) -> dict[str, int]:
        return dict(zip(self.words.decode().split("\x00"), self.lengths, strict=True)) if self.lengths else {}


def _summaries(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """The most frequent pre-tokens of a task, with counts that may be short for rare ones."""
    encoder, counts = TextEncoder(path, id_counts), Counter()
    for batch in slices(batches):
        texts = [t or "" for t in batch.column(0).to_pylist()]
        for start, stop in blocks(texts):
            for text in texts[start:stop]:
                counts.update(encoder.pre_tokens(text) or ())
            if len(counts) > 10 * SUMMARY:
                counts = Counter(dict(counts.most_common(2 * SUMMARY)))
    top = [
        (w, n)
        for w, n in counts.most_common(SUMMARY)
        if "\x00" not in w and len(w.encode()) <= TABLE_WORD_BYTES
    ]
    yield pa.RecordBatch.from_pydict(
        {"word": pa.array([w for w, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())}
    )


def frequent_lengths(texts: DataFrame, path: str, entries: int = TABLE_ENTRIES) -> LengthTable:
    """Token lengths of the corpus's frequent pre-tokens.

    Every text is counted inside its task; only each task's summary is merged.
    The table decides what is fast, never what is counted.
    """
    merged = (
        texts.mapInArrow(partial(_summaries, path=path), "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "word")
        .limit(entries)
        .select("word")
    )
    words = [r["word"] for r in merged.collect()]
    encoder = TextEncoder(path, id_counts, entries=entries)
    if words:
        encoder._learn(set(words))
    return LengthTable({w: encoder.cache[w] for w in words})


class Shared:
    """A broadcast table with a name by which a worker keeps its encoder."""

    def __init__(self, broadcast, name: str):
        self.broadcast, self.id = broadcast, name

    @property
    def value(self) -> LengthTable:
        return self.broadcast.value


def _counts(texts: list[str], path: str, table) -> tuple:
    encoder = worker_cache(
        ("counts", path, table.id), lambda: TextEncoder(path, id_counts, known=table.value.lookup())
    )
    return (np.array(encoder.encode(texts, sum), dtype=np.int64),)


def count_tokens(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
    entries: int = TABLE_ENTRIES,
) -> DataFrame:
    """Per row: its id, bytes, tokens, and whether it has more than ``limit`` tokens."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias(id_col), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_text")
    )
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(rows.select("_text"), path, entries))
    counted = with_text_columns(
        rows,
        [id_col, "n_bytes"],
        "_text",
        partial(_counts, path=path, table=Shared(shared, uuid.uuid4().hex)),
        [T.StructField("n_tokens", T.LongType())],
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

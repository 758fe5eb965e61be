"""Approximate nearest neighbours by inner product in a forest of hash prefixes.

Vectors are dealt into shards of bounded size. Each shard keeps, per tree, a sorted
array of 64-bit hash strings whose bits are sides of random hyperplanes. A query
descends every tree to its longest matching prefix, then all trees ascend together,
a bit at a time, until their matches reach the wanted number of candidates, which
are scored exactly in double precision. Every query meets every shard; the best of
all shards are merged.

For inner products of unequal norms vectors get one more component that makes their
norms equal, which leaves the order of products as it is.

Vectors that are null, zero, or hold a null or non-finite component, and rows without
an id, take no part. A repeated id is one query, of all its vectors, and never its own
neighbour; as a candidate it appears once, with its best score. The search counts ids,
not rows, and where its candidates hold fewer than k ids, the whole shard is scored.
Vectors of different length are never compared. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window, functions as F

from ionloom.llm.files import locate, shared_folder, written

BITS = 64
TREES = 48
SHARD_ROWS = 8_192
SHARE = 1.0                 # matches of all trees together at which they stop, as a share of a shard
LEAST = 400                 # and at least so many
QUERY_ROWS = 1_024          # queries searched at a time


class Forest:
    """Sorted hash strings of one shard's vectors (rows of equal length, none of them zero)."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, seed: int = 17, ids: np.ndarray | None = None):
        self.vectors = vectors
        ids = np.arange(len(vectors)) if ids is None else ids
        self.names, self.name_of, rows = np.unique(ids, return_inverse=True, return_counts=True)
        norms = np.linalg.norm(vectors, axis=1)
        self.most = norms.max()
        rest = np.sqrt(np.maximum(1 - (norms / self.most) ** 2, 0))
        self.planes = np.random.default_rng(seed).normal(size=(trees, BITS, vectors.shape[1] + 1))
        hashes = self._hash(np.column_stack([vectors / self.most, rest]))
        self.order = np.argsort(hashes, axis=1, kind="stable")
        self.sorted = np.take_along_axis(hashes, self.order, axis=1)
        # ids before each place of a tree: a row of an id that has several counts as a part of it
        parts = (1 / rows)[self.name_of][self.order]
        self.before = np.concatenate([np.zeros((trees, 1)), np.cumsum(parts, axis=1)], axis=1)

    def _hash(self, lifted: np.ndarray) -> np.ndarray:
        weight = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
        return np.stack([((lifted @ p.T) > 0).astype(np.uint64) @ weight for p in self.planes])

    def _ranges(self, hashes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """In each tree, where the strings with a query's first ``level`` bits begin and end."""
        n = self.vectors.shape[0]
        if level == 0:
            return np.zeros(hashes.shape, np.int64), np.full(hashes.shape, n)
        shift = np.uint64(BITS - level)
        low = hashes >> shift << shift
        high = low | ((np.uint64(1) << shift) - np.uint64(1))
        pairs = list(zip(self.sorted, low, high, strict=True))
        return (
            np.stack([np.searchsorted(s, a, "left") for s, a, _ in pairs]),
            np.stack([np.searchsorted(s, b, "right") for s, _, b in pairs]),
        )

    def _longest(self, hashes: np.ndarray) -> int:
        """Length of the longest prefix that any query shares with a string of any tree."""
        longest = 0
        for strings, wanted in zip(self.sorted, hashes, strict=True):
            at = np.searchsorted(strings, wanted)
            for near in (np.maximum(at - 1, 0), np.minimum(at, len(strings) - 1)):
                differ = int((strings[near] ^ wanted).min())
                longest = max(longest, BITS - differ.bit_length())
        return longest

    def candidates(self, queries: np.ndarray, wanted: int) -> Iterator[np.ndarray]:
        """For each query, the places of its candidates."""
        norms = np.linalg.norm(queries, axis=1, keepdims=True)
        hashes = self._hash(np.column_stack([queries / norms, np.zeros(len(queries))]))
        begin = np.zeros(hashes.shape, np.int64)
        end = np.zeros(hashes.shape, np.int64)
        left = np.arange(len(queries))
        for level in range(self._longest(hashes), -1, -1):     # all trees ascend by the same bit
            a, b = self._ranges(hashes[:, left], level)
            ids = np.take_along_axis(self.before, b, axis=1) - np.take_along_axis(self.before, a, axis=1)
            done = (ids.sum(axis=0) >= wanted - 1e-6) | (level == 0)
            begin[:, left[done]], end[:, left[done]] = a[:, done], b[:, done]
            left = left[~done]
            if not len(left):
                break
        seen = np.zeros(len(self.vectors), bool)
        for q in range(len(queries)):
            seen[:] = False
            for tree, a, b in zip(self.order, begin[:, q], end[:, q], strict=True):
                seen[tree[a:b]] = True
            yield np.flatnonzero(seen)


def _best(forest: Forest, query_ids: np.ndarray, queries: np.ndarray, k: int, share: float) -> list[np.ndarray]:
    """Arrays of (query id, vector id, score) of each query's best candidates in the shard."""
    names, wanted = forest.names, max(LEAST, int(share * len(forest.names)))
    query, found, score = [], [], []
    for name, vector, places in zip(query_ids, queries, forest.candidates(queries, wanted), strict=True):
        own = names == name
        seen = np.zeros(len(names), bool)
        seen[forest.name_of[places]] = True
        if (seen & ~own).sum() < min(k, (~own).sum()):
            places = np.arange(len(forest.vectors))
        best = np.full(len(names), -np.inf)     # a repeated id once
        np.maximum.at(best, forest.name_of[places], forest.vectors[places] @ vector)
        best[own] = -np.inf
        near = np.flatnonzero(best > -np.inf)
        if len(near) > k:
            near = near[best[near] >= np.partition(best[near], len(near) - k)[len(near) - k]]
        near = near[np.lexsort((names[near], -best[near]))[:k]]
        query.append(np.full(len(near), name))
        found.append(names[near])
        score.append(best[near])
    return [np.concatenate(x) for x in (query, found, score)]


NAMES = ["query_id", "vec_id", "score"]


def _by_length(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Ids and vectors of each length of vector."""
    lengths = table["length"].to_numpy()
    for length in np.unique(lengths):
        part = table.filter(pa.array(lengths == length)).combine_chunks()
        flat = part["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        yield int(length), part["id"].to_numpy(), flat.reshape(part.num_rows, -1).astype(np.float64)


def _query_blocks(folder: str) -> Iterator[pa.RecordBatch]:
    system, path = locate(folder)
    for info in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with system.open_input_file(info.path) as source:
                yield from pq.ParquetFile(source).iter_batches(batch_size=QUERY_ROWS)


def _search(batches: Iterator[pa.RecordBatch], folder: str, k: int, trees: int, share: float, rows: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def results() -> Iterator[pa.RecordBatch]:
        shard = _by_length(pa.Table.from_batches(held))
        forests = {length: Forest(vectors, trees, ids=ids) for length, ids, vectors in shard}
        for block in _query_blocks(folder):
            for length, query_ids, queries in _by_length(pa.Table.from_batches([block])):
                if length in forests:
                    columns = _best(forests[length], query_ids, queries, k, share)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=NAMES)

    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            held.append(batch.slice(start, rows))
            n += held[-1].num_rows
            if n >= rows:
                yield from results()
                held, n = [], 0
    if held:
        yield from results()


def usable(vector: Column) -> Column:
    """Whether a vector takes part: it has components, all finite, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    vectors: DataFrame,
    queries: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = TREES,
    share: float = SHARE,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for the rows that ``queries`` selects.

    The queries are a table in the shared folder that every shard reads in blocks, so
    neither the driver nor a task holds them all.
    """
    spark = vectors.sparkSession
    known = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    vector = F.col(vector_col).cast("array<double>")
    shape = [F.col(id_col).cast("long").alias("id"), F.size(vector_col).alias("length"), vector.alias("vector")]
    folder = shared_folder(spark, "queries")
    known.where(queries).select(*shape).distinct().write.parquet(folder)
    rows = written(known.select(*shape).distinct(), "vectors")
    shards = max(-(-rows.count() // shard_rows), 1)
    search = partial(_search, folder=folder, k=k, trees=trees, share=share, rows=shard_rows)
    # dealt by turns, so equal vectors and repeated ids are spread too
    found = rows.repartition(shards).mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

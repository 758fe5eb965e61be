"""Token ids as equal-length sequences in Arrow files, for zero-copy random access.

A shard is a pair of Arrow IPC files. ``*.tokens.arrow`` holds record batches of
``ids fixed_size_list<uint16|uint32>[length]`` and ``mask fixed_size_list<bool>[length]``
(true: a real id; only the last sequence of a shard is padded). ``*.docs.arrow``
has a row per document: its key, the place of its first id in the shard, and how
many ids it has. Buffers are not compressed, so a memory map needs no copy.

Shards follow the order of the key. Null text has only the end id. A null key
sorts first; rows with equal keys keep any order among themselves, each with its
own place. An empty table gives no shard and no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ionloom.llm.files import dealt, locate, new_file, shared_folder, written
from ionloom.llm.memory import bounded_batches
from ionloom.llm.rows import slices
from ionloom.llm.tokens import blocks, encode_texts

LENGTH = 2048               # ids in a sequence
BATCH_SEQUENCES = 256       # sequences in a record batch
SHARD_SEQUENCES = 32_768    # a task opens a new shard after so many
PART_BYTES = 16 << 20       # of the stored input that one range partition takes, about
UNKNOWN_BYTES = 1 << 50     # a plan's size from which it is a guess

MANIFEST = "shard string, docs string, first_key long, n_docs long, n_ids long, part int, turn int"


def tokens_schema(length: int, vocabulary: int) -> pa.Schema:
    kind = pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


DOCS_SCHEMA = pa.schema([("key", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64())])


class ShardWriter:
    """Appends documents to one shard; holds at most one record batch of ids."""

    def __init__(self, folder: str, schema: pa.Schema):
        self.shard, self.docs = new_file(folder, ".tokens.arrow"), new_file(folder, ".docs.arrow")
        self.schema, self.length = schema, schema.field("ids").type.list_size
        self.dtype = schema.field("ids").type.value_type.to_pandas_dtype()
        self.outs = [system.open_output_stream(path) for system, path in map(locate, (self.shard, self.docs))]
        self.tokens = pa.ipc.new_file(self.outs[0], schema)
        self.index = pa.ipc.new_file(self.outs[1], DOCS_SCHEMA)
        self.held: list[np.ndarray] = []
        self.n_held, self.n_ids, self.rows, self.n_docs, self.first_key = 0, 0, [], 0, None

    def add(self, key: int | None, ids: np.ndarray) -> None:
        if not self.n_docs:
            self.first_key = key
        self.rows.append((key, self.n_ids, len(ids)))
        self.n_docs += 1
        self.n_ids += len(ids)
        self.held.append(ids.astype(self.dtype))
        self.n_held += len(ids)
        if self.n_held >= BATCH_SEQUENCES * self.length:
            self._write(self.n_held // self.length)
        if len(self.rows) >= 10_000:
            self._write_rows()

    def _write(self, sequences: int) -> None:
        ids = np.concatenate(self.held)
        size = sequences * self.length
        full = np.zeros(size, self.dtype)
        used = min(size, len(ids))
        full[:used] = ids[:used]
        arrays = [
            pa.FixedSizeListArray.from_arrays(values, self.length)
            for values in (pa.array(full), pa.array(np.arange(size) < used))
        ]
        self.tokens.write_batch(pa.record_batch(arrays, schema=self.schema))
        self.held, self.n_held = [ids[used:]], len(ids) - used

    def _write_rows(self) -> None:
        columns = [pa.array(list(c), pa.int64()) for c in zip(*self.rows, strict=True)]
        self.index.write_batch(pa.record_batch(columns, schema=DOCS_SCHEMA))
        self.rows = []

    def close(self) -> tuple:
        if self.n_held:
            self._write(-(-self.n_held // self.length))
        if self.rows:
            self._write_rows()
        self.tokens.close()
        self.index.close()
        for out in self.outs:
            out.close()
        return self.shard, self.docs, self.first_key, self.n_docs, self.n_ids


def _write_shards(
    batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int | None, length: int
) -> Iterator[pa.RecordBatch]:
    from ionloom.llm.tokens import byte_encoder

    schema = tokens_schema(length, max(byte_encoder(path).library.get_vocab_size(), (end_id or 0) + 1))
    end = np.array([] if end_id is None else [end_id], dtype="<u4").tobytes()
    names = [part.split()[0] for part in MANIFEST.split(", ")]
    writer, done = None, []
    for batch in slices(batches):
        keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        for start, stop in blocks(texts):
            for key, ids in zip(keys[start:stop], encode_texts(path, texts[start:stop]), strict=True):
                writer = writer or ShardWriter(folder, schema)
                writer.add(key, np.frombuffer(ids + end, dtype="<u4"))
                if writer.n_ids >= SHARD_SEQUENCES * length:
                    done.append(writer.close())
                    writer = None
    if writer:
        done.append(writer.close())
    done = [(*shard, TaskContext.get().partitionId(), turn) for turn, shard in enumerate(done)]
    rows = pd.DataFrame(done, columns=names).astype({"first_key": "Int64", "part": "int32", "turn": "int32"})
    yield pa.RecordBatch.from_pandas(rows, preserve_index=False)


def _parts(docs: DataFrame) -> int:
    """Range partitions, by the bytes that the plan expects to read."""
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(usual, -(-size // PART_BYTES)) if size < UNKNOWN_BYTES else usual


def write_sequences(
    docs: DataFrame,
    path: str,
    folder: str,
    end_id: int | None = None,
    length: int = LENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encode ``docs`` in ascending ``id_col`` order into shards; returns their manifest.

    The manifest is a table in the shared folder: files that a lost or repeated task
    left behind are in no manifest and are never read.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    # rows of one id, or without one, may keep any order, so a number of the row parts them
    ordered = rows.withColumn("tie", F.monotonically_increasing_id())
    ordered = ordered.repartitionByRange(_parts(docs), "key", "tie").sortWithinPartitions("key", "tie").drop("tie")
    shards = ordered.mapInArrow(
        partial(_write_shards, folder=folder, path=path, end_id=end_id, length=length), MANIFEST
    )
    return written(shards, "manifest")


class SequenceFile:
    """Random access to one shard's sequences; ``ids`` and ``mask`` are views of the file."""

    def __init__(self, shard: str):
        system, path = locate(shard)
        local = system.type_name == "local"
        self.source = pa.memory_map(path) if local else system.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)

    def __enter__(self) -> SequenceFile:
        return self

    def __exit__(self, *_) -> None:
        self.source.close()

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids of sequence ``i`` without a copy, and its mask as a slice of the bit map."""
        batch = self.file.get_batch(i // BATCH_SEQUENCES)
        ids, mask = batch.column(0), batch.column(1)
        j, length = i % BATCH_SEQUENCES, ids.type.list_size
        return (
            ids.values.slice(j * length, length).to_numpy(zero_copy_only=True),
            mask.values.slice(j * length, length),
        )

    def stream(self) -> Iterator[np.ndarray]:
        """The real ids, batch by batch."""
        for b in range(self.file.num_record_batches):
            batch = self.file.get_batch(b)
            ids = batch.column(0).values.to_numpy(zero_copy_only=True)
            yield ids[: batch.column(1).values.true_count]


def _read_docs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for shard, docs, before in zip(batch["shard"], batch["docs"], batch["before"], strict=True):
            system, path = locate(docs)
            with system.open_input_file(path) as source:
                index = pa.ipc.open_file(source).read_all()
            n_ids = index["n_ids"].to_numpy()
            sums = np.zeros(len(n_ids), dtype=np.int64)
            with SequenceFile(shard) as file:
                i, left, crc = 0, int(n_ids[0]), 0
                for ids in file.stream():
                    raw, at = memoryview(ids.astype("<u4")).cast("B"), 0
                    while at < len(raw):
                        take = min(len(raw) - at, 4 * left)
                        crc = zlib.crc32(raw[at : at + take], crc)
                        at, left = at + take, left - take // 4
                        while left == 0 and i < len(n_ids):
                            sums[i], crc, i = crc, 0, i + 1
                            left = int(n_ids[i]) if i < len(n_ids) else 0
                    del raw
                sums[i:] = 0
            yield pd.DataFrame(
                {
                    "doc_id": index["key"].to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get),
                    "start": index["first"].to_numpy() + before,
                    "n_tokens": n_ids,
                    "ids_crc32": sums,
                }
            )


def read_documents(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it), n_tokens, ids_crc32.

    The running sum is over the shards, of which there is one per range partition, and one
    more per 67 million ids in it.
    """
    order = Window.orderBy("part", "turn")
    placed = manifest.select(
        "part",
        "turn",
        "shard",
        "docs",
        F.coalesce(F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    return dealt(placed, ["part", "turn"], manifest.count()).mapInPandas(
        _read_docs, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def round_trip(docs: DataFrame, path: str, end_id: int | None = None, length: int = LENGTH) -> DataFrame:
    """Write ``docs`` as sequences into a fresh shared folder and read every document back."""
    folder = shared_folder(docs.sparkSession, "sequences")
    return read_documents(write_sequences(docs, path, folder, end_id, length))

"""Library files are bounded by bytes, so a writer's memory is bounded however many rows its task has."""

import pyarrow as pa

from ionloom.sources import dlib


def test_shards_are_bounded_by_bytes(tmp_path, monkeypatch):
    monkeypatch.setattr(dlib, "SHARD_BYTES", 50_000, raising=False)
    writer = dlib.LibraryWriter(dlib.table_schema("metadata"), {"path": f"file://{tmp_path}", "table": "metadata"}, False)
    monkeypatch.setattr(writer, "_store", lambda con: (con.execute("SELECT sum(length(Value)) FROM metadata").fetchone()[0], con.close())[0])
    batches = [pa.record_batch([["k"] * 40, ["v" * 1000] * 40], names=["Key", "Value"]) for _ in range(10)]
    sizes = writer.write(iter(batches)).names
    assert len(sizes) > 3 and sum(sizes) == 400_000 and max(sizes) <= 100_000


def test_few_rows_at_a_time_become_objects(tmp_path, monkeypatch):
    monkeypatch.setattr(dlib, "ROWS_PER_BATCH", 10)
    writer = dlib.LibraryWriter(dlib.table_schema("metadata"), {"path": f"file://{tmp_path}", "table": "metadata"}, False)
    monkeypatch.setattr(dlib, "ROWS_PER_SHARD", 10)
    monkeypatch.setattr(writer, "_store", lambda con: (con.execute("SELECT count(*) FROM metadata").fetchone()[0], con.close())[0])
    assert writer.write(iter([pa.record_batch([["k"] * 35, ["v"] * 35], names=["Key", "Value"])])).names == [10, 10, 10, 5]

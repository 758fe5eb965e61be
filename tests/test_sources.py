import gzip
import os
import random
import sqlite3

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ionloom.session import qualified
from ionloom.sources import blobs, library
from ionloom.sources.dlib import read_dlib, write_dlib
from ionloom.sources.fasta import read_fasta
from ionloom.sources.retention import read_rt_table, sorted_sources
from ionloom.sources.samples import read_named_samples, read_samples, usable_samples, write_samples


def brute_fasta(text):
    out, name = {}, None
    for line in text.splitlines():
        if line.startswith(">"):
            name = line[1:].rstrip()
            out[name] = ""
        else:
            out[name] += line.rstrip()
    return out


@pytest.mark.parametrize("split_bytes", ["128m", "700"])
def test_fasta(spark, tmp_path, split_bytes):
    rng = random.Random(4)
    text = ""
    for i in range(300):
        end = rng.choice(["\n", "\r\n"])
        name = f"sp|{i % 270}| a > b {'  ' if i % 3 else ''}"  # thirty headers come twice
        seq = "".join(rng.choices("ACDEFGHIKLMNPQRSTVWYacx*", k=rng.randint(0, 200)))
        text += f">{name}{end}" + "".join(seq[j : j + 60] + end for j in range(0, len(seq), 60))
    path = tmp_path / "in.fasta"
    path.write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        got = {r["ProteinAccession"]: r["sequence"] for r in read_fasta(spark, str(path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == brute_fasta(text.replace("\r\n", "\n")) and len(got) == 270


@pytest.mark.parametrize(
    "text, want",
    [
        ("P1\nMKV\n>P1\nMKV\n>P2\nAAA", {"P1": "MKV", "P2": "AAA"}),     # opening text equal to a record
        ("P1\nMKV\n>P2\nAAA\n>P1\nCCC\n>P1\nDDD", {"P1": "DDD", "P2": "AAA"}),
        ("\n\n>P1\nMKV\n>\nQQQ\n>P2\n", {"P1": "MKV", "P2": ""}),
        (">P1\nMKV\n>P1\nAAA", {"P1": "AAA"}),
        ("no record at all", {}),
    ],
)
def test_opening_text_is_dropped_by_place(spark, tmp_path, text, want):
    path = tmp_path / "in.fasta"
    path.write_text(text)
    assert {r["ProteinAccession"]: r["sequence"] for r in read_fasta(spark, str(path)).collect()} == want


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_last_of_many_files_and_repeated_headers(spark, tmp_path, monkeypatch, limit):
    from ionloom.sources import fasta

    monkeypatch.setattr(fasta, "BROADCAST_BYTES", limit)
    want = {}
    for f in range(3):
        rows = [(f"P{i % (40 + f)}", f"M{f}K{i}") for i in range(100)]
        (tmp_path / f"{f}.fasta").write_text("stray\nMK\n" * (f == 1) + "".join(f">{h}\n{s}\n" for h, s in rows))
        want |= dict(rows)
    got = read_fasta(spark, str(tmp_path / "*.fasta"))
    assert {r["ProteinAccession"]: r["sequence"] for r in got.collect()} == want


def test_records_with_headers_of_their_own_are_not_shuffled(spark, tmp_path):
    path = tmp_path / "in.fasta"
    path.write_text("".join(f">P{i}\nMK{i}\n" for i in range(200)))
    plan = read_fasta(spark, str(path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_empty_fasta(spark, tmp_path):
    path = tmp_path / "empty.fasta"
    path.write_text("")
    assert read_fasta(spark, str(path)).count() == 0


def test_rt_table(spark, tmp_path):
    path = tmp_path / "rt.tsv.gz"
    rows = ["PeptideModSeq\tHI\tSource", "AC[+57.021464]DEFGHK\t1.5\ts2", "AK[+99.9]CDEFGH\t2\ts1", "ACDEF\t3\ts3", "A" * 36 + "\t4\ts4", "[+42.010565]ACDEFG\t5\ts1"]
    with gzip.open(path, "wt") as out:
        out.write("\n".join(rows) + "\n")
    table = read_rt_table(spark, str(path))
    assert {(r["CodedPeptideSeq"], r["PeptideLength"], r["HI"]) for r in table.collect()} == {("-AcDEFGHK_", 8, 1.5), ("^ACDEFG_", 6, 5.0)}
    assert sorted_sources(table).first()["sources"] == ["s1", "s2"]


def entries(spark, n=57):
    rows = [(f"PEPTIDE{i}", i % 4, float(i), [(100.0 + j, 0.5 * j) for j in range(i % 5)]) for i in range(n)]
    df = spark.createDataFrame(rows, "PeptideModSeq string, PrecursorCharge int, RTInSeconds double, peaks array<struct<mz:double,intensity:float>>")
    return df.repartition(3).select("PeptideModSeq", "PrecursorCharge", "RTInSeconds", blobs.pack_peaks(F.col("peaks")).alias("b")).select(
        "PeptideModSeq", "PrecursorCharge", "RTInSeconds", "b.*"
    )


def test_blob_format(spark):
    import struct
    import zlib

    row = entries(spark).where("PeptideModSeq = 'PEPTIDE4'").first()
    assert row["MassEncodedLength"] == 32 and row["IntensityEncodedLength"] == 16
    assert zlib.decompress(row["MassArray"]) == struct.pack(">4d", 100, 101, 102, 103)
    assert zlib.decompress(row["IntensityArray"]) == struct.pack(">4f", 0, 0.5, 1, 1.5)


def test_dlib_round_trip(spark, tmp_path):
    path = str(tmp_path / "lib")
    write_dlib(entries(spark), path)
    assert 1 <= len([f for f in os.listdir(path) if f.endswith(".dlib")]) <= 3
    assert not [f for f in os.listdir(path) if f.startswith(".pending")]
    back = read_dlib(spark, path)
    assert back.count() == 57 and back.where("Copies is null").count() == 57
    arrays = back.select("PeptideModSeq", blobs.unpack_arrays().alias("a")).collect()
    assert {r["PeptideModSeq"]: len(r["a"]["mzs"]) for r in arrays} == {f"PEPTIDE{i}": i % 5 for i in range(57)}
    some = read_dlib(spark, path, columns=["PeptideModSeq", "PrecursorCharge"])
    assert some.columns == ["PeptideModSeq", "PrecursorCharge"]
    assert some.where("PrecursorCharge = 2 and PeptideModSeq in ('PEPTIDE2', 'PEPTIDE3')").count() == 1
    assert some.where("PrecursorCharge >= 2 and PrecursorCharge < 3").count() == 14
    ranges = spark.read.format("dlib").option("path", qualified(spark, path)).option("rows_per_partition", 5).load()
    assert ranges.rdd.getNumPartitions() >= 12 and ranges.count() == 57
    # every shard is a complete library
    assert {r["Value"] for r in read_dlib(spark, path, "metadata").collect()} == {"0.1.14"}
    assert read_dlib(spark, path, "peptidetoprotein").count() == 0
    write_dlib(entries(spark, 3), path, overwrite=False)
    assert read_dlib(spark, path).count() == 60
    write_dlib(entries(spark, 4), path)
    assert read_dlib(spark, path).count() == 4


def test_dlib_relation_table(spark, tmp_path):
    rows = spark.createDataFrame([("A", True, "p"), ("B", False, "q")], "PeptideSeq string, isDecoy boolean, ProteinAccession string")
    path = str(tmp_path / "rel")
    write_dlib(rows, path, "peptidetoprotein")
    assert {tuple(r) for r in read_dlib(spark, path, "peptidetoprotein").collect()} == {("A", True, "p"), ("B", False, "q")}


def test_parquet_library(spark, tmp_path):
    base = str(tmp_path / "lib")
    library.create_library(spark, base)
    unpacked = entries(spark).withColumn("a", blobs.unpack_arrays()).select("PeptideModSeq", "PrecursorCharge", "a.*")
    library.append_table(unpacked, "entries", base)
    assert library.read_table(spark, base, "entries").count() == 57
    library.export_library(spark, base, base + "-files")
    back = read_dlib(spark, base + "-files").select("PeptideModSeq", blobs.unpack_arrays().alias("a"))
    assert {tuple(r["a"]["mzs"]) for r in back.collect()} == {tuple(100.0 + j for j in range(n)) for n in range(5)}
    with pytest.raises(Exception, match="(?i)exists"):
        library.create_library(spark, base, overwrite=False)
    with pytest.raises(ValueError):
        library.conform(spark.range(1), "entries")
    with pytest.raises(ValueError):
        library.read_table(spark, base, "nothing")
    library.create_library(spark, base)
    assert library.read_table(spark, base, "entries").count() == 0


def test_samples(spark, tmp_path):
    strong = [[0.5, 0.02, 0.01] + [0.0] * 31] + [[-1.0] * 34] * 3
    weak = [[0.5, 0.02, 0.001] + [0.0] * 31] + [[-1.0] * 34] * 3
    rows = [("-AAAAAA_", "AAAAAA", 2, strong, 1.0, "d1", "hcd", 30.0), ("-AAAAAK_", "AAAAAK", 2, weak, 1.0, "d1", "hcd", 30.0),
            ("-AAAAAA_", "AAAAAA", 7, strong, 1.0, "d2", "cid", 35.0), ("-" + "A" * 36 + "_", "A" * 36, 2, strong, 1.0, "d2", "cid", 35.0)]
    schema = "coded_seq string, peptide_mod_seq string, precursor_z int, ion_array array<array<float>>, RT double, dataset string, frag_type string, nce double"
    df = spark.createDataFrame(rows, schema)
    write_samples(df, str(tmp_path / "s"))
    back = read_samples(spark, str(tmp_path / "s"))
    assert back.count() == 4 and usable_samples(back).count() == 1
    plan = back.where("dataset = 'd1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan
    for name in ("d1_HCD_30.0_a", "d2_CID_35.0_b"):
        df.limit(2).select("coded_seq").coalesce(1).write.parquet(str(tmp_path / "flat" / name))
    named = read_named_samples(spark, str(tmp_path / "flat"))
    assert {tuple(r) for r in named.select("dataset", "frag_type", "nce").distinct().collect()} == {("d1", "HCD", 30.0), ("d2", "CID", 35.0)}


@pytest.mark.parametrize("prefix", ["", "file:", "file://"])
def test_library_files_by_any_path(spark, tmp_path, prefix, monkeypatch):
    from ionloom.sources import dlib

    folder = prefix + str(tmp_path / "a b")
    rows = spark.range(300, numPartitions=20).select(F.col("id").cast("string").alias("PeptideSeq"), F.lit("x").alias("ProteinAccession"), F.lit(True).alias("isDecoy"))
    dlib.write_dlib(rows, folder, "peptidetoprotein")
    back = dlib.read_dlib(spark, folder, "peptidetoprotein")
    assert {int(r["PeptideSeq"]) for r in back.collect()} == set(range(300))
    assert back.rdd.getNumPartitions() == 1      # twenty small shards, one task
    with pytest.raises(ValueError):
        dlib._file_system("/user/me/library")


def test_shards_are_bounded(spark, tmp_path, monkeypatch):
    from ionloom.sources import dlib

    monkeypatch.setattr(dlib, "ROWS_PER_SHARD", 100)
    writer = dlib.LibraryWriter(dlib.table_schema("metadata"), {"path": f"file://{tmp_path}", "table": "metadata"}, False)
    batches = [pa.record_batch([["k"] * 60, ["v"] * 60], names=["Key", "Value"]) for _ in range(4)]
    done = writer.write(iter(batches))
    assert len(done.names) == 2
    writer.commit([done])
    assert dlib.read_dlib(spark, str(tmp_path), "metadata").count() == 240


def test_files_of_another_store_are_read_into_memory(tmp_path, monkeypatch):
    import pyarrow.fs as pafs

    from ionloom.sources import dlib

    con = sqlite3.connect(tmp_path / "a.dlib")
    con.execute("CREATE TABLE t (x int)")
    con.execute("INSERT INTO t VALUES (4)")
    con.commit()
    con.close()
    store = pafs.SubTreeFileSystem(str(tmp_path), pafs.LocalFileSystem())
    monkeypatch.setattr(dlib, "_file_system", lambda path: (store, "a.dlib"))
    assert dlib._connect("far://a.dlib").execute("SELECT x FROM t").fetchall() == [(4,)]

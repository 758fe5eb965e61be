import pytest
from pyspark.sql import functions as F

from ionloom.plans.build_library import append_library, build_library, save_library
from ionloom.plans.catalog.model_queries import plain_fragment_model, plain_retention_model
from ionloom.plans.training_sets import samples_from_entries, samples_from_tables
from ionloom.sources import blobs, library
from ionloom.sources.dlib import read_dlib, write_dlib
from ionloom.streaming.incremental import stream_library

PROTEINS = [("p1", "MAAAAAKCCCCDDDKPEEEEEERGGGGGGSK"), ("p2", "MAAAAAKWWWWWWR"), ("p3", "LLLLLLLK")]


def proteins(spark, rows=PROTEINS):
    return spark.createDataFrame(rows, "ProteinAccession string, sequence string")


def test_library_to_samples(spark, tmp_path):
    built = build_library(proteins(spark), plain_retention_model, plain_fragment_model, decoys=True, charges=[1, 2, 3])
    base = str(tmp_path / "lib")
    save_library(spark, built, base)
    entries = library.read_table(spark, base, "entries")
    relation = library.read_table(spark, base, "peptidetoprotein")
    assert entries.count() == 3 * relation.select("PeptideSeq").distinct().count()
    assert relation.where("isDecoy").count() == relation.where("not isDecoy").count() > 0

    library.export_library(spark, base, str(tmp_path / "dlib"))
    back = read_dlib(spark, str(tmp_path / "dlib"))
    assert read_dlib(spark, str(tmp_path / "dlib"), "peptidetoprotein").count() == relation.count()
    in_row = samples_from_entries(back, "hcd", 30.0, "d")
    assert in_row.count() == samples_from_entries(entries, "hcd", 30.0, "d").count() == entries.count()
    # a predicted spectrum matches itself: the intensities come back normalised to the base peak
    one = in_row.select("coded_seq", "precursor_z", F.array_max(F.flatten("ion_array")).alias("top")).first()
    assert one["top"] == pytest.approx(1.0, abs=1e-6)

    # the same spectra as tables of peaks give the same samples
    spectra = back.withColumn("spectrum_id", F.xxhash64("PeptideModSeq", "PrecursorCharge")).select("*", blobs.unpack_arrays().alias("s"))
    peaks = spectra.select("spectrum_id", F.posexplode(blobs.as_peaks(F.col("s"))).alias("peak_index", "p")).select("spectrum_id", "peak_index", "p.*")
    table = spectra.select(
        "spectrum_id", "PeptideSeq", "PeptideModSeq", "PrecursorCharge", F.col("RTInSeconds").alias("RT"),
        F.lit("d").alias("dataset"), F.lit("hcd").alias("frag_type"), F.lit(30.0).alias("nce"),
    )
    key = ["coded_seq", "precursor_z"]
    long = {(r["coded_seq"], r["precursor_z"]): r["ion_array"] for r in samples_from_tables(table, peaks).collect()}
    short = {(r["coded_seq"], r["precursor_z"]): r["ion_array"] for r in in_row.select(*key, "ion_array").collect()}
    assert long.keys() == short.keys()
    for k in long:
        for a, b in zip(long[k], short[k]):
            assert a == pytest.approx(b, abs=1e-6)


def test_rejected_entries(spark):
    rows = [("AAAAAA", "AAAAAA", 2), ("AAAAA", "AAAAA", 2), ("AAAAAK", "AAAAAK[+99.9]", 2)]
    peaks = F.array(F.struct(F.lit(143.0815).alias("mz"), F.lit(1.0).cast("float").alias("intensity")))
    df = spark.createDataFrame(rows, "PeptideSeq string, PeptideModSeq string, PrecursorCharge int").withColumn("RTInSeconds", F.lit(1.0))
    df = df.withColumn("b", blobs.pack_peaks(peaks)).select("PeptideSeq", "PeptideModSeq", "PrecursorCharge", "RTInSeconds", "b.*")
    assert [r["peptide_mod_seq"] for r in samples_from_entries(df, "cid", 35, "d", "low").collect()] == ["AAAAAA"]


def test_append_is_idempotent(spark, tmp_path):
    base = str(tmp_path / "lib")
    first = build_library(proteins(spark, PROTEINS[:1]), plain_retention_model, plain_fragment_model)
    save_library(spark, first, base)
    for _ in range(2):
        append_library(spark, proteins(spark), base, plain_retention_model, plain_fragment_model)
    whole = build_library(proteins(spark), plain_retention_model, plain_fragment_model)
    key = ["PeptideModSeq", "PrecursorCharge"]
    got = library.read_table(spark, base, "entries")
    assert got.count() == got.select(*key).distinct().count() == whole.entries.count()
    assert library.read_table(spark, base, "peptidetoprotein").count() == whole.peptidetoprotein.count()


def test_stream(spark, tmp_path):
    incoming, base = tmp_path / "in", str(tmp_path / "lib")
    incoming.mkdir()
    for i, (name, seq) in enumerate(PROTEINS):
        (incoming / f"{i}.fasta").write_text(f">{name}\n{seq[:10]}\n{seq[10:]}\n")
    options = dict(checkpoint=str(tmp_path / "cp"), retention_model=plain_retention_model, fragment_model=plain_fragment_model)
    stream_library(spark, str(incoming), base, **options).awaitTermination()
    whole = build_library(proteins(spark), plain_retention_model, plain_fragment_model)
    assert library.read_table(spark, base, "entries").count() == whole.entries.count()
    (incoming / "9.fasta").write_text(">p9\nYYYYYYYK\n")
    stream_library(spark, str(incoming), base, create=False, **options).awaitTermination()
    added = library.read_table(spark, base, "entries").where("PeptideSeq = 'YYYYYYYK'")
    assert added.count() == 2


@pytest.mark.parametrize("parts", ["1", "64"])
def test_result_does_not_depend_on_partitions(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        built = build_library(proteins(spark).repartition(int(parts) % 7 + 1), plain_retention_model, plain_fragment_model)
        rows = built.entries.select("PeptideModSeq", "PrecursorCharge", "PrecursorMz", "RTInSeconds", "mzs", "intensities")
        digest = rows.agg(F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("h")).first()["h"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    seen = test_result_does_not_depend_on_partitions.__dict__.setdefault("seen", set())
    seen.add(digest)
    assert len(seen) == 1


def test_samples_do_not_depend_on_how_entries_lie_in_files(spark):
    from ionloom.plans.catalog.source_queries import library_samples
    from ionloom.plans.catalog.tables import Tables

    tables = Tables(spark, "/root/testdata/sf0.001")
    found = [library_samples(tables, n) for n in (1, 50)]
    one, many = (sorted(map(str, s.collect())) for s, _ in found)
    assert one == many and found[0][1] == found[1][1]
    assert found[0][1]["kept"] > found[0][1]["no ion"] > 0


def test_rows_say_where_they_come_from(spark, tmp_path):
    rows = spark.createDataFrame([(f"PEPTIDE{i}", 2) for i in range(90)], "PeptideSeq string, PrecursorCharge int").repartitionByRange(3, "PeptideSeq").sortWithinPartitions("PeptideSeq")
    write_dlib(rows, str(tmp_path / "d'lib"))
    back = read_dlib(spark, str(tmp_path / "d'lib"), columns=["PeptideSeq"], provenance=True)
    got = back.where("PrecursorCharge IS NULL" if "PrecursorCharge" in back.columns else "PeptideSeq > 'A'").orderBy("_path", "_rowid").collect()
    assert [r["PeptideSeq"] for r in got] == sorted(f"PEPTIDE{i}" for i in range(90))
    assert len({r["_path"] for r in got}) == 3 and back.where("_rowid = 1").count() == 3


def test_a_large_remote_library_file_is_refused(monkeypatch):
    from types import SimpleNamespace

    from ionloom.sources import dlib

    store = SimpleNamespace(get_file_info=lambda _: SimpleNamespace(size=dlib.REMOTE_BYTES + 1))
    monkeypatch.setattr(dlib, "_file_system", lambda path: (store, path))
    with pytest.raises(ValueError, match="not on a local disk"):
        dlib._connect("s3://store/big.dlib")

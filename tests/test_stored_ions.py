"""The library stores m/z as bits of ions, and gives them back in all bits."""

import math
import struct

from pyspark.sql import functions as F

from ionloom.plans.build_library import score_entries, entry_arrays
from ionloom.plans.catalog.model_queries import plain_fragment_model, plain_retention_model
from ionloom.sources import library, versions
from ionloom.sources.schemas import table_schema

KEY = ["PeptideModSeq", "PrecursorCharge"]


def scored(spark, n=300):
    letters = "ACDEFGHILMNPQRSTVWY"
    peptides = ["".join(letters[(i * 7 + j * (i % 5 + 1)) % 19] for j in range(5 + i % 30)) + "K" for i in range(n)]
    rows = spark.createDataFrame([(p,) for p in sorted(set(peptides))], "PeptideSeq string")
    return entry_arrays(score_entries(rows, plain_retention_model, plain_fragment_model, charges=[1, 2, 3])).localCheckpoint()


def bits(df):
    pack = lambda values, kind: None if values is None else tuple(v if v is None else struct.pack(kind, v) for v in values)
    return sorted((repr(r[0]), repr(r[1]), repr(pack(r[2], "<d")), repr(r[3])) for r in df.select(*KEY, "mzs", "intensities").collect())


def folder_bytes(path):
    return sum(p.stat().st_size for p in path.rglob("*.parquet"))


def test_a_library_takes_less_disk_than_its_arrays(spark, tmp_path):
    entries = scored(spark).coalesce(1)
    base = str(tmp_path / "library")
    library.create_library(spark, base)
    plain = tmp_path / "plain"
    library.conform(entries, "entries").write.option("compression", "zstd").parquet(str(plain))
    before = folder_bytes(tmp_path / "library" / "entries")
    library.append_table(entries, "entries", base)
    assert 2 * (folder_bytes(tmp_path / "library" / "entries") - before) < folder_bytes(plain)
    got = library.read_table(spark, base, "entries")
    assert got.schema == table_schema("entries", packed=False)
    assert bits(got) == bits(entries)
    assert library.read_stored(spark, "entries", f"{base}/entries").where("mzs IS NOT NULL OR ions IS NULL").count() == 0


def test_a_compacted_library_keeps_its_bits(spark, tmp_path):
    entries, base = scored(spark, 40), str(tmp_path / "library")
    versions.create_versions(spark, base)
    versions.append_version(spark, base, {"entries": entries.where("PrecursorCharge = 1")})
    versions.append_version(spark, base, {"entries": entries.where("PrecursorCharge > 1")})
    found = versions.compact(spark, base, "entries")
    assert bits(versions.read_version(spark, base, "entries")) == bits(entries)
    stored = library.read_stored(spark, "entries", *[f"{base}/{f}" for f in found.folders["entries"]])
    assert stored.where("ions IS NULL").count() == 0


def test_entries_of_other_origin_keep_their_mzs(spark, tmp_path):
    base = str(tmp_path / "library")
    entries = scored(spark, 12)
    one = entries.where("size(mzs) > 2").orderBy(*KEY).first()
    mzs = list(one["mzs"])
    other = [
        ("kept", 2, [math.nextafter(mzs[0], math.inf), *mzs[1:]]),        # one bit off
        (one["PeptideModSeq"], one["PrecursorCharge"], [math.nextafter(mzs[0], math.inf), *mzs[1:]]),
        (one["PeptideModSeq"], one["PrecursorCharge"], mzs[::-1]),        # another order
        (one["PeptideModSeq"], one["PrecursorCharge"], [*mzs, mzs[-1]]),  # one too many
        (one["PeptideModSeq"], one["PrecursorCharge"], [mzs[0], None]),
        (one["PeptideModSeq"], one["PrecursorCharge"], [0.0, float("nan")]),
        (one["PeptideModSeq"], one["PrecursorCharge"], []),
        (one["PeptideModSeq"], one["PrecursorCharge"], None),
        (one["PeptideModSeq"], None, mzs),
        (one["PeptideModSeq"], 0, mzs),
        (None, 2, mzs),
        ("", 2, mzs),
        ("PEPM[Oxidation]K", 2, mzs),
        ("PE][PK", 2, [1.0]),
        ("A[+99]" + "PEPTIDE" * 10, 3, mzs),
        ("é" * 3, 2, mzs),
    ]
    rows = spark.createDataFrame(other, "PeptideModSeq string, PrecursorCharge int, mzs array<double>").withColumn(
        "intensities", F.array(F.lit(1.0).cast("float"))
    )
    library.create_library(spark, base)
    library.append_table(rows, "entries", base)
    library.append_table(entries, "entries", base)
    assert bits(library.read_table(spark, base, "entries")) == bits(rows.unionByName(entries.select(rows.columns)))


def test_files_without_ions_are_read(spark, tmp_path):
    base, entries = str(tmp_path / "library"), scored(spark, 12)
    library.create_library(spark, base)
    library.conform(entries.where("PrecursorCharge = 1"), "entries").write.mode("append").parquet(f"{base}/entries")
    library.append_table(entries.where("PrecursorCharge > 1"), "entries", base)
    assert bits(library.read_table(spark, base, "entries")) == bits(entries)


def test_mzs_are_computed_only_where_they_are_read(spark, tmp_path):
    base = str(tmp_path / "library")
    library.create_library(spark, base)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    entries = library.read_table(spark, base, "entries")
    keys = plan(entries.where("PeptideSeq = 'A'").select(*KEY))
    assert "Python" not in keys and "EqualTo(PeptideSeq,A)" in keys
    assert plan(entries.select("mzs", "intensities")).count("ArrowEvalPython") == 1

"""Rows that NULLs, odd files and later appends must not lose."""

import sqlite3

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ionloom.functions import masses
from ionloom.operators import assembly, distributions, frames, losses, modification
from ionloom.operators.splits import exact_split
from ionloom.plans.build_library import append_library, build_library, precursors, save_library
from ionloom.plans.catalog.model_queries import plain_fragment_model, plain_retention_model
from ionloom.sources import library
from ionloom.sources.dlib import read_dlib
from ionloom.sources.fasta import read_fasta
from ionloom.streaming.incremental import stream_library

PROTEINS = [("p1", "MAAAAAKMCCCCDDDK"), ("p2", "WWWWWWR")]


def test_append_of_new_charges_and_forms(spark, tmp_path):
    base = str(tmp_path / "lib")
    proteins = spark.createDataFrame(PROTEINS, "ProteinAccession string, sequence string")
    save_library(spark, build_library(proteins, plain_retention_model, plain_fragment_model), base)
    before = library.read_table(spark, base, "entries").count()
    for _ in range(2):
        append_library(spark, proteins, base, plain_retention_model, plain_fragment_model, charges=[2, 4], variable={"M": 15.994915})
    got = library.read_table(spark, base, "entries")
    peptides = build_library(proteins, plain_retention_model, plain_fragment_model).peptidetoprotein.select("PeptideSeq").distinct()
    first = precursors(peptides, charges=[2, 3])
    second = precursors(peptides, variable={"M": 15.994915}, charges=[2, 4])
    key = ["PeptideModSeq", "PrecursorCharge"]
    want = {tuple(r[c] for c in key): r["PrecursorMz"] for r in first.unionByName(second).collect()}
    rows = [(tuple(r[c] for c in key), r["PrecursorMz"]) for r in got.collect()]
    assert len(rows) == len(want) > before
    assert dict(rows) == pytest.approx(want)


def test_split_of_null_groups_and_odd_texts(spark):
    rows = [(i, None if i % 2 else "a", "x:y" if i % 3 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, g string, t string")
    split = exact_split(df, 0.2, ["id"], ["g"])
    assert {r["g"]: r["n"] for r in split.groupBy("g").agg(F.count_if("is_test").alias("n")).collect()} == {None: 10, "a": 10}
    pairs = spark.createDataFrame([("a:b", "c"), ("a", "b:c"), (None, "a"), ("a", None)] * 5, "x string, y string")
    assert exact_split(pairs, 0.2, ["x"], unique_key=False).where("is_test").count() == 4
    hashes = pairs.distinct().select(frames.seeded_key(["x", "y"], 1).alias("h")).distinct()
    assert hashes.count() == 4


def test_null_groups_are_judged(spark):
    df = spark.createDataFrame([(None if i % 2 else "a", float(i)) for i in range(40)], "g string, x double")
    kept = distributions.mark_inliers(df, "x", "laplace", 0.2, ["g"])
    assert kept.where("kept IS NULL").count() == 0 and kept.count() == 40


def test_last_per_key_with_null_orders(spark):
    df = spark.createDataFrame([("a", None, "x"), ("b", None, "y"), ("b", 1, "z")], "k string, o int, v string")
    rows = {r["k"]: (r["o"], r["v"]) for r in frames.last_per_key(df, ["k"], F.col("o")).collect()}
    assert rows == {"a": (None, "x"), "b": (1, "z")}


def test_rowids_below_one_are_read(spark, tmp_path):
    path = str(tmp_path / "a.dlib")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE metadata (Key string, Value string)")
    con.executemany("INSERT INTO metadata (rowid, Key, Value) VALUES (?, ?, ?)", [(-7, "a", "1"), (0, "b", "2"), (5, "c", "3")])
    con.commit()
    con.close()
    assert read_dlib(spark, path, "metadata").count() == 3


def test_sites_are_bounded_by_the_rows(spark):
    df = spark.createDataFrame([("MMM" + "A" * 40 + "MM",)], "PeptideSeq string")
    assert modification.choose_sites(df, {"M": 16.0}, 100).count() == 2**5


def test_unknown_residues_have_no_value(spark):
    df = spark.createDataFrame([("AUK", "-AUK_"), ("AAK", "-AAK_")], "m string, c string").coalesce(1)
    rows = df.select(
        masses.peptide_mass("m").alias("mass"),
        assembly.score_coded(plain_retention_model, "c").alias("rt"),
        assembly.predicted_spectrum(plain_fragment_model, "c", "m", F.lit(2), F.lit(30.0)).alias("s"),
    ).collect()
    assert rows[0]["mass"] is None and rows[0]["rt"] is None and rows[0]["s"] is None
    assert rows[1]["mass"] > 0 and rows[1]["rt"] is not None and rows[1]["s"] is not None
    assert assembly.unweighed(pa.array(["A[+1.5]K", "U", "", "[+2.0]AB"])).tolist() == [False, True, False, True]


def test_unseen_source_takes_the_pooled_scale(spark):
    rows = spark.createDataFrame([("a", 0.0, 2.0), ("b", 0.0, 4.0), ("c", 0.0, 3.0)], "s string, p double, t double")
    scales = losses.source_scales(rows.where("s <> 'c'"), "p", "t", "s")
    got = {r["s"]: (r["norm_error"], r["unseen"]) for r in losses.rt_likelihood_rows(rows, "p", "t", "s", scales).collect()}
    assert got == {"a": (1.0, False), "b": (1.0, False), "c": (1.0, True)}
    nothing = losses.rt_likelihood_rows(rows, "p", "t", "s", scales.limit(0)).collect()
    assert {r["norm_error"] for r in nothing} == {0.2, 0.4, 0.3}


@pytest.mark.parametrize("size", ["16", "64", "1000000"])
def test_fasta_edges(spark, tmp_path, size):
    (tmp_path / "a.fasta").write_text("; comment line\nXXXX\n>p1\nAAA\n\nBBB\n>\n\n>p2 x\nCC\n>p1\nDDD\n")
    (tmp_path / "b.fasta").write_text("\n\n>p3\nEE\n>p4\n")
    (tmp_path / "c.fasta").write_text(">p5\nFF")
    (tmp_path / "d.fasta").write_text("no record here\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        rows = {r["ProteinAccession"]: r["sequence"] for r in read_fasta(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == {"p1": "DDD", "p2 x": "CC", "p3": "EE", "p4": "", "p5": "FF"}


def test_last_record_counts_in_a_stream(spark, tmp_path):
    incoming, base = tmp_path / "in", str(tmp_path / "lib")
    incoming.mkdir()
    (incoming / "a.fasta").write_text("stray\n>p\nAAAAAAAK\n>q\nLLLLLLLK\n>p\nCCCCCCCK\n")
    stream_library(spark, str(incoming), base, str(tmp_path / "cp"), plain_retention_model, plain_fragment_model).awaitTermination()
    found = library.read_table(spark, base, "peptidetoprotein").select("PeptideSeq").distinct()
    assert {r[0] for r in found.collect()} == {"CCCCCCCK", "LLLLLLLK"}


@pytest.mark.parametrize("parts", ["1", "13"])
def test_seeded_places(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = frames.seeded_places(spark.range(500), ["id"], 3).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    order = [r["id"] for r in sorted(rows, key=lambda r: r["place"])]
    assert [r["place"] for r in sorted(rows, key=lambda r: r["place"])] == list(range(500))
    assert order == [r["id"] for r in frames.seeded_shuffle(spark.range(500), ["id"], 3).collect()]


def test_normal_cdf(spark):
    from math import erf, sqrt

    z = np.concatenate([np.linspace(-9, 9, 201), [-40.0, 40.0]])
    df = spark.createDataFrame([(float(v),) for v in z], "z double")
    got = df.select("z", distributions.cumulative("gaussian", F.lit(0.0), F.lit(1.0), F.col("z")).alias("p")).collect()
    for r in got:
        assert r["p"] == pytest.approx(0.5 * (1 + erf(r["z"] / sqrt(2))), abs=1e-13)


def test_ladder_in_batches_equals_the_column_form(spark):
    texts = ["AAK", "[+42.010565]AAC[+57.021464]K", "K", "", None, "[+1.5]", "AM[+15.994915][+1.0]K", "G" * 60 + "K", "AC[-17.0]", "QS[+79.966331]T[+79.966331]R"]
    df = spark.createDataFrame([(t,) for t in texts], "m string").coalesce(1)
    got = df.select("m", assembly.ladder_arrays("m").alias("a"), masses.ladder_nano("m").alias("l")).collect()
    for r in got:
        if r["m"] and r["l"]["b"] is not None:
            assert (r["a"]["b"], r["a"]["y"]) == (r["l"]["b"], r["l"]["y"]), r["m"]
    assert [r["a"] for r in got if r["m"] is None] == [None]
    assert spark.createDataFrame([("AUK",)], "m string").select(assembly.ladder_arrays("m").alias("a")).first()["a"] is None

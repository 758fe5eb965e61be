"""What appends shuffle and leave behind."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ionloom.operators.frames import new_keys
from ionloom.plans import build_library as B
from ionloom.plans.catalog.model_queries import broken_retention_model, plain_fragment_model, plain_retention_model
from ionloom.session import shared_dir
from ionloom.sources import library
from ionloom.sources.schemas import table_schema
from ionloom.streaming.proteins import score_relation

MODELS = (plain_retention_model, plain_fragment_model)
SEQUENCE = "MAAAAAKCCCCDDDKPEEEEEERGGGGGGSK"


def proteins(spark):
    return spark.createDataFrame([("p1", SEQUENCE), ("p2", SEQUENCE)], "ProteinAccession string, sequence string")


def folders(spark):
    return set(Path(shared_dir(spark).removeprefix("file:").replace("//", "/")).glob("ionloom-*"))


def test_appends_leave_no_copy_of_the_relation(spark, tmp_path):
    base = str(tmp_path / "library")
    library.create_library(spark, base)
    before = folders(spark)
    B.append_library(spark, proteins(spark), base, *MODELS)
    with pytest.raises(Exception, match="no model"):
        B.append_library(spark, proteins(spark), base, broken_retention_model, plain_fragment_model, charges=[4])
    score_relation(spark, base, library.read_table(spark, base, "peptidetoprotein"), *MODELS, charges=[4])
    assert folders(spark) == before


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_charges_that_a_form_lacks(spark, limit):
    peptides = spark.createDataFrame([("PEPTIDEK",), ("PEPTIDEK",), ("ACDEFGHK",), ("MMMMMMK",), (None,)], "PeptideSeq string")
    known = spark.createDataFrame(
        [("PEPTIDEK", 2), ("PEPTIDEK", 2), ("PEPTIDEK", 5), ("PEPTIDEK", None), ("AC[+57.021464]DEFGHK", 2), ("AC[+57.021464]DEFGHK", 3), (None, 2)],
        "PeptideModSeq string, PrecursorCharge int",
    )
    got = B.missing_entries(peptides, known, *MODELS, charges=[2, 3], limit=limit)
    assert sorted((r[0], r[1]) for r in got.select("PeptideModSeq", "PrecursorCharge").collect()) == [
        ("MMMMMMK", 2), ("MMMMMMK", 3), ("PEPTIDEK", 3)
    ]


def test_a_large_append_shuffles_each_side_once(spark, tmp_path):
    peptides = spark.createDataFrame([("PEPTIDEK",)], "PeptideSeq string").localCheckpoint()
    known = spark.createDataFrame([], table_schema("entries", packed=False)).localCheckpoint()
    got = B.missing_entries(peptides, known, *MODELS, limit=0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3     # unique peptides, their forms, and those of the library


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_new_keys(spark, limit):
    schema = "a string, b int, c int"
    rows = spark.createDataFrame([("x", 1, 1), ("x", 1, 2), ("x", None, 3), ("y", 2, 4), (None, None, 5)], schema)
    old = spark.createDataFrame([("y", 2, 0), ("z", 1, 0), (None, None, 0)], schema)
    got = new_keys(rows, old, ["a", "b"], limit)
    assert sorted(map(tuple, got.collect()), key=repr) == [("x", 1), ("x", None)]
    assert new_keys(rows, old.where(F.lit(False)), ["a", "b"], limit).count() == 4

"""Batch forms give what the column forms give, awkward texts included."""

import pytest
from pyspark.sql import functions as F

from ionloom.functions import encoding as E, masses as S
from ionloom.functions.mods import mod_sites, write_sites
from ionloom.functions.peptides import digest, is_canonical
from ionloom.operators import assembly
from ionloom.plans.catalog import QUERIES
from ionloom.plans.catalog.model_queries import plain_fragment_model

TEXTS = [
    "PEPTIDEK", "PEPC[+57.021464]TM[+15.994915]K", "[+42.010565]ACDK", "[+224.152478]ACDK", "[+12.300000]ACDK", "Q[-17.026549]ACK",
    "C[+39.994914]ACK[+229.162932]", "ACK[+99.900000]", "", None, "A", "E[-18.010565]K", "S[+79.966331]T[+79.966331]Y[+79.966331]", "AC]K",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(t, i % 5) for i, t in enumerate(TEXTS)], "m string, z int").repartition(3)


def pairs(texts, got, want):
    return [(r["m"], r["got"], r["want"]) for r in texts.select("m", got.alias("got"), want.alias("want")).collect()]


def test_coded_like_the_column_form(texts):
    for got, want in [
        (assembly.coded_texts("m"), E.coded_sequence("m")),
        (assembly.renamed_texts("m"), E.coded_sequence("m", terminals=False)),
        (assembly.code_arrays(assembly.coded_texts("m")), E.integer_codes(E.coded_sequence("m"))),
        (assembly.code_arrays("m"), E.integer_codes("m")),
    ]:
        for text, a, b in pairs(texts.where("m <> '' OR m IS NULL"), got, want):
            assert a == b, text


def test_masses_like_the_column_form(texts):
    for text, a, b in pairs(texts.where("m NOT LIKE 'AC]%' AND m <> ''"), assembly.mass_nano("m"), S.peptide_mass_nano("m")):
        assert a == b, text
    matrix = F.flatten(S.ladder_matrix(S.ladder_nano("m"), "z", 3))
    for text, a, b in pairs(texts.where("m NOT LIKE 'AC]%' AND m <> ''"), assembly.ladder_cells("m", "z", 3), matrix):
        assert a == b, text


def test_totals_of_arrays(spark):
    rows = spark.sql("SELECT * FROM VALUES (array(0.5D, 0D, -1D)), (array()), (NULL), (array(2D)) AS t(a)").select(assembly.array_totals("a").alias("t"))
    assert [r["t"] and tuple(r["t"]) for r in rows.collect()] == [(3, 1, 1, -500000), (0, 0, 0, 0), None, (1, 1, 0, 2000000)]


def test_scores_and_totals_are_one_python_step(spark):
    """No array of cells leaves the Python call that scores it."""
    coded = spark.createDataFrame([("-PEPTIDEK_", 2, 30.0), ("-A?_", 2, 30.0)], "c string, z int, nce double")
    cells = assembly.predicted_cells(plain_fragment_model, "c", "z")
    alone = {r["c"]: r["v"] for r in coded.select("c", cells.alias("v")).collect()}
    totals = coded.select("c", assembly.array_totals(cells).alias("v"))
    assert totals._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    found = {r["c"]: r["v"] for r in totals.collect()}
    assert len(alone["-PEPTIDEK_"]) == found["-PEPTIDEK_"]["n"] == 4 * 7
    assert found["-PEPTIDEK_"]["positive"] == sum(v > 0 for v in alone["-PEPTIDEK_"])
    assert alone["-A?_"] is None and found["-A?_"] is None


@pytest.mark.parametrize("name", ["batched_fragment_scores", "library_entries", "library_entries_without_energy", "ladder_matrix_with_masked_charges",
                                  "peptide_masses", "batched_retention_scores"])
def test_no_lambda_runs_after_the_peptides_are_unique(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    if name != "peptide_masses":     # variants are written with one
        assert "lambda" not in plan.split("Aggregate [PeptideSeq")[0]
    assert "aggregate(" not in plan.split("Aggregate [PeptideSeq")[0] or name == "peptide_masses"


def test_sites_and_digests_of_rows_with_nothing_to_do(spark):
    rows = spark.sql("SELECT * FROM VALUES ('PEPTIDE'), ('PEMMA'), (''), (NULL) AS t(p)")
    got = rows.select("p", write_sites("p", mod_sites("p", {"M": 15.994915})).alias("w")).collect()
    assert {r["p"]: r["w"] for r in got} == {"PEPTIDE": "PEPTIDE", "PEMMA": "PEM[+15.994915]M[+15.994915]A", "": "", None: None}
    odd = spark.sql("SELECT * FROM VALUES ('AAAAAAKCCCCCCR'), ('AAAAAAKXCCCCCCR'), ('aaaaaakccccccr'), (''), (NULL) AS t(s)")
    want = F.filter(digest("s"), is_canonical)
    found = {r["s"]: r for r in odd.select("s", digest("s").alias("d"), want.alias("w")).collect()}
    assert all(r["d"] == r["w"] for r in found.values())
    assert found["AAAAAAKXCCCCCCR"]["d"] == ["AAAAAAK"] and len(found["aaaaaakccccccr"]["d"]) == 3 and found[None]["d"] is None

"""Totals that are summed in batches equal those of the rows they stand for."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom import constants as K
from ionloom.functions import masses
from ionloom.functions.peptides import digest
from ionloom.operators import assembly, cleavage, ladder as L
from ionloom.operators.cleavage import digest_totals
from ionloom.plans.catalog import QUERIES
from ionloom.plans.catalog.digestion_queries import micro

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
PEPTIDES = [
    "PEPTIDEK", "S[+79.966331]AS[+79.966331]K", "[+79.966331]PEPTIDEK", "[+42.010565]S[+1.5][+79.966331]TAK", "AsK", "GGy",
    "AC[+57.021464]DS[+79.9658]K", "AC[+57.021464]DS[+79.96]K", "K", "", None, "AXB", "S" * 300, "PEPTIDEK",
]
CHARGES = [1, 2, 3, 4, None, 0, -1]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("losses, most", [(False, 3), (True, 2)])
def test_ion_totals(spark, losses, most):
    rows = [(p, z) for p in PEPTIDES for z in CHARGES]
    peptides = spark.createDataFrame(rows, "PeptideModSeq string, PrecursorCharge int").repartition(3)
    ions = L.fragment_ions(peptides, [], max_fragment_z=most, phos_loss=losses)
    want = ions.groupBy("ion_type", "ordinal", "frag_z").agg(F.count(F.lit(1)).alias("n"), F.sum(micro(F.col("mz"))).alias("mz_micro"))
    got = L.ion_totals(peptides, max_fragment_z=most, phos_loss=losses)
    assert sorted(got.collect()) == sorted(want.collect())
    assert got.dtypes == want.dtypes and {r["ion_type"] for r in got.collect()} == {"b", "y", *(["b-PO4", "y-PO4"] if losses else [])}
    assert L.ion_totals(peptides.where("false")).collect() == []


def test_sums_beyond_doubles():
    values = np.array([2**60 + 1, 3, 2**60 + 1], "int64")
    assert assembly.sums_by(np.array([1, 0, 1]), values, 3).tolist() == [3, 2**61 + 2, 0]


@needs_tables
@pytest.mark.parametrize("name", ["phospho_loss_ladder", "fragment_ion_ladder"])
def test_no_row_per_ion(spark, name):
    assert "Generate inline" not in _plan(QUERIES[name](spark, SF))


def test_digest_totals(spark):
    letters = "ACDEFGHIKLMNPQRSTVWY"
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list(letters), n)) for n in (0, 1, 5, 6, 7, 40, 400, 3000)]
    texts += ["".join(rng.choice(list("DEKGRPVAHL"), 2000)), "PEPTIDEK" * 30, "K" * 50, "MKRWKPWAAAAAAK", None]
    texts += ["aaaaaak cdefghiR\nPEPTIDEKD DEKAAAAAA", "MÄKAAAAAAK😀DAAAAAAAKß" * 3, "".join(rng.choice([*"DEKGXz *\n\r\u0085é😀_1"], 900))]
    proteins = spark.createDataFrame(list(enumerate(texts)), "doc_id int, sequence string").repartition(3)
    digests = F.array(*[F.struct(F.lit(r).alias("protease"), digest("sequence", r).alias("found")) for r in K.PROTEASES])
    want = proteins.select("doc_id", F.inline(digests)).where(F.size("found") > 0).select(
        "doc_id", "protease", F.size("found").cast("bigint"), F.aggregate("found", F.lit(0).cast("bigint"), lambda a, p: a + F.length(p)))
    got = proteins.select("doc_id", F.inline(digest_totals("sequence", list(K.PROTEASES))))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 150
    for missed, shortest, longest in [(0, 1, 3), (2, 4, 80)]:
        peptides = digest("sequence", "trypsin", missed, shortest, longest)
        want = {r[0]: r[1] for r in proteins.select("doc_id", F.size(peptides)).collect() if (r[1] or 0) > 0}
        got = proteins.select("doc_id", F.inline(digest_totals("sequence", ["trypsin"], missed, shortest, longest)))
        assert {r["doc_id"]: r["n_peptides"] for r in got.collect()} == want


def test_distinct_where_mixes_meet(monkeypatch):
    monkeypatch.setattr(cleavage, "_MIX", np.zeros(3, "uint64"))     # every row has the same mix
    keys = [np.array([1, 2, 1, 2, 3]), np.array([7, 7, 7, 8, 7], "uint64")]
    assert sorted({(int(keys[0][i]), int(keys[1][i])) for i in cleavage.distinct(keys)}) == [(1, 7), (2, 7), (2, 8), (3, 7)]
    assert len(cleavage.distinct(keys)) == 4


@needs_tables
@pytest.mark.parametrize("name", ["digest_every_protease", "digest_per_protease"])
def test_no_peptides_are_made(spark, name):
    assert "split(" not in _plan(QUERIES[name](spark, SF))


def test_residues_are_joined_by_number(spark):
    peptides = spark.createDataFrame([(p,) for p in [*PEPTIDES, "Äé😀", "A[+1.5]B"]], "PeptideModSeq string").distinct()
    got = L.residue_rows(peptides, ["PeptideModSeq"])
    tokens = peptides.select("PeptideModSeq", F.posexplode(F.split("PeptideModSeq", "(?=[A-Za-z])")).alias("position", "token"))
    plain = tokens.where("token rlike '^([A-Za-z].*|\\\\[.*|)$'").withColumn("residue", F.left("token", F.lit(1)))
    want = plain.join(L.residue_table(spark), "residue", "left").select(
        "PeptideModSeq", "position", "residue", F.coalesce("mass_nano", F.lit(0)) + masses._token_delta(F.col("token")))
    known = {tuple(r)[:4] for r in got.where("PeptideModSeq != 'Äé😀'").collect()}
    assert known == set(map(tuple, want.collect())) and len(known) > 300
    assert [tuple(r) for r in got.where("PeptideModSeq = 'Äé😀'").select("residue", "mass_nano").collect()] == [("Ä", 0), ("é", 0), ("😀", 0)]
    join = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [_code#" in join and "BroadcastHashJoin [residue#" not in join

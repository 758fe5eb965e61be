"""Sums beyond 64 bits."""

import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ionloom.operators.frames import exact_sum, narrowed
from ionloom.plans.catalog import QUERIES, mass_queries

SF = "/root/testdata/sf0.001"


def test_exact_sum(spark):
    values = [2**63 - 1, 2**63 - 1, -5, 2**40 + 7, -(2**62), None]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint").select(exact_sum(F.col("v")).alias("s"))
    assert rows.first()["s"] == Decimal(sum(v for v in values if v is not None))
    assert rows.where("false").schema["s"].dataType.simpleString() == "decimal(38,0)"


def test_narrowed_where_all_sums_fit(spark):
    rows = spark.range(3).select("id", F.col("id").cast("decimal(38,0)").alias("small"), (F.lit(2**62).cast("decimal(30,0)") * F.col("id")).cast("decimal(38,0)").alias("large"))
    got = narrowed(rows, ["small", "large"])
    assert got.dtypes == [("id", "bigint"), ("small", "bigint"), ("large", "decimal(38,0)")]
    assert {r["id"]: r["large"] for r in got.collect()} == {i: Decimal(2**62 * i) for i in range(3)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name, total, module, attribute, column", [
    ("modified_residue_masses", "total_nano", mass_queries.S, "residue_nano", None),
    ("running_residue_masses", "running_nano", mass_queries.L, "running_masses", "running_nano"),
])
def test_sums_of_masses_pass_64_bits(spark, monkeypatch, name, total, module, attribute, column):
    plain, heavy = getattr(module, attribute), F.lit(2**60)
    monkeypatch.setattr(module, attribute, lambda *a: heavy if column is None else plain(*a).withColumn(column, heavy))
    rows = QUERIES[name](spark, SF).collect()
    assert rows and all(r[total] == r["n"] * 2**60 for r in rows)
    assert max(r[total] for r in rows) > 2**63

"""What appends leave on disk."""

import pytest
from pyspark.sql import functions as F

from ionloom.operators import frames
from ionloom.sources import versions


def test_a_failed_append_leaves_no_folder(spark, tmp_path):
    base = str(tmp_path / "library")
    versions.create_versions(spark, base)
    rows = spark.sql("SELECT 'PEPTIDEK' AS PeptideSeq, false AS isDecoy, 'a' AS ProteinAccession")
    broken = rows.select(F.raise_error(F.lit("broken")).cast("string").alias("PeptideSeq"))
    with pytest.raises(Exception, match="broken"):
        versions.append_version(spark, base, {"peptidetoprotein": rows, "entries": broken})
    left = [p for t in ("peptidetoprotein", "entries") for p in (tmp_path / "library" / t).glob("*")]
    assert left == []
    assert versions.append_version(spark, base, {"peptidetoprotein": rows}).folders["peptidetoprotein"]


def test_many_keys_are_not_kept_on_disk(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(frames, "materialise", lambda df: kept.append(df) or df)
    rows = spark.range(100).withColumnRenamed("id", "k")
    assert frames.new_rows(rows, rows.where("k < 40"), ["k"], limit=0).count() == 60
    assert kept == []
    assert frames.new_rows(rows, rows.where("k < 40"), ["k"]).count() == 60
    assert len(kept) == 1

"""Every registered query against its SQL check, over the whole smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")

import __spark_entry__ as entry  # noqa: E402
from ionloom.plans.catalog import QUERIES, SQL  # noqa: E402


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def tidy(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = tidy(QUERIES[name](spark, SF).toPandas())
    sql = SQL.get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = tidy(duck.execute(sql).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, check_exact=True)


def test_whole_library_has_the_documents_of_all_languages(spark):
    whole = QUERIES["whole_library_exported_and_read_back"](spark, SF).select("PeptideModSeq", "PrecursorCharge").toPandas()
    assert len(whole) == len(whole.drop_duplicates()) > 0
    assert set(whole["PeptideModSeq"]) == set(QUERIES["library_precursors"](spark, SF).select("PeptideModSeq").toPandas()["PeptideModSeq"])


def test_entry(spark):
    assert entry.entry(spark).columns == ["PeptideModSeq", "PrecursorCharge", "mass", "PrecursorMz"]


def test_registered_queries_reach_the_driver():
    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())

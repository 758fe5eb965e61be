"""The stages of the pipeline one by one, and every registered query of this subpackage."""

import glob
import os
import random
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from ionloom.llm import queries

from .conftest import AWKWARD, DOC

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus: good and bad texts, near copies, texts without letters."""
    rows, labels = [], []
    for i in range(120):
        good = words(60, i)
        bad = " ".join(w + "***" for w in good.split())
        text = good if i % 3 else bad
        rows.append((i, text, "aa", "s", len(text), i))
        labels.append((i, int(i % 3 > 0), 0))
    for i in range(120, 130):      # near copies of document 1, and then junk
        text = words(60, 1) + f" tail{i}"
        rows.append((i, text, "aa", "s", len(text), 7))
    rows += [(130, "123 !!!", "aa", "s", 7, 7), (131, None, None, "s", 0, 7), (1, words(60, 1), "aa", "s", 0, 7)]
    path = str(tmp_path_factory.mktemp("corpus"))
    shape = "doc_id long, text string, lang string, source string, n_chars long, score long"
    spark.createDataFrame(rows, shape).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept, counts = docs.columns, docs, []
    for name, stage in pipeline.STAGES:
        kept = stage(spark, kept, folder).cache()
        if name != "best_fit_packing":
            assert kept.columns == columns
            counts.append(Counter(r["doc_id"] for r in kept.collect()))
    language, quality, single = counts
    assert set(language) == set(range(130)) and language[1] == 2
    assert set(quality) == {i for i in range(130) if i >= 120 or i % 3}
    assert single == Counter(i for i in range(120) if i % 3)       # 120 to 129 and the repeated row go
    assert Counter(r["doc_id"] for r in kept.where("piece = 0").collect()) == single
    whole = Counter(map(tuple, pipeline.run(spark, folder).select("doc_id", "piece", "length", "ids_crc32").collect()))
    assert whole == Counter(map(tuple, kept.select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_stages_with_awkward_rows(spark, folder, awkward, empty):
    for docs in (awkward.withColumn("lang", F.lit("aa")), empty.withColumn("lang", F.lit("aa"))):
        docs = docs.withColumn("_place", F.lit(1)).withColumn("a.b", F.lit("clash"))
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, folder)
            if name != "best_fit_packing":
                assert out.columns == docs.columns
            rows = out.count()
            assert rows == 0 or docs.count() > 0
    left = Counter(r["doc_id"] for r in pipeline.keep_one_of_near_copies(spark, awkward, folder).collect())
    assert left == {1: 1, 2: 1, 5: 1, None: 1, 9: 1}


def test_documents_without_any_language_stay(spark, folder, awkward):
    docs = awkward.withColumn("lang", F.lit(None).cast("string"))
    kept = pipeline.keep_known_language(spark, docs, folder)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == {1: 1, 5: 1, 6: 2, None: 1, 9: 1}


def test_near_copies_of_null_and_repeated_ids(spark, folder):
    a, b, c, d = (words(60, 900 + i) for i in range(4))
    rows = [(None, a), (None, a), (None, a + " x"), (None, b + " x"), (8, b), (5, c), (5, d), (5, d), (6, c + " z"), (7, d + " z")]
    docs = spark.createDataFrame(rows, DOC).withColumn("place", F.lit(7)).withColumn("_place", F.lit(8)).withColumn("a.b", F.lit(9))
    left = pipeline.keep_one_of_near_copies(spark, docs, folder)
    assert left.columns == docs.columns
    left = Counter((r["doc_id"], r["text"] if r["doc_id"] else r["text"][:50], r["place"], r["_place"]) for r in left.collect())
    assert left == Counter({(None, a[:50], 7, 8): 1, (8, b, 7, 8): 1, (5, c, 7, 8): 1, (5, d, 7, 8): 1})


@here
def test_registered_names():
    names = {n: entry.queries()[n] for n in entry.queries() if n.startswith("op") or n == "pipeline"}
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14))
    assert len(pipeline.STAGES) == 4 and pipeline.ORACLE_SQL is None


@here
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0
    sql = queries.SQL.get(name)
    if sql is None:
        return
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")

    def tidy(frame):
        frame = frame[sorted(frame.columns)].astype({c: "Int64" for c in frame if c in ("refers_to", "class_id")})
        return frame.sort_values(list(frame.columns)).reset_index(drop=True)

    pd.testing.assert_frame_equal(tidy(got), tidy(con.execute(sql).df()), check_dtype=False)

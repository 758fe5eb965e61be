import pytest
from pyspark.sql import types as T

public_tokenizers = pytest.importorskip("public_tokenizers")

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

AWKWARD = [
    (1, "the cat sat on the mat and the dog ran off to the wood"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, "x" * 5000),
    (6, "the cat sat on the mat and the dog ran off to the wood"),
    (6, "the cat sat on the mat and the dog ran off to the wood"),
    (None, "a text without an id, <|endoftext|> and 你好 𠀀"),
    (9, "don't 1's  two\n\n lines é ü ’quoted’ " * 400),
    (10, "!!! ???"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOC).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def bpe():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def pieces_path():
    return public_tokenizers.path("piece_bpe_32k.model")

"""Toxicity: the kernel and its folded form against brute force, obfuscated insults, awkward rows."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.llm import toxicity as tox

INSULTS = ["grumpf", "snollig", "vexquat"]
SYLLABLES = "ta re mi no la se du po ki ra tel mor san eth ing".split()


def prose(rng, words):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) + ("." if rng.random() < 0.1 else "") for _ in range(words))


def toxic(rng, words, insult=None):
    parts = prose(rng, words).split(" ")
    parts.insert(rng.randint(0, len(parts)), insult or rng.choice(INSULTS))
    return " ".join(parts)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows = [(i, toxic(rng, 20 + i % 60) if i % 4 == 0 else prose(rng, 20 + i % 60), int(i % 4 == 0)) for i in range(1200)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(6)


@pytest.fixture(scope="module")
def model(corpus):
    return tox.fit_toxicity(corpus.where("doc_id % 3 <> 1"), corpus.where("doc_id % 3 <> 1").select("doc_id", "toxic"))


def brute(symbols):
    """Subsequences of a row of symbols and their weights, by trying all places."""
    found = {}
    for first in range(tox.STRETCH):
        for rest in itertools.combinations(range(first + 1, first + tox.SPAN), tox.ORDER - 1):
            key = tuple(symbols[i] for i in (first, *rest))
            if tox.OUTSIDE not in key:
                found[key] = found.get(key, 0) + tox.DECAY ** (rest[-1] - first + 1)
    return found


def kernel(a, b):
    left, right = brute(a), brute(b)
    return sum(v * right.get(k, 0) for k, v in left.items())


def test_kernel_equals_brute_force():
    rng = np.random.default_rng(1)
    rows = rng.choice([0, 1, 2, 3, 31], size=(7, tox.WIDTH), p=[0.2, 0.3, 0.2, 0.2, 0.1]).astype(np.uint8)
    got = tox.nystrom(rows, rows[:4])
    want = [[kernel(a.tolist(), b.tolist()) for b in rows[:4]] for a in rows]
    assert got == pytest.approx(np.array(want), rel=1e-4)


def test_folded_weights_give_the_machine_on_landmarks():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 6, size=(60, tox.WIDTH)).astype(np.uint8)
    labels = rng.integers(0, 2, 60)
    marks = rows[:12]
    own = tox.nystrom(marks, marks).astype(np.float64)
    value, vector = np.linalg.eigh(own)
    whiten = vector[:, value > 1e-6 * value[-1]] / np.sqrt(value[value > 1e-6 * value[-1]])
    y = np.where(labels == 1, 1.0, -1.0)
    cost = np.where(labels == 1, 1 / labels.sum(), 1 / (60 - labels.sum()))
    w, bias = tox.fit_machine(tox.nystrom(rows, marks) @ whiten, y, cost)
    model = tox.learn(rows, labels, marks)
    assert bias == pytest.approx(model.bias, rel=1e-3)
    for row in rows[:5]:
        folded = sum(model.weights[k[0] << 15 | k[1] << 10 | k[2] << 5 | k[3]] * v for k, v in brute(row.tolist()).items())
        assert folded == pytest.approx(float(tox.nystrom(row[None], marks)[0] @ whiten @ w), abs=1e-3)


def test_the_machine_has_the_least_loss():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(80, 5)), np.where(rng.random(80) < 0.5, 1.0, -1.0)
    cost = np.full(80, 1 / 80)

    def loss(v):
        return (cost * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) ** 2).sum() + 1e-3 * (v[:-1] ** 2).sum() + 1e-9 * v[-1] ** 2

    w, bias = tox.fit_machine(x, y, cost)
    best = np.append(w, bias)
    assert all(loss(best) <= loss(best + rng.normal(0, 0.01, 6)) for _ in range(200))


def test_sums_of_stretches_equal_brute_force():
    rng = np.random.default_rng(5)
    weights = rng.normal(size=tox.CELLS).astype(np.float32) * tox.allowed()
    stream, first, _ = tox.streams(["Abc d-e. Next one!\nÉé 12", "", "x" * 40])
    sums = tox.stretch_sums(stream, weights)
    for at in range(int(first[-1])):
        part = np.append(stream[at : at + tox.WIDTH], np.full(tox.WIDTH, tox.OUTSIDE, np.uint8))[: tox.WIDTH]
        want = sum(weights[k[0] << 15 | k[1] << 10 | k[2] << 5 | k[3]] * v for k, v in brute(part.tolist()).items())
        assert sums[at] == pytest.approx(want, abs=1e-3)


@pytest.mark.parametrize("text", ["i-d-i.o t", "I D I O T", "idi​ot", "i*d*i*o*t", "idiot"])
def test_hidden_words_read_as_the_word(text):
    stream, _, _ = tox.streams([text])
    assert bytes(s for s in stream if s not in (tox.OUTSIDE, tox.SEPARATOR)) == bytes(ord(c) - 96 for c in "idiot")
    assert [s for s in stream if s != tox.OUTSIDE].count(tox.SEPARATOR) == 2


def test_nothing_crosses_a_sentence_or_a_text():
    stream, first, _ = tox.streams(["ab. cd", "ef"])
    assert tox.OUTSIDE in stream[first[0] + tox.SPAN : first[1] - tox.SPAN].tolist()
    assert all((stream[f : f + tox.SPAN] == tox.OUTSIDE).all() for f in first[:-1])


def test_held_out_documents(corpus, model):
    got = tox.score_toxicity(corpus, model, ["doc_id", "toxic"]).where("doc_id % 3 = 1").collect()
    assert len(got) == 400 and np.mean([r["toxic"] == r["predicted"] for r in got]) > 0.99
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(any(i in r["sentence"] for i in INSULTS) for r in got if r["toxic"] and r["predicted"])
    assert all(r["sentence"] is None for r in got if not r["predicted"])


@pytest.mark.parametrize("change", [str.upper, "-".join, " ".join, lambda w: w[:3] + "x" + w[3:], lambda w: w[:2] + "." + w[2:]])
def test_gaps_and_inserted_characters(model, change):
    rng = random.Random(8)
    texts = [toxic(rng, 40, change(insult)) for insult in INSULTS for _ in range(5)]
    margins, _, _ = model.margins(texts)
    clean, _, _ = model.margins([prose(rng, 60) for _ in range(100)])
    assert margins.min() > np.quantile(clean, 0.98)


def test_a_long_text_is_read_to_its_end(model):
    rng = random.Random(9)
    text = prose(rng, 400_000)
    score, said = model.score([text, text + " snollig " + text[:50], "x" * 3_000_000])
    assert score[1] > max(score[0], score[2]) and "snollig" in said[1]


def test_the_next_text_does_not_count():
    rng = np.random.default_rng(3)
    model = tox.ToxicityModel((rng.random(tox.CELLS) * tox.allowed()).astype(np.float32))
    texts = ["", "abc", " \n", "the end", "", "snollig grumpf", "x y", "", "vexquat " * 40, "!!!"]
    alone = [model.margins([text])[0][0] for text in texts]
    assert model.margins(texts)[0].tolist() == alone and alone[0] == alone[2] == alone[-1] == 0
    spans = [model.margins([text])[1:] for text in texts]
    assert np.array(model.margins(texts)[1:]).T.tolist() == [[int(a[0]), int(b[0])] for a, b in spans]


def test_awkward_rows(spark, awkward, empty, model, corpus):
    docs = awkward.withColumn("score", F.lit("clash")).withColumn("sentence.x", F.lit(1))
    rows = tox.score_toxicity(docs, model, ["doc_id", "score", "`sentence.x`"]).toDF("id", "clash", "dot", "score", "sentence", "predicted")
    got = rows.collect()
    assert len(got) == awkward.count() and all(r["clash"] == "clash" for r in got)
    by_id = {r["id"]: r["score"] for r in got}
    assert by_id[2] == by_id[3] == by_id[4] == by_id[10] < 0.5
    assert len({r["score"] for r in got if r["id"] == 6}) == 1
    assert tox.score_toxicity(empty, model).collect() == []
    none = tox.fit_toxicity(corpus, corpus.where("toxic = 1").select("doc_id", "toxic"))
    assert {r["score"] for r in tox.score_toxicity(awkward, none).collect()} == {0.5}
    odd = spark.createDataFrame([(1, 5), (2, None), (None, 1)], "doc_id long, toxic int")
    assert not len(tox.fit_toxicity(awkward, odd).weights) and not len(tox.fit_toxicity(empty, odd).weights)


def test_repeated_ids_of_the_sample_count_once(spark):
    docs = spark.range(20_000).select((F.col("id") % 2).alias("doc_id"), F.lit("same text").alias("text"))
    labels = spark.createDataFrame([(0, 0), (1, 1), (1, 1)], "doc_id long, toxic int")
    assert tox.sample_of(docs, labels, 100).count() == 2

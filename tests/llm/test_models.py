"""Language and quality models: gradients, codes, held-out accuracy and awkward rows."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.llm import codes, language, quality

from .conftest import AWKWARD


def words(alphabet, n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(alphabet, k=rng.randint(2, 7))) for _ in range(n))


ALPHABETS = {"aa": "abcde", "bb": "defgh", "cc": "ghijk", "dd": "kléüa", "ee": "mnopq"}


@pytest.fixture(scope="module")
def languages(spark):
    rows = [
        (i, words(ALPHABETS[lang], 4 + i % 60, i), lang)
        for i, lang in enumerate(itertools.islice(itertools.cycle(ALPHABETS), 1000))
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)


@pytest.mark.parametrize("n, bits, apart", [(2, 1, 1), (3, 3, 2), (4, 7, 4), (7, 63, 32), (30, 50, 10)])
def test_codewords_are_apart(n, bits, apart):
    code = language.codewords(n)
    assert code.shape == (n, bits) and set(np.unique(code)) <= {-1, 1}
    least = min((a != b).sum() for a, b in itertools.combinations(code, 2))
    assert least >= apart
    assert all(len(set(column)) == 2 for column in code.T)


def test_held_out_languages(languages):
    held_out = language.held_out(F.col("doc_id"), 4, 2)
    model = language.fit_languages(languages.where(~held_out))
    got = language.identify(languages, model, ["doc_id", "lang"]).where(held_out).collect()
    assert len(got) > 200
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.99
    assert all(0 <= r["score"] <= 1 for r in got)


def test_sampled_fit_predicts_alike(languages):
    model = language.fit_languages(languages, sample=60)
    got = language.identify(languages, model, ["doc_id", "lang"]).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.98


def test_unseen_letters_are_ambiguous(languages):
    model = language.fit_languages(languages)
    names, scores, flags = model.predict([words(ALPHABETS["aa"], 50, 1)])
    assert names == ["aa"] and not flags[0] and scores[0] > 0.99
    unseen = next(c for c in map(chr, range(0x400, 0x460)) if not model.margins([c])[0].any())
    _, scores, flags = model.predict([unseen])
    assert flags[0] and scores[0] == pytest.approx(1 / len(ALPHABETS))


def test_decoding_picks_the_smallest_loss(languages):
    model = language.fit_languages(languages)
    texts = [words(ALPHABETS["bb"], 3, s) for s in range(5)]
    margin, _ = model.margins(texts)
    for row, name in zip(margin, model.predict(texts)[0]):
        losses = [sum(np.log1p(np.exp(-m * c)) for m, c in zip(row, code)) for code in model.code]
        assert name == model.languages[int(np.argmin(losses))]


def test_languages_of_awkward_rows(awkward, empty, languages):
    model = language.fit_languages(languages)
    docs = awkward.withColumn("score", F.lit("clash")).withColumn("lang.pred", F.lit(1))
    rows = language.identify(docs, model, ["doc_id", "score", "`lang.pred`"]).toDF("id", "clash", "dot", "lang", "score", "flag")
    got = {r["id"]: r for r in rows.collect()}
    assert rows.count() == len(AWKWARD)
    assert all(got[i]["lang"] == "und" and got[i]["score"] == 0 for i in (2, 3, 4, 10))
    assert got[5]["lang"] in ALPHABETS
    assert language.identify(empty, model).collect() == []
    none = language.fit_languages(empty.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language.identify(awkward, none).collect()} == {"und"}


def test_letters_are_counted_once_per_text():
    array, starts, has = codes.padded_letters(["aB", "", "1", "𝐀"])
    assert [len(x) for x in np.split(array[:-2], starts[1:])] == [4, 2, 3, 3]
    assert has.tolist() == [True, False, False, True]


# ---- quality


def documents():
    rows = []
    for i in range(400):
        good = words("abcdefgh", 30 + i % 90, i)
        kind = i % 4
        if kind == 0:
            rows.append((i, good, 1))
        elif kind == 1:      # one bad passage in a good document
            bad = " ".join(w + random.Random(i).choice(["***", "%%%"]) for w in words("abcdefgh", 60, -i).split())
            rows.append((i, f"{good}\n{bad}\n{good}", 0))
        elif kind == 2:
            rows.append((i, good + "\n" + words("abcdefgh", 30, i + 9), 1))
        else:
            rows.append((i, " ".join([good.split()[0]] * 80), 0))
    return rows


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame(documents(), "doc_id long, text string, quality int").repartition(4)


def test_held_out_quality(labelled):
    held_out = language.held_out(F.col("doc_id"), 5, 0)
    model = quality.fit_quality(labelled, labelled.where(~held_out))
    got = quality.score_quality(labelled, model, ["doc_id", "quality"]).where(held_out).collect()
    assert len(got) > 50
    assert np.mean([r["quality"] == r["predicted"] for r in got]) > 0.95


def test_attention_finds_the_bad_passage(labelled):
    model = quality.fit_quality(labelled, labelled)
    bad = next(t for i, t, q in documents() if i % 4 == 1 and len(t) > 1500)
    features, count = quality.passages([bad])
    found = model.forward(features, np.array([0]))
    symbols = np.array([sum(c in "*%" for c in bad[i : i + quality.PASSAGE]) for i in range(0, len(bad), quality.PASSAGE)])
    assert found["a"].sum() == pytest.approx(1, abs=1e-5)
    assert symbols[found["a"].argmax()] > 0


def test_gradients():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, quality.FEATURES)).astype(np.float64) for n in (1, 3, 2, 4)]
    label, weight = np.array([0, 1, 1, 0]), np.array([1.0, 2.0, 1.0, 0.5])
    model = quality.learn([b.astype(np.float32) for b in bags], label)
    model.weights = {k: v.astype(np.float64) + rng.normal(0, 0.1, v.shape) for k, v in model.weights.items()}
    flat, starts = np.concatenate(bags), np.array([0, 1, 4, 6])

    def loss():
        p = model.forward(flat, starts)["p"]
        return (-(label * np.log(p) + (1 - label) * np.log(1 - p)) * weight).mean()

    for name, gradient in model.gradients(flat, starts, label, weight).items():
        for _ in range(3):
            at = tuple(rng.integers(n) for n in model.weights[name].shape)
            old = model.weights[name][at]
            model.weights[name][at] = old + 1e-5
            up = loss()
            model.weights[name][at] = old - 1e-5
            down = loss()
            model.weights[name][at] = old
            assert gradient[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7)


def test_passages_cover_whole_texts():
    texts = ["", "a" * 256, "b" * 257, "Ab 1!\n" * 1000]
    features, count = quality.passages(texts)
    assert count.tolist() == [1, 1, 2, 24] and len(features) == 28
    assert (features[0] == 0).all()
    assert np.isfinite(features).all()
    alone = np.concatenate([quality.passages([t])[0] for t in texts])
    np.testing.assert_allclose(features, alone, rtol=1e-6)


def test_quality_of_awkward_rows(awkward, empty, labelled):
    model = quality.fit_quality(labelled, labelled)
    docs = awkward.withColumn("score", F.lit("clash")).withColumn("predicted", F.lit(0))
    got = quality.score_quality(docs, model).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(k for k, _ in AWKWARD)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 6)}) == 1
    assert quality.score_quality(empty, model).collect() == []
    nothing = quality.fit_quality(empty, empty.withColumn("quality", F.lit(1)))
    assert {r["score"] for r in quality.score_quality(awkward, nothing).collect()} == {0.5}
    odd = labelled.withColumn("quality", F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 3 == 1, 7).otherwise(F.col("quality")))
    assert quality.fit_quality(labelled, odd.unionByName(odd)).weights

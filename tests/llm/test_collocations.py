"""Collocations: brute force over random texts, several rounds, exact cuts, awkward rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ionloom.llm import collocations as col

SHAPE = "doc_id long, text string, lang string"


def brute(rows, first, least):
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if a >= least and len(p) > 1}
        covered = set()
        for q, b in often.items():
            for k in range(2, len(q)):
                for i in range(len(q) - k + 1):
                    if 100 * b >= 80 * f[q[i : i + k]]:
                        covered.add(q[i : i + k])
        rows_ = []
        for p, a in often.items():
            cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            if p not in covered:
                rows_.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows_)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def got(docs, **how):
    return sorted(tuple(r) for r in col.collocations(docs, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts(n, seed, words=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["Über", "é", "ÀB"]
    fixed = [["new", "york", "city", "hall"], ["ad", "hoc"], ["in", "the", "end"], ["a", "a", "a", "a", "a"]]
    for i in range(n):
        out = []
        for _ in range(rng.randint(0, 60)):
            out += rng.choice(fixed) if rng.random() < 0.2 else [vocabulary[int(rng.paretovariate(0.7)) % len(vocabulary)]]
        yield i, "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", ": "]) for w in out), rng.choice(["en", "de", None])


@pytest.mark.parametrize("first, least", [(2000, 5), (3, 5), (1, 3)])
def test_equals_brute_force(spark, first, least):
    rows = list(texts(300, first + least))
    assert got(spark.createDataFrame(rows, SHAPE).repartition(5), first=first, least=least) == brute(rows, first, least)


def test_lowered_cuts_settle_every_language(spark, monkeypatch):
    """Many copies of one long phrase: its pairs score high and are all covered."""
    monkeypatch.setattr(col, "STEPS", 1)
    monkeypatch.setattr(col, "AHEAD", 1)
    rng = random.Random(1)
    rows = [(i, " ".join(f"x{j}" for j in range(k, k + 4)) + ".", "en") for i, k in enumerate([*range(0, 160, 4)] * 12)]
    rows += [(i, " ".join(rng.choices([f"y{j}" for j in range(12)], k=30)), "en") for i in range(60)]
    rounds = []
    plain = col.expand
    monkeypatch.setattr(col, "expand", lambda *a: rounds.append(a[2].collect()) or plain(*a))
    assert got(spark.createDataFrame(rows, SHAPE).repartition(3), first=41, least=5) == brute(rows, 41, 5)
    assert len(rounds) > 1 and rounds[0][0]["cut"] > rounds[-1][0]["cut"]


def test_awkward_rows(spark):
    rows = [(1, None, None), (2, "", "en"), (None, " \t .,;", "en"), (3, "A\x0bB A B a b", "und"), (4, "A\x0bB A B a b", None), (4, "A\x0bB A B a b", None)]
    rows += [(5, "\xa0 x\x00y " * 50, "zz"), (6, "w" * 70_000 + " " + "v" * 300 + " ", "zz")] * 3 + [(7, "é É é É, Ab aB AB ab", "")] * 3
    docs = spark.createDataFrame(rows, SHAPE)
    clash = docs.withColumns({n: F.lit("c") for n in ("phrase", "rank", "n", "key", "a.b")})
    assert got(docs, least=3) == got(clash, least=3) == brute(rows, 2000, 3) != []
    assert got(spark.createDataFrame([], SHAPE)) == []
    assert got(spark.createDataFrame([(1, "a b", "en")], SHAPE)) == []


def test_a_very_long_text(spark):
    rng = random.Random(3)
    rows = [(1, " ".join(rng.choices(["a", "b", "c", "d"], k=300_000)), "en"), (2, "q r. " * 400_000, "en")]
    assert got(spark.createDataFrame(rows, SHAPE)) == brute(rows, 2000, 30)


@pytest.mark.parametrize("size", [1, 7, 40, 10_000])
def test_chunks_keep_words_and_pieces(size):
    rows = list(texts(60, 2))
    batch = pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows]), pa.array([r[1] for r in rows])], ["lang", "text"])

    def pairs(parts):
        return Counter((p.langs[p.lang[i]], p.phrase(i, 2)) for p in parts for i in np.flatnonzero(p.follows))

    whole = pairs(col.words_of(batch, 0, 1 << 30))
    assert pairs(col.words_of(batch, 0, size)) == whole and sum(whole.values()) > 500


def test_keys_are_of_words_and_languages():
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de", "en"]), pa.array(["one OnE two " + "l" * 400, "one", "one " + "L" * 400 + " abcdefgh abcdefghi"])], ["lang", "text"])
    (words,) = col.words_of(batch, 0)
    names = [(words.langs[words.lang[i]], words.phrase(i, 1)) for i in range(len(words.start))]
    assert len(set(words.key.tolist())) == len(set(names)) == 6
    assert all((a == b) == (words.key[i] == words.key[j]) for i, a in enumerate(names) for j, b in enumerate(names))


def test_a_clash_of_keys_takes_another_seed(spark, monkeypatch):
    rows = [(i, "a b c d", "en") for i in range(40)]
    plain = col._count_words

    def clashing(batches, seed):
        for batch in plain(batches, seed):
            if seed == 0:
                batch = batch.set_column(2, "key", pa.array(np.zeros(batch.num_rows, np.int64)))
            yield batch

    monkeypatch.setattr(col, "_count_words", clashing)
    _, _, seed = col.count_words(spark.createDataFrame(rows, SHAPE).select("lang", "text"), 30)
    assert seed == 1


def test_grouping_of_equal_names(monkeypatch):
    monkeypatch.setattr(col, "joined", lambda *parts: np.zeros(len(parts[0]), np.uint64))
    a, b = np.array([1, 1, 2, 1], np.uint64), np.array([5, 6, 5, 5], np.uint64)
    first, n = col.grouped([a, b])
    assert sorted(zip(a[first].tolist(), b[first].tolist(), n.tolist(), strict=True)) == [(1, 5, 2), (1, 6, 1), (2, 5, 1)]

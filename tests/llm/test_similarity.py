"""Fingerprints, components, the n-gram join and the hash forest against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.llm import fingerprints, hash_forest, jaccard
from ionloom.llm.components import components

from .conftest import AWKWARD, DOC


def word_grams(text, words=5):
    parts = [""] * (words - 1) + (text or "").split()
    return {tuple(parts[i : i + words]) for i in range(len(parts) - words + 1)}


def near(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def sentence(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(n))


# ---- fingerprints


def test_edited_fingerprints(spark):
    texts = ["", None, "one", "a b c d e f g h", sentence(1, 300), sentence(1, 300) + " more", sentence(2, 3000), "é" * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), DOC).withColumn("next", F.lit(1)).repartition(3)
    rows = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs).collect()}
    assert sorted(rows) == list(range(len(texts)))
    for i, text in enumerate(texts):
        text, after = text or "", texts[(i + 1) % len(texts)] or ""
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        row = rows[i]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["near_edited"] == pytest.approx(near(word_grams(text), word_grams(edited)), abs=0.15)
        assert row["near_next"] == pytest.approx(near(word_grams(text), word_grams(after)), abs=0.15)
        assert row["distinct_shingles"] == pytest.approx(len(word_grams(text)), rel=0.3)
        assert len(row["fingerprint"]) == 16 * min(len(word_grams(text)), fingerprints.K)
    assert rows[0]["fingerprint"] == rows[1]["fingerprint"] == ""


def test_fingerprints_of_awkward_rows(awkward, empty):
    rows = fingerprints.edited_fingerprints(awkward).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(k for k, _ in AWKWARD)
    same = {r["fingerprint"] for r in rows if r["doc_id"] in (1, 6)}
    assert len(same) == 1
    assert fingerprints.edited_fingerprints(empty).collect() == []
    one = awkward.where("doc_id = 1")      # its own next
    assert fingerprints.edited_fingerprints(one).first()["near_next"] == 1.0


def test_sketches_merge_like_sets(spark):
    a, b = sentence(3, 400), sentence(4, 500)
    docs = spark.createDataFrame([(1, a), (1, b), (2, a), (3, None)], DOC)
    sketched = docs.withColumn("s", fingerprints.sketch(F.col("text"), 64))
    merged = {r["doc_id"]: r["s"] for r in fingerprints.merge_rows(sketched, ["doc_id"], "s", 64).collect()}
    whole = spark.createDataFrame([(0, a + " " + " ".join(["x"] * 0))], DOC)
    assert merged[2] == whole.select(fingerprints.sketch(F.col("text"), 64).alias("s")).first()["s"]
    assert merged[3] == []
    by_row = [r["s"] for r in sketched.where("doc_id = 1").collect()]
    assert merged[1] == sorted(set(by_row[0]) | set(by_row[1]))[:64]
    pair = spark.createDataFrame([(by_row[0], merged[1])], "a array<long>, b array<long>")
    row = pair.select(
        fingerprints.containment(F.col("a"), F.col("b"), 64).alias("c"),
        fingerprints.resemblance(F.col("a"), F.col("b"), 64).alias("r"),
        fingerprints.distinct_shingles(F.col("b"), 64).alias("n"),
    ).first()
    assert row["c"] == 1.0 and row["r"] == pytest.approx(400 / 900, abs=0.2) and row["n"] == pytest.approx(900, rel=0.4)


def test_fingerprints_run_without_python(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], DOC)
    plan = fingerprints.edited_fingerprints(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- components


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)]
    edges += [(i, i + 1) for i in range(400, 460)] + [(500, n) for n in range(501, 600)] + [(7, 7), (None, 3)]
    parent = {n: n for e in edges for n in e if n is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["u"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for a, b in edges for n in (a, b) if a is not None and a != b}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


# ---- n-gram join


def brute_join(rows):
    def grams(text):
        words = re.findall(r"\w+", (text or "").lower())
        return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()

    sets = [grams(t) for _, t in rows]
    linked = [[j for j in range(len(rows)) if j != i and near(sets[i], sets[j]) >= 0.8] for i in range(len(rows))]
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in linked[i])], key=lambda r: rows[r][0]) for i in range(len(rows))]
    return {rows[i][0]: (rows[root[i]][0], len(linked[i])) for i in range(len(rows))}


def varied(n_groups, copies, seed):
    """Groups of texts of many lengths, with near copies, exact copies and unrelated texts."""
    rng, rows = random.Random(seed), []
    for g in range(n_groups):
        words = sentence((seed, g).__hash__(), rng.choice([3, 5, 12, 60, 400])).split()
        for _ in range(rng.randint(1, copies)):
            mine = list(words)
            for _ in range(rng.randint(0, max(1, len(mine) // 40))):
                mine[rng.randrange(len(mine))] = rng.choice(["zz", "yy", "xx"])
            if rng.random() < 0.3:
                mine = mine[: rng.randint(len(mine) * 8 // 10, len(mine))]
            rows.append((len(rows) * 3 + 1, " ".join(mine)))
    return rows


@pytest.mark.parametrize("block", [512, 7])
def test_join_equals_brute_force(spark, monkeypatch, block):
    """Also with blocks so small that groups are cut by size and by hash."""
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", block)
    rows = varied(25, 14, 1) + [(9001, ""), (9002, None), (9003, " .. ")]
    docs = spark.createDataFrame(rows, DOC).withColumn("class_id", F.lit("clash")).repartition(4)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_join(docs).collect()}
    assert got == brute_join(rows)


def test_join_of_one_hot_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 40)
    base = sentence(8, 200).split()
    rows = []
    for i in range(150):
        words = list(base)
        words[i % 180] = f"w{i}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_join(spark.createDataFrame(rows, DOC)).collect()}
    assert got == brute_join(rows) and got[0] == (0, 149)


@pytest.mark.parametrize("texts", [2, 3])
def test_join_of_blocks_of_one_text(spark, monkeypatch, texts):
    """Few texts of many n-grams: some of the hash blocks are empty."""
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 210)
    rows = []
    for g in range(12):
        words = sentence(70 + g, 200).split()
        rows += [(10 * g + i, " ".join([*words, *[f"w{i}"] * (i % 2)])) for i in range(texts)]
        rows.append((10 * g + 9, " ".join(words[:170])))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_join(spark.createDataFrame(rows, DOC)).collect()}
    assert got == brute_join(rows)


def test_join_of_awkward_rows(awkward, empty):
    got = Counter(map(tuple, jaccard.jaccard_join(awkward).collect()))
    assert got[(6, 1, 1, 2)] == 2 and got[(1, 1, 1, 2)] == 1
    assert got[(2, 2, 2, 3)] == got[(3, 2, 2, 3)] == got[(4, 2, 2, 3)] == got[(10, 2, 2, 3)] == 1
    assert got[(None, None, None, 0)] == 1 and sum(got.values()) == len(AWKWARD)
    assert jaccard.jaccard_join(empty).collect() == []


def test_join_of_null_and_repeated_ids(spark):
    """Near copies of rows without an id, and different texts of one id."""
    a, b, c = (sentence(90 + i, 60) for i in range(3))
    rows = [(None, a), (None, a), (None, a + " x"), (8, a + " y"), (5, b), (5, c), (6, b + " z"), (7, c + " z"), (None, sentence(95, 60)), (None, sentence(95, 60) + " x")]
    got = Counter(map(tuple, jaccard.jaccard_join(spark.createDataFrame(rows, DOC).repartition(3)).collect()))
    assert got == Counter({
        (None, 8, None, 3): 3, (8, 8, 8, 3): 1, (5, 5, 5, 1): 2, (6, 5, 6, 1): 1, (7, 5, 7, 1): 1, (None, None, None, 1): 2,
    })


def test_linked_pairs_of_frequent_and_rare_grams():
    rng = np.random.default_rng(3)
    core = rng.integers(1 << 60, size=120, dtype=np.uint64)
    sets = [np.unique(np.append(core[rng.random(120) < 0.93], rng.integers(1 << 60, size=rng.integers(1, 25), dtype=np.uint64))) for _ in range(60)]
    got = jaccard.linked(sets, 0.8)
    for i in range(60):
        for j in range(60):
            assert got[i, j] == (i != j and near(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8)


def test_recall_of_the_bands():
    rng, hits = np.random.default_rng(5), 0
    for _ in range(300):
        shared = rng.integers(1 << 60, size=80, dtype=np.uint64)
        a, b = (np.unique(np.append(shared, rng.integers(1 << 60, size=10, dtype=np.uint64))) for _ in range(2))
        x, y = jaccard.band_hashes([a, b])
        hits += (x == y).any()
    assert hits >= 298      # Jaccard 0.8: expected share 0.9998


# ---- hash forest


def exact(ids, vectors, queries, k):
    out = {}
    for q in queries:
        scores = vectors @ vectors[ids.index(q)]
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-scores[i], ids[i]))
        out[q] = [ids[i] for i in order[:k]]
    return out


def test_forest_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(600, 16)) * rng.uniform(0.2, 3, (600, 1))      # unequal norms
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    want = exact(list(range(600)), vectors, range(0, 600, 20), 20)
    for share, least in ((float(hash_forest.TREES), 1.0), (hash_forest.SHARE, 0.9)):
        got = hash_forest.nearest(table, F.col("vec_id") % 20 == 0, share=share, shard_rows=250).collect()
        found = {}
        for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
            found.setdefault(r["query_id"], []).append(r["vec_id"])
            assert r["score"] == pytest.approx(vectors[r["query_id"]] @ vectors[r["vec_id"]], rel=1e-12, abs=1e-12)
        assert set(found) == set(want) and all(len(v) == 20 for v in found.values())
        assert np.mean([len(set(found[q]) & set(want[q])) / 20 for q in want]) >= least


def test_forest_of_an_id_with_many_rows(spark):
    """One id has most of a shard's rows, equal and different ones, all nearer than any other's."""
    rng = np.random.default_rng(4)
    near = np.array([5.0] + [0.0] * 7)
    rows = [(0, near.tolist()), (0, (-near).tolist())]
    rows += [(1, (near * 2 + rng.normal(size=8) * 0.01).tolist()) for _ in range(1500)] + [(1, (near * 2).tolist())] * 300
    rows += [(i, rng.normal(size=8).tolist()) for i in range(2, 40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, hash_forest.nearest(table, F.col("vec_id") == 0, shard_rows=1000).collect()))
    best = {}
    for q in (near, -near):
        for i, v in rows[2:]:
            best[i] = max(best.get(i, -np.inf), float(q @ np.array(v)))
    want = sorted(best, key=lambda i: (-best[i], i))[:20]
    assert [r[1] for r in got] == list(range(1, 21)) and [r[2] for r in got] == want
    assert [r[3] for r in got] == pytest.approx([best[i] for i in want])


def test_forest_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 0.0]), (9, [None, 1.0]), (10, [1.0, 2.0, 3.0]), (None, [9.0, 9.0]), (2, [1.0, 0.0]), (40, [0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, hash_forest.nearest(table, F.col("vec_id") % 20 == 0).collect()))
    assert got == [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 20, 1.0), (20, 1, 0, 1.0), (20, 2, 2, 1.0), (20, 3, 3, 1.0)]
    assert hash_forest.nearest(table.limit(0), F.col("vec_id") % 20 == 0).collect() == []

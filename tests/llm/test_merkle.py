"""Merkle manifest: closed positions, trees and proofs against a plain recursion, awkward rows."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F, types as T

from ionloom.llm import merkle

ROW = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    return h("".join(field(row[n]) for n in merkle.FIELDS[:-1]) + field(text))


def tree(nodes):
    """Levels of nodes, the lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        first = i - i % 3
        yield "".join(level[first:i]), "".join(level[i + 1 : first + 3])
        i //= 3


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["source"], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: None for s in order}
    for s in order:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[s] = tree([leaf(r, r["text"]) for r in groups[s]])
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for place, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            text, path = r["text"], [*siblings(trees[s], i), *siblings(top, place)]
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            now = leaf(r, text.replace("\n", "") if hit and text is not None else text)
            for a, b in path:
                now = h(a + now + b)
            root, proof = top[-1][0], h("".join(a + b for a, b in path))
            out.append((r["doc_id"], leaf(r, text), trees[s][-1][0], root, proof, now, now == root))
    return sorted(out, key=str)


def got(docs):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted([tuple(r[n] for n in names) for r in merkle.verified_manifest(docs).collect()], key=str)


@pytest.mark.parametrize("leaves", [1, 2, 3, 4, 9, 10, 26, 27, 28, 82])
def test_positions_are_those_of_the_order_of_completion(leaves):
    top = merkle.height(leaves)
    log = merkle.postorder([b"%d" % i for i in range(leaves)], top)
    assert len(log) == merkle.position(leaves, top, top) + 1
    levels = tree([str(i) for i in range(leaves)])
    for level, nodes in enumerate(levels):
        for i, node in enumerate(nodes):
            assert log[merkle.position(min((i + 1) * 3**level, leaves), level, top)].decode() == node


@pytest.mark.parametrize("leaves", [1, 5, 27, 40])
def test_siblings_of_a_block(leaves):
    levels = tree([str(i) for i in range(leaves)])
    log = [x.decode() for x in merkle.postorder([b"%d" % i for i in range(leaves)], merkle.height(leaves))]
    found = merkle.siblings(log, leaves, merkle.height(leaves))
    for i in range(leaves):
        assert [(a[i // 3**k], b[i // 3**k]) for k, (a, b) in enumerate(found)] == list(siblings(levels, i))


def test_several_blocks_and_rounds(spark, monkeypatch):
    rows = [{"doc_id": i * 7 % 40_009, "text": f"row {i}\n", "lang": "en", "source": "hot" if i % 3 else f"s{i % 11}", "n_chars": i} for i in range(9_000)]
    docs = spark.createDataFrame(rows, ROW).repartition(7)
    assert got(docs) == expected(rows)


def test_log_holds_every_node_once(spark):
    rows = [{"doc_id": i, "text": "t", "lang": None, "source": "a", "n_chars": None} for i in range(7_000)]
    manifest = merkle.build_manifest(spark.createDataFrame(rows, ROW).repartition(5))
    log = merkle.append_log(manifest.rounds).orderBy("position").collect()
    assert len(manifest.rounds) == 2
    plain = merkle.postorder([leaf(r, "t").encode() for r in rows], merkle.height(len(rows)))
    assert [r["position"] for r in log] == list(range(len(plain)))
    assert [r["node"].encode() for r in log] == plain


def test_awkward_rows(spark):
    whole = T.StructType([T.StructField(n, T.LongType() if n in ("doc_id", "n_chars") else T.StringType()) for n in ("doc_id", "text", "lang", "source", "n_chars")])
    rows = [
        (1, "a\nb", "en", "x", 3), (1, "a\nb", "en", "x", 3), (1, "other\n", "en", "x", None), (2, None, None, None, None),
        (3, "", "de", "", 0), (None, "no\nid", "en", "x", 5), (None, None, None, None, None), (4, "ü" * 10 + "\n𠀀", "fr", "é", 12),
        (5, "long \n" * 300_000, "en", "Z", 1_800_000), (-6, "\n", "en", "=x", 1),
    ]
    plain = [dict(zip(whole.names, r, strict=True)) for r in rows]
    docs = spark.createDataFrame(rows, whole).repartition(4)
    clash = docs.withColumns({n: F.lit("clash") for n in ("tree", "place", "leaf", "root", "n.x", "at", "block")})
    assert got(docs) == got(clash) == expected(plain)


def test_no_rows_and_one_row(spark):
    empty = spark.createDataFrame([], ROW)
    assert merkle.verified_manifest(empty).collect() == []
    one = [{"doc_id": 9, "text": "t", "lang": None, "source": None, "n_chars": 1}]
    (row,) = got(spark.createDataFrame(one, ROW))
    assert row[1] == row[2] == row[3] == row[5] and row[4] == h("") and row[6]
    assert [row] == expected(one)


def test_a_changed_sibling_gives_another_root(spark):
    rows = [{"doc_id": i, "text": f"{i}", "lang": "en", "source": "a", "n_chars": 1} for i in range(10)]
    before, after = (merkle.build_manifest(spark.createDataFrame(r, ROW)).root for r in (rows, [*rows[:-1], {**rows[-1], "text": "x"}]))
    assert before != after

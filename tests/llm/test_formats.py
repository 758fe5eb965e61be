"""ARC to WARC, and n-best SentencePiece segmentations, by round trip and brute force."""

import gzip
import hashlib
import io
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.llm import pieces, warc

from .conftest import AWKWARD

PAGE = "page_id long, url string, html string"


def stream(data):
    return io.BufferedReader(io.BytesIO(data))


def expected(pages):
    """(page id, bytes, digest, type, refers to) as the contract has them; ids are distinct."""
    first = {}
    for page, _, html in pages:
        payload = (html or "").encode()
        if len(payload) >= 100 and page is not None:
            first[payload] = min(first.get(payload, page), page)
    out = Counter()
    for page, _, html in pages:
        payload = (html or "").encode()
        target = first.get(payload)
        revisit = target is not None and target != page
        out[page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", target if revisit else None] += 1
    return out


def found(rows):
    return Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows)


def test_archives_round_trip(spark):
    long = "<html>" + "é" * 200_000
    pages = [(i, f"http://x/{i}", "p" * 100 if i % 3 == 0 else f"page {i}") for i in range(60)]
    pages += [(100, None, None), (101, "", ""), (102, "http://a b\nc/ü", "q" * 99), (103, "u", "q" * 99), (104, "u", long), (99, "u", long)]
    pages += [(105, "u", "WARC/1.0\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" * 9), (None, "u", "z" * 150), (106, "u", "z" * 150)]
    df = spark.createDataFrame(pages, PAGE).withColumn("path", F.lit("clash")).repartition(4)
    assert found(warc.archive_round_trip(df).collect()) == expected(pages)


def test_repeated_pages_have_one_response(spark):
    pages = [(1, "u", "r" * 200)] * 3 + [(None, "u", "n" * 200)] * 2
    rows = warc.archive_round_trip(spark.createDataFrame(pages, PAGE)).collect()
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in rows)
    assert kinds == {(1, "response", None): 1, (1, "revisit", 1): 2, (None, "response", None): 1, (None, "revisit", None): 1}
    assert warc.archive_round_trip(spark.createDataFrame([], PAGE)).collect() == []


@pytest.mark.parametrize("version", [1, 2])
def test_both_arc_versions(version):
    block = b"HTTP/1.0 200 OK\nContent-Type: text/plain\n\nbody\n\n with lines"
    fields = {"URL": "http://x/with space", "IP-address": "1.2.3.4", "Archive-date": "20010203040506", "Content-type": "text/plain"}
    data = warc.arc_opening(version, "a.arc", "20010203") + warc.arc_bytes(version, fields, block) + warc.arc_bytes(version, fields, b"")
    for raw in (data, gzip.compress(data)):
        source = stream(raw)
        if raw[:2] == b"\x1f\x8b":
            source = io.BufferedReader(gzip.GzipFile(fileobj=source))
        records = list(warc.read_arc(source))
        assert [r.block for r in records[1:]] == [block, b""]
        assert records[1].fields["URL"] == "http://x/with space"
        assert ("Result-code" in records[1].fields) == (version == 2)
    with pytest.raises(ValueError):
        list(warc.read_arc(stream(data[:-8])))
    with pytest.raises(ValueError):
        list(warc.read_arc(stream(data.replace(f"{version} 0 ionloom".encode(), b"7 0 ionloom"))))


def test_synthesised_records():
    record = warc.ArcRecord(3, {"URL": "http://x/", "IP-address": "1.2.3.4", "Archive-date": "20010203040506", "Content-type": "text/html"}, b"HTTP/1.1 200 OK\r\nA: b\r\n\r\npayload")
    target = {"record_id": "urn:uuid:0", "url": "http://y/", "date": "1999"}
    for given in (None, target):
        (headers, block), *rest = warc.read_warc(stream(warc.to_warc(record, "f/a.arc.gz", given)))
        assert not rest
        assert headers["warc-date"] == "2001-02-03T04:05:06Z"
        assert headers["warc-record-id"] == f"<{warc.record_id('g/a.arc.gz', 3)}>"
        assert headers["warc-payload-digest"] == "sha256:" + hashlib.sha256(b"payload").hexdigest()
        assert headers["warc-block-digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
        assert headers["warc-type"] == ("response" if given is None else "revisit")
    assert headers["warc-refers-to-date"] == "1999-01-01T00:00:00Z" and headers["warc-refers-to"] == "<urn:uuid:0>"
    other = warc.ArcRecord(1, {**record.fields, "Content-type": "text/dns"}, b"20010203 dns")
    headers, _ = next(warc.read_warc(stream(warc.to_warc(other, "a"))))
    assert headers["warc-type"] == "resource" and headers["content-type"] == "text/dns"
    info, _ = next(warc.read_warc(stream(warc.to_warc(warc.ArcRecord(0, record.fields, b""), "a"))))
    assert info["warc-type"] == "warcinfo"


@pytest.mark.parametrize("date, time", [("19961126142103", "1996-11-26T14:21:03Z"), ("19961399", "1996-01-01T00:00:00Z"), ("1996", "1996-01-01T00:00:00Z"), ("", "1970-01-01T00:00:00Z"), ("x", "1970-01-01T00:00:00Z")])
def test_times(date, time):
    assert warc.iso_time(date) == time


# ---- SentencePiece


@pytest.fixture(scope="module")
def model(pieces_path):
    return pieces.PieceModel(pieces_path)


def all_segmentations(model, text):
    whole, out = model.library.normalize(text), []

    def go(i, score, ids):
        if i == len(whole):
            out.append((score, tuple(ids)))
            return
        for j in range(i + 1, len(whole) + 1):
            piece = model.ids.get(whole[i:j])
            if piece is not None:
                go(j, score + model.library.get_score(piece), [*ids, piece])
        if whole[i] not in model.ids:
            go(i + 1, score + model.unknown_score, ids + model.ids_of(whole, [i, i + 1]))

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


def short_texts():
    rng = random.Random(4)
    fixed = ["", "a", "the cat", "éê x².", " 12 a,b", "你𠀀 the", "in the on", "\n\nab", "  two", "▁x"]
    return fixed + ["".join(rng.choices("abeth 1.,é²\n", k=rng.randint(1, 11))) for _ in range(120)]


def test_n_best_equals_brute_force(model):
    for text in short_texts():
        want, got = all_segmentations(model, text), model.encode(text, 6)
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want[:6]], rel=1e-9)
        ids = [tuple(np.frombuffer(i, "<u4").tolist()) for _, i in got]
        assert len(set(ids)) == len(ids) and set(ids) <= {i for _, i in want}


def test_every_segmentation_decodes(model):
    for text in [*short_texts(), "don't  STOP — 你好 𠀀\t​" * 50]:
        for _, ids in model.encode(text, 5):
            assert model.decode(ids) == text.replace("▁", " ")


def test_unit_boundaries_do_not_matter(model):
    whole = pieces.PieceModel.__new__(pieces.PieceModel)
    whole.__dict__.update(model.__dict__, unit=None, cache={}, older={})
    for text in ["the cat sat, on 12 mats. " * 3, "éê x². the"]:
        assert [s for s, _ in whole.encode(text, 8)] == pytest.approx([s for s, _ in model.encode(text, 8)], rel=1e-12)


def test_cache_may_be_small(model, pieces_path, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_UNITS", 5)
    small = pieces.PieceModel(pieces_path)
    for text in ["one two three four five six seven", "one two three", "seven six one eight nine ten"]:
        assert small.encode(text, 3) == model.encode(text, 3)


def test_segmentations_of_awkward_rows(awkward, empty, model, pieces_path):
    docs = awkward.withColumn("score", F.lit("clash")).withColumn("ids_crc32", F.lit(1))
    rows = pieces.segmentations(docs, pieces_path, n=3).collect()
    want = Counter()
    for key, text in AWKWARD:
        best = model.encode(text or "", 3)
        want[key, len(best[0][1]) // 4, tuple(s for s, _ in best), tuple(zlib.crc32(i) for _, i in best)] += 1
    assert Counter((r["doc_id"], r["n_ids"], tuple(r["nbest_scores"]), tuple(r["nbest_crc32"])) for r in rows) == want
    assert all(r["decodes"] and r["score"] == r["nbest_scores"][0] for r in rows)
    merged = [model.library.encode(text or "") for _, text in AWKWARD]
    assert Counter((r["n_merged"], r["merged_crc32"]) for r in rows) == Counter((len(i), zlib.crc32(id_bytes_of(i))) for i in merged)
    assert pieces.segmentations(empty, pieces_path).collect() == []


def odd_texts():
    rng = random.Random(9)
    symbols = [*"abethiouns 12  .,-'é²\n\tﬁ", "你", "𠀀", "<s>", "</s>", "<unk>", "<0x41>", "▁", "ing", " the ", "\u200b", "e\u0301"]
    return [*short_texts(), *("".join(rng.choices(symbols, k=rng.randint(0, 60))) for _ in range(2000)), "x" * 5000, "ab" * 3000 + "é" * 900]


@pytest.mark.parametrize("short", [0, 32])
def test_merges_equal_the_library(model, short, monkeypatch):
    monkeypatch.setattr(pieces, "SHORT_UNIT", short)
    model.merged.clear()
    for text in odd_texts():
        assert np.frombuffer(model.merge_text(text), "<u4").tolist() == model.library.encode(text), text


def test_whole_documents_are_encoded_as_by_the_library_and_decoded(spark, model, pieces_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    encoded = pieces.encode_pieces(docs, pieces_path, ["doc_id", "text"])
    rows = encoded.collect()
    assert len(rows) == docs.count() > 0
    for r in rows:
        assert r["ids"] == model.library.encode(r["text"] or "")
        assert r["pieces"] == [model.library.id_to_piece(i) for i in r["ids"]]
    texts = pieces.decode_pieces(encoded, pieces_path, ["doc_id"]).collect()
    whole = {r["doc_id"]: model.library.normalize(r["text"] or "").replace("▁", " ") for r in rows}
    lead = 1 if model.prefix else 0
    assert {r["doc_id"]: r["text"] for r in texts} == {k: w[lead:] if w.startswith(" ") else w for k, w in whole.items()}


def test_pieces_of_awkward_rows(awkward, empty, model, pieces_path):
    docs = awkward.withColumn("ids", F.lit("clash")).withColumn("scores", F.lit(1))
    best = pieces.n_best_pieces(docs, pieces_path, 3, ["doc_id", "scores"])
    got = Counter((r[0], tuple(r[2]), tuple(map(tuple, r[3]))) for r in best.collect())
    want = Counter()
    for key, text in AWKWARD:
        found = model.encode(text or "", 3)
        want[key, tuple(s for s, _ in found), tuple(tuple(np.frombuffer(i, "<u4").tolist()) for _, i in found)] += 1
    assert got == want
    encoded = pieces.encode_pieces(docs, pieces_path, ["doc_id", "ids"])
    assert Counter((r[0], tuple(r[2])) for r in encoded.collect()) == Counter((k, tuple(model.library.encode(t or ""))) for k, t in AWKWARD)
    for frame in (pieces.encode_pieces(empty, pieces_path), pieces.n_best_pieces(empty, pieces_path)):
        assert frame.collect() == []


def test_decoding_of_awkward_ids(spark, model, pieces_path):
    cat = model.library.encode("the cat 你")
    ids = spark.createDataFrame([(1, cat, "x"), (1, cat, "x"), (2, [], None), (3, None, "y"), (None, [model.bytes[0xFF]], "z")], "doc_id long, ids array<int>, text string")
    rows = pieces.decode_pieces(ids, pieces_path, ["text", "doc_id"]).collect()
    want = Counter({("x", 1, "the cat 你"): 2, (None, 2, ""): 1, ("y", 3, None): 1, ("z", None, "\ufffd"): 1})
    assert Counter(map(tuple, rows)) == want
    assert pieces.decode_pieces(ids.limit(0), pieces_path).collect() == []


def test_long_units_are_not_kept(model, pieces_path):
    fresh = pieces.PieceModel(pieces_path)
    long_text = "the " + "".join(random.Random(1).choices("abcdefgh", k=300_000)) + " cat"
    assert fresh.merge_text(long_text) == id_bytes_of(fresh.library.encode(long_text))
    assert fresh.encode(long_text, 2)[0] == model.encode(long_text, 2)[0]
    assert max(map(len, [*fresh.cache, *fresh.merged])) <= pieces.LONG_UNIT


def test_short_units_are_solved_many_at_a_time(pieces_path, monkeypatch):
    fresh, alone = pieces.PieceModel(pieces_path), []
    for name in ("solve", "merge"):
        monkeypatch.setattr(fresh, name, lambda unit, run=getattr(fresh, name): alone.append(unit) or run(unit))
    text = "don't  STOP, the 12 cats ² sat — 你好 " + " ".join("".join(random.Random(i).choices("abeth", k=1 + i % 25)) for i in range(3000))
    assert np.frombuffer(fresh.merge_text(text), "<u4").tolist() == fresh.library.encode(text)
    assert fresh.decode(fresh.encode(text)[0][1]) == text and len(fresh.cache) > 2000
    assert alone == []
    fresh.encode("𠀀" + "x" * 40)
    assert alone == ["▁𠀀" + "x" * 40]


def toy_model(names, scores):
    """A model of a few pieces, as the constructor makes it from a file."""
    toy = pieces.PieceModel.__new__(pieces.PieceModel)
    ids = {n: i for i, n in enumerate(names)}
    known = dict(zip(names, scores, strict=True))
    trie = ({}, None, -1)
    for name in names:
        path = [trie]
        for c in name:
            path.append(path[-1][0].setdefault(c, ({}, None, -1)))
        path[-2][0][name[-1]] = (path[-1][0], known[name], ids[name])
    arrays = pieces.UnitArrays(ids, known)
    toy.__dict__.update(ids=ids, scores=known, trie=trie, unknown=len(ids), bytes={}, unknown_score=-50.0, arrays=arrays)
    return toy


def same_as_alone(model, units):
    easy, hard = model.arrays.sort(units, pieces.SHORT_UNIT)
    assert sorted([*easy, *hard]) == sorted(units)
    assert all(len(u) > pieces.SHORT_UNIT or not u or any(c not in model.ids for c in u) for u in hard)
    ids, sizes, scores, losses = model.arrays.solve(easy)
    merged, merged_sizes = model.arrays.merge(easy)
    ends, merged_ends = np.cumsum(sizes), np.cumsum(merged_sizes)
    for i, unit in enumerate(easy):
        found = id_bytes_of(ids[ends[i] - sizes[i] : ends[i]]), sizes[i], scores[i], losses[i]
        assert found == model.solve(unit), unit
        assert merged[merged_ends[i] - merged_sizes[i] : merged_ends[i]].tolist() == model.merge(unit), unit
    return len(easy)


def test_many_units_give_what_each_gives_alone(model):
    texts = [*odd_texts(), "x" * 33, "y" * 32]
    units = sorted({u for t in texts for u in model.units(model.library.normalize(t))})
    assert same_as_alone(model, units) > 1000
    rng = random.Random(2)
    for _ in range(40):
        names = sorted({"a", "b", "c", *("".join(rng.choices("abcd", k=rng.randint(2, 5))) for _ in range(rng.randint(0, 12)))})
        # few values, so that many segmentations and pairs tie
        toy = toy_model(names, [rng.choice([-1.0, -2.0, -3.1, -0.7]) for _ in names])
        same_as_alone(toy, sorted({"".join(rng.choices("abcd" if rng.random() < 0.2 else "abc", k=rng.randint(1, 14))) for _ in range(200)}))


def id_bytes_of(ids):
    return np.array(ids, "<u4").tobytes()


def test_files_are_dealt_to_as_many_tasks(spark):
    from ionloom.llm.files import dealt

    paths = spark.range(300).select(F.concat(F.lit("p"), F.col("id")).alias("path"))
    for n, least in ((300, 20), (1, 1)):
        some = dealt(paths.limit(n), "path", n).mapInArrow(lambda batches: batches, "path string")
        assert some.count() == n
        assert some.select(F.spark_partition_id().alias("t")).distinct().count() >= least


def test_files_are_dealt_after_a_join_by_their_path(spark):
    from ionloom.llm.files import dealt

    paths = spark.range(64).select(F.concat(F.lit("p"), F.col("id")).alias("path"))
    others = spark.range(400).select(F.concat(F.lit("p"), F.col("id") % 64).alias("path")).groupBy("path").agg(F.count("*").alias("n"))
    some = dealt(paths.hint("merge").join(others, "path", "left"), "path", 64).mapInArrow(lambda batches: batches, "path string, n long")
    assert some.select(F.spark_partition_id().alias("t")).distinct().count() > 5

"""Token counts, sequences and packing against the tokenizers library itself."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ionloom.llm import packing, sequences, token_counts
from ionloom.llm.files import shared_folder
from ionloom.llm.tokens import PRE_TOKEN, TextEncoder, blocks, id_bytes, id_counts

from .conftest import AWKWARD


@pytest.fixture(scope="module")
def library(bpe):
    return Tokenizer.from_file(bpe)


def ids_of(library, text, end=()):
    return library.encode(text or "", add_special_tokens=False).ids + list(end)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def texts():
    chars = [chr(i) for i in range(0x250)] + [chr(i) for i in range(0x2010, 0x2028)]
    out = [f for c in chars for f in (f"a{c}b", f" {c} {c}{c}", f"{c}\n\n {c}1{c}'s", f"x  {c}\t{c} y")]
    random.seed(5)
    symbols = [*"ab1 2'\n\n  s.é\tre ll,’²ǅ", "'s", "<|endoftext|>", "你"]
    return out + ["".join(random.choices(symbols, k=random.randint(0, 30))) for _ in range(3000)]


@pytest.mark.parametrize("entries", [1_000_000, 50])
def test_encoder_equals_library(bpe, library, entries):
    all_texts = texts()
    encoder = TextEncoder(bpe, id_bytes, entries=entries)
    want = [np.array(ids_of(library, t), "<u4").tobytes() for t in all_texts]
    for start in range(0, len(all_texts), 500):
        assert encoder.encode(all_texts[start : start + 500], b"".join) == want[start : start + 500]


def test_other_tokenizers_are_encoded_whole():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    encoder = TextEncoder(path, id_counts)
    assert encoder.encode(["The Cat, 12", ""], sum) == [len(ids_of(library, "The Cat, 12")), 0]


def test_blocks_cover_all():
    lengths = [3, 0, 900, 2, 2, 2]
    parts = list(blocks(["x" * n for n in lengths], 5))
    assert [i for a, b in parts for i in range(a, b)] == list(range(6))
    assert all(sum(lengths[a:b]) <= 5 or b - a == 1 or lengths[a:b].count(0) for a, b in parts)


def test_counts(awkward, bpe, library):
    awkward = awkward.withColumn("n_tokens", F.lit("clash")).withColumn("_text", F.lit(0))
    got = Counter(map(tuple, token_counts.count_tokens(awkward, bpe, limit=20).collect()))
    want = Counter()
    for key, text in AWKWARD:
        n = len(ids_of(library, text))
        want[key, len((text or "").encode()), n, n > 20] += 1
    assert got == want


def test_counts_of_an_empty_table(empty, bpe):
    assert token_counts.count_tokens(empty, bpe).collect() == []


def test_length_table():
    table = token_counts.LengthTable({"a": 1, " b": 2, "long": 300})
    assert table.lookup() == {"a": 1, " b": 2}
    assert token_counts.LengthTable({}).lookup() == {}


@pytest.mark.parametrize("end", [2, None])
def test_sequences_round_trip(awkward, bpe, library, end):
    docs = awkward.withColumn("key", F.lit("clash"))
    got = sequences.round_trip(docs, bpe, end_id=end, length=64).collect()
    want = Counter((k, len(i), crc(i)) for k, i in ((k, ids_of(library, t, [] if end is None else [end])) for k, t in AWKWARD))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for row in sorted(got, key=lambda r: (r["start"], r["n_tokens"])):
        assert row["start"] == at
        at += row["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["start"], r["n_tokens"]))]
    assert order[0] is None and order[1:] == sorted(order[1:])


def test_sequences_give_views_of_the_file(spark, awkward, bpe):
    folder = shared_folder(spark, "test")
    manifest = sequences.write_sequences(awkward.where("doc_id = 9"), bpe, folder, end_id=2, length=128)
    row = manifest.where("n_docs > 0").first()
    with sequences.SequenceFile(row["shard"]) as file:
        last = (row["n_ids"] - 1) // 128
        ids, mask = file.sequence(last)
        assert len(ids) == len(mask) == 128 and not ids.flags.owndata
        assert mask.true_count == row["n_ids"] - 128 * last
        assert ids[mask.true_count - 1] == 2
        assert file.file.schema.field("ids").type == pa.list_(pa.uint16(), 128)
        whole = np.concatenate([file.sequence(i)[0] for i in range(last)])
        assert (whole == np.concatenate(list(file.stream()))[: len(whole)]).all()


def test_sequences_of_an_empty_table(empty, bpe):
    assert sequences.round_trip(empty, bpe, end_id=2).collect() == []


def test_packing(awkward, bpe, library):
    rows = packing.pack_documents(awkward.withColumn("pack", F.lit(1)), bpe, end_id=0, capacity=100).collect()
    pieces, used = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for key, text in AWKWARD:
        ids = ids_of(library, text, [0])
        first = len(ids) % 100 or 100
        cuts = [0, *range(first, len(ids) + 1, 100)]
        want[key] += [(p, a, b - a, crc(ids[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 100


def test_packing_of_an_empty_table(empty, bpe):
    assert packing.pack_documents(empty, bpe, end_id=0).collect() == []


def test_packed_sequences_hold_the_ids(awkward, empty, bpe, library):
    docs = awkward.withColumn("ids", F.lit("clash")).withColumn("parts", F.lit(1)).withColumn("turn", F.lit(2))
    rows = packing.packed_sequences(docs, bpe, end_id=0, capacity=100).collect()
    got = defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == sum(p["length"] for p in r["pieces"]) <= 100
        for p in r["pieces"]:
            got[p["doc_id"]].append((p["start"], r["ids"][p["offset"] : p["offset"] + p["length"]]))
    want = defaultdict(list)
    for key, text in AWKWARD:
        want[key] += ids_of(library, text, [0])
    assert {k: sorted(i for _, ids in v for i in ids) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    alone = [k for k in want if sum(k == key for key, _ in AWKWARD) == 1]
    assert all([i for _, ids in sorted(got[k]) for i in ids] == want[k] for k in alone)
    assert packing.packed_sequences(empty, bpe, end_id=0).collect() == []


@pytest.mark.parametrize("new_bins", [packing.WEIGHED, packing.LATE])
@pytest.mark.parametrize("order", ["as drawn", "longest first"])
def test_every_piece_takes_the_smallest_sum_of_squares(new_bins, order):
    random.seed(2)
    capacity, sizes = 20, np.array([random.randint(0, 20) for _ in range(400)])
    if order == "longest first":
        sizes = np.sort(sizes)[::-1]
    bins, offsets = packing.sum_of_squares(sizes, capacity, new_bins)
    gap, made, news = {}, 0, 0

    def total(gaps):
        return sum(n * n for g, n in Counter(gaps.values()).items() if 0 < g < capacity)

    for size, number, offset in zip(sizes.tolist(), bins.tolist(), offsets.tolist()):
        fits = [total({**gap, b: g - size}) for b, g in gap.items() if max(size, 1) <= g < capacity]
        options = list(fits)
        if not fits or (new_bins == packing.WEIGHED and size):
            options.append(total({**gap, made: capacity - size}))
        assert offset == capacity - gap.get(number, capacity)
        new = number not in gap
        made, news = made + new, news + (new and bool(fits))
        gap[number] = gap.get(number, capacity) - size
        assert gap[number] >= 0 and total(gap) == min(options)
        assert not (new and fits) or min(fits) > min(options)
    assert (news > 0) == (new_bins == packing.WEIGHED) or order == "longest first"
    with pytest.raises(ValueError):
        packing.sum_of_squares(sizes, capacity, "other")


def test_packing_is_close_to_the_bound():
    sizes = np.sort(np.random.default_rng(0).integers(1, 2049, 20_000))[::-1]
    bins, _ = packing.sum_of_squares(sizes, 2048)
    assert bins.max() + 1 <= 1.005 * sizes.sum() / 2048


def test_pre_tokens_join_to_the_text():
    for text in texts():
        assert "".join(PRE_TOKEN.findall(text)) == text


def test_shards_are_read_by_many_tasks_in_order_of_the_ids(spark, bpe):
    docs = spark.range(400).select(F.when(F.col("id") % 3 > 0, F.floor(F.col("id") / 150)).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    rows = sequences.round_trip(docs, bpe, end_id=2, length=64)
    got = rows.withColumn("task", F.spark_partition_id()).orderBy("start").collect()
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(ids) and len(ids) == 400
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:i]) for i in range(400)]
    assert len({r["task"] for r in got}) > 3


def test_equal_rows_are_dealt_to_all_packs(spark, bpe, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 500)
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    packed = packing.pack_documents(docs, bpe, end_id=0).groupBy("sequence_id").agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in packed) == 4000 and len(packed) == 8

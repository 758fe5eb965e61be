"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets verify them.

A text's words are its runs of letters, digits and underscores in lower case; its
n-grams are the runs of five words (a shorter text has one n-gram of all its words,
a text without words has none). Texts with equal n-gram sets are one copy class, and
one member stands for it. Classes are linked if the Jaccard similarity of their sets
is at least the threshold.

28 bands of 6 minima give a pair at 0.8 a chance of 1 - (1 - 0.8^6)^28 = 0.9998 to
share a band. Classes that share a band, directly or through others, are a candidate
group, in which every pair of a fitting size is compared by its full sets. Groups are
split by set size and by hash into blocks of bounded size, and each pair of blocks
is one unit of work, which returns counts and a spanning forest, never the pairs.

Null text counts as empty. Texts without words are copies of each other. Repeated
rows are copies. Classes have keys of their own, so rows without an id are linked
like any other, and rows of one id that differ in text stay apart; ids only name the
result. A null id names a class or a group only if no member has an id. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ionloom.llm.components import components
from ionloom.llm.files import written
from ionloom.llm.memory import worker_cache
from ionloom.llm.rows import with_text_columns
from ionloom.operators.frames import bounded_broadcast

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 28, 6
BLOCK_DOCS = 512            # classes in a block
BLOCK_SHINGLES = 500_000    # and their n-grams
WORD = re.compile(r"\w+")
CACHE_WORDS = 300_000

def word_codes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, through a bounded cache."""
    words, codes = WORD.findall(text.lower()), worker_cache(("words",), dict)
    if len(codes) > CACHE_WORDS:
        codes.clear()
    for word in set(words).difference(codes):
        codes[word] = xxhash.xxh3_64_intdigest(word)
    return np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Distinct n-gram hashes in ascending order."""
    codes = word_codes(text)
    if not len(codes):
        return codes
    n = max(len(codes) - words + 1, 1)
    total = np.zeros(n, np.uint64)
    for i in range(min(words, len(codes))):
        total = _mix(total + codes[i : i + n] + np.uint64(i + 1))
    return np.unique(total)


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20_240)
    a, b = random.integers(0, 1 << 64, size=(2, count), dtype=np.uint64)
    return a | np.uint64(1), b


def band_hashes(sets: Sequence[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One hash per set and band: of the set's minima under ``rows`` permutations. Sets are not empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    a, b = _permutations(bands * rows)
    out = np.zeros((len(sets), bands), np.uint64)
    for band in range(bands):
        held = np.full(len(sets), band, np.uint64)
        for p in range(band * rows, (band + 1) * rows):
            held = _mix(held + np.minimum.reduceat(flat * a[p] + b[p], starts))
        out[:, band] = held
    return out


def _signatures(texts: list[str], words: int, bands: int, rows: int) -> tuple:
    sets = [shingle_set(t, words) for t in texts]
    digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
    full = [i for i, s in enumerate(sets) if len(s)]
    hashes = band_hashes([sets[i] for i in full], bands, rows) if full else np.zeros((0, bands), np.uint64)
    per_text = np.full(len(texts), -1)
    per_text[full] = np.arange(len(full))
    lists = [hashes[i].view(np.int64) if i >= 0 else [] for i in per_text]
    sizes = pa.array([len(s) for s in sets], pa.int32())
    return sizes, pa.array(digests, pa.binary()), pa.array(lists, pa.list_(pa.int64()))


def text_hash(text: Column) -> Column:
    """With the id it tells which rows hold a text."""
    return F.xxhash64(text)


def _sets(texts: list[str], words: int) -> tuple:
    return (pa.array([shingle_set(t, words).tobytes() for t in texts], pa.binary()),)


def linked(sets: Sequence[np.ndarray], threshold: float) -> np.ndarray:
    """Matrix of the pairs of non-empty sets whose Jaccard similarity is at least ``threshold``."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    doc, value = np.repeat(np.arange(m), size)[order], value[order]
    first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    count = np.diff(np.append(first, len(value)))
    shared = np.zeros((m, m), np.int64)
    dense = count > max(8, m // 10)
    for n in np.unique(count[~dense & (count > 1)]):   # few sets have these n-grams: pair by pair
        runs = first[(count == n) & ~dense]
        i, j = np.triu_indices(n, 1)
        for part in np.array_split(runs, 1 + len(runs) * len(i) // 1_000_000):
            docs = doc[part[:, None] + np.arange(n)]
            shared += np.bincount((docs[:, i] * m + docs[:, j]).ravel(), minlength=m * m).reshape(m, m)
    shared += shared.T
    runs = np.flatnonzero(dense)
    for part in np.array_split(runs, 1 + len(runs) // 4_096) if len(runs) else []:
        table = np.zeros((m, len(part)), np.float32)
        for column, run in enumerate(part):
            table[doc[first[run] : first[run] + count[run]], column] = 1
        shared += (table @ table.T).round().astype(np.int64)
    found = shared / (size[:, None] + size[None] - shared) >= threshold
    np.fill_diagonal(found, False)
    return found


def _roots(found: np.ndarray) -> np.ndarray:
    """Smallest place that each place reaches."""
    root = np.arange(len(found))
    while True:
        near = np.where(found, root[None], len(root)).min(axis=1, initial=len(root))
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(unit: tuple | None, rows: list[tuple], threshold: float) -> list[tuple]:
    """Links and forest of one unit of work: rows are (class key, copies, side, set)."""
    rows = list({r[0]: r for r in rows}.values())
    within = unit is not None and unit[1:3] == unit[3:5]
    if len(rows) < 2 or not within and len({r[2] for r in rows}) < 2:
        return []
    rows.sort(key=lambda r: r[0])
    found = linked([np.frombuffer(r[3], np.uint64) for r in rows], threshold)
    if not within:      # two blocks: pairs within each are another unit's, also if the other block is empty
        side = np.array([r[2] for r in rows])
        found &= side[:, None] != side[None]
    copies = np.array([r[1] for r in rows], np.int64)
    root = _roots(found)
    links = found @ copies
    return [(rows[i][0], int(links[i]), rows[root[i]][0]) for i in np.flatnonzero(links)]


UNIT = "comp long, sa int, a int, sb int, b int"
LINKS = "key long, links long, root long"


def _compare_units(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by unit; one unit is held at a time."""
    unit, held, out = None, [], []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["key", "links", "root"]
        )

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if row[:5] != unit:
                out += _compare(unit, held, threshold)
                unit, held = row[:5], []
            held.append(row[5:])
        if len(out) > 10_000:
            yield flush()
            out = []
    out += _compare(unit, held, threshold)
    yield flush()


def _units(members: DataFrame, threshold: float) -> DataFrame:
    """Each member (key, comp, n, copies) once per unit of work it belongs to, with its side.

    Sets of sizes p <= q reach the threshold only if p >= threshold * q, so sizes are
    cut into bands of that ratio, and only equal or adjacent bands meet.
    """
    small = members.groupBy("comp").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("total"))
    one = (F.col("docs") <= BLOCK_DOCS) & (F.col("total") <= BLOCK_SHINGLES)
    band = F.floor(F.log(F.col("n")) / F.lit(math.log(1 / threshold)) + 1e-9).cast("int")
    banded = members.join(small, "comp").withColumn("s", F.when(one, F.lit(-9)).otherwise(band))
    fits = F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(BLOCK_DOCS), F.sum("n") / F.lit(BLOCK_SHINGLES)))
    blocks = written(banded.groupBy("comp", "s").agg(fits.cast("int").alias("blocks")), "blocks")
    above = blocks.select("comp", (F.col("s") - 1).alias("s"), F.col("blocks").alias("above"))
    below = blocks.select("comp", (F.col("s") + 1).alias("s"), F.col("blocks").alias("below"))
    shape = blocks.join(above, ["comp", "s"], "left").join(below, ["comp", "s"], "left")
    mine = F.pmod(F.xxhash64("key"), F.col("blocks").cast("bigint")).cast("int")

    def upto(n):
        n = F.coalesce(F.col(n), F.lit(0))
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def unit(sa, a, sb, b, side):
        return F.struct(*[x.cast("int").alias(n) for x, n in ((sa, "sa"), (a, "a"), (sb, "sb"), (b, "b"), (side, "side"))])

    s, i = F.col("s"), F.col("mine")
    units = F.concat(
        F.transform(upto("blocks"), lambda t: unit(s, F.least(i, t), s, F.greatest(i, t), (i > t).cast("int"))),
        F.transform(upto("above"), lambda t: unit(s, i, s + 1, t, F.lit(0))),
        F.transform(upto("below"), lambda t: unit(s - 1, t, s, i, F.lit(1))),
    )
    return (
        banded.join(shape, ["comp", "s"])
        .withColumn("mine", mine)
        .select("key", "comp", "copies", F.explode(units).alias("unit"))
        .select("key", "comp", "copies", "unit.*")
    )


def _joined(
    docs: DataFrame, threshold: float, words: int, bands: int, rows: int, id_col: str, text_col: str
) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, digest), and each class (digest, first, group, class_id, copy_class, n_links).

    ``first`` is the smallest (no_id, doc_id, text_hash) of the class; ``group`` is equal
    for classes that reach each other.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.withColumn("text_hash", text_hash(F.col("text")))
    fields = [
        T.StructField("n", T.IntegerType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
    compute = partial(_signatures, words=words, bands=bands, rows=rows)
    signed = written(with_text_columns(texts, ["doc_id", "text_hash"], "text", compute, fields), "signatures")
    # the keys are fixed because the classes are a table
    classes = written(
        signed.groupBy("digest").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"),
            F.count(F.lit(1)).alias("copies"),
            F.first("n").alias("n"),
            F.first("bands").alias("bands"),
        ).withColumn("key", F.monotonically_increasing_id()),
        "classes",
    )
    keys = classes.select("key", F.posexplode("bands").alias("band", "hash"))
    keys = keys.select("key", F.xxhash64("band", "hash").alias("bucket"))
    buckets = keys.groupBy("bucket").agg(F.min("key").alias("least"), F.max("key").alias("most"))
    buckets = buckets.where(F.col("least") < F.col("most")).select("bucket", "least")
    candidates = components(keys.join(buckets, "bucket").select(F.col("key").alias("u"), F.col("least").alias("v")))
    members = written(
        candidates.select(F.col("u").alias("key"), F.col("root").alias("comp")).join(
            classes.select("key", "n", "copies", "first"), "key"
        ),
        "members",
    )
    units = _units(members.drop("first"), threshold)
    first = members.select("key", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"))
    first = bounded_broadcast(written(first, "firsts"))     # while it is small, the texts are not shuffled
    of_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    sets = with_text_columns(
        texts.join(first, of_first).groupBy("key").agg(F.first("text").alias("text")),
        ["key"],
        "text",
        partial(_sets, words=words),
        [T.StructField("set", T.BinaryType())],
    )
    order = [part.split()[0] for part in UNIT.split(", ")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = (
        units.join(sets, "key")
        .select(*order, "key", "copies", "side", "set")
        .repartition(parts, *order)
        .sortWithinPartitions(*order)
    )
    found = written(work.mapInArrow(partial(_compare_units, threshold=threshold), LINKS), "links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("key").alias("u"), F.col("root").alias("v")))
    groups = groups.select(F.col("u").alias("key"), F.col("root").alias("group"))
    named = groups.join(classes.select("key", "first"), "key").groupBy("group").agg(F.min("first.doc_id").alias("group_id"))
    named = written(named, "groups")
    known = (
        classes.select("digest", "key", "first", "copies")
        .join(links, "key", "left")
        .join(groups, "key", "left")
        .join(named, "group", "left")
        .select(
            "digest",
            "first",
            F.coalesce("group", "key").alias("group"),
            F.coalesce("group_id", "first.doc_id").alias("class_id"),
            F.col("first.doc_id").alias("copy_class"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        )
    )
    return signed.select("doc_id", "digest"), known


def jaccard_join(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    words: int = WORDS,
    bands: int = BANDS,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, class_id, copy_class, n_links.

    ``class_id`` is the smallest id that the document reaches over links, ``copy_class``
    the smallest with the same n-grams, and ``n_links`` the number of other documents
    whose similarity is at least the threshold, copies included.
    """
    signed, known = _joined(docs, threshold, words, bands, rows, id_col, text_col)
    return signed.join(known, "digest").select("doc_id", "class_id", "copy_class", "n_links")


def first_of_groups(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """first_id, first_hash: the smallest id (null last) and ``text_hash`` of each group of near copies."""
    known = _joined(docs, threshold, WORDS, BANDS, ROWS, id_col, text_col)[1]
    first = known.groupBy("group").agg(F.min("first").alias("first"))
    return first.select(F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"))

"""Phrases of two to four words that stand together, by best-first branch and bound over prefixes.

A phrase with count a scores floor(2000000 a / (l + r)) at its lowest cut, where l and r
count its parts. All phrases that grow from a prefix with count f and first word w score
at most floor(2000000 f / (count(w) + f)): the cut after w is one of their cuts, and
neither a nor the part after w can do better than f. So after words and pairs are counted,
only prefixes whose bound reaches a cut score are grown, each language with a cut of its
own, first to three words and then to four. All phrases that reach the cut are then known,
with their cuts' counts and everything that could cover them. A language is settled when
enough of them survive; for the others the cut is lowered and the frontier grows, in
the end to all prefixes. Nothing is sampled, and no language, phrase or partner is capped.

Texts are read as UTF-8 bytes in Arrow batches. A word is a 64-bit number salted with its
language; that no two words share one is checked with a second number on all words (else
another seed is taken), so counts are exact. Tasks count before anything is shuffled:
each sends a phrase once, however often it repeats. What tasks need to know, frequent words
and frontiers, are bit maps of a fixed size: a bit set by chance costs a count that is
dropped later and changes nothing.

Null text counts as empty and gives nothing; a null language is ``und``; repeated rows
count each; rows need no id, and other columns are not read. An empty table gives no rows.
Long texts are cut for counting where a piece ends; a piece without such a place is held
as one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from ionloom.llm.files import written
from ionloom.llm.memory import bounded_batches
from ionloom.operators.frames import bounded_broadcast

LEAST = 30                  # occurrences of a candidate
COVER = 80                  # per cent of its occurrences in a longer candidate that drop it
FIRST = 2_000               # phrases per language
SCALE = 2_000_000
MAP_BITS = 27               # of a bit map, as a power of two: 16 MB
CHUNK = 4_000_000           # bytes of text looked at together, about
HELD = 3_000_000            # distinct phrases a task holds before it sends them
LONG_WORD = 256             # bytes from which a word is hashed by itself
AHEAD = 3                   # times as many pairs as phrases wanted reach the first cut
STEPS = 1_000               # width of the score classes from which cuts are chosen
UNKNOWN = "und"
BLANK, BREAK = b" \t", b".,;:!?\n\x0b\x0c\r"

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANK)] = 1
_KIND[list(BREAK)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(*parts: np.ndarray) -> np.ndarray:
    """One number for several in order."""
    out = np.full(len(parts[0]), len(parts), np.uint64)
    for part in parts:
        out = mixed(part + out * np.uint64(0x9E3779B97F4A7C15))
    return out


def _salt(lang: str, seed: int) -> int:
    return int.from_bytes(blake2b(f"{seed} {lang}".encode(), digest_size=8).digest(), "little")


@dataclass
class Words:
    """The words of some texts in order."""

    text: np.ndarray            # lower-cased bytes
    start: np.ndarray
    end: np.ndarray
    follows: np.ndarray         # whether the next word continues the piece; one less than words
    lang: np.ndarray            # number of the language
    langs: list[str]
    key: np.ndarray             # 64-bit number of (language, word)

    def phrase(self, first: int, words: int) -> str:
        return b" ".join(self.text[self.start[i] : self.end[i]].tobytes() for i in range(first, first + words)).decode()


def keys(text: np.ndarray, start: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Numbers of words: eight bytes at a time, begun with the salt and the length."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(text) + 1,), "<u8", padded, 0, (1,))
    length = end - start
    out = mixed(salt + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    rest = np.flatnonzero((length > 0) & (length <= LONG_WORD))
    at = start[rest]
    while len(rest):
        left = np.minimum(end[rest] - at, 8).astype(np.uint64)
        block = eight[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8)))
        out[rest] = mixed(out[rest] ^ block)
        at = at + 8
        more = at < end[rest]
        rest, at = rest[more], at[more]
    for i in np.flatnonzero(length > LONG_WORD):
        name = blake2b(text[start[i] : end[i]], digest_size=8, salt=int(salt[i]).to_bytes(8, "little"))
        out[i] = int.from_bytes(name.digest(), "little")
    return out


def chunks(text: np.ndarray, starts: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` bytes that end where a text or a piece ends. The last start is the end of all."""
    at, total = 0, len(text)
    while at < total:
        stop = edge = min(at + size, total)
        if stop < total:
            edge = int(starts[np.searchsorted(starts, stop, "right") - 1])
            if edge <= at:
                breaks = np.flatnonzero(_KIND[text[at:stop]] == 2)
                edge = at + int(breaks[-1]) + 1 if len(breaks) else at
            while edge <= at:       # no end in reach: on to the next one
                ahead = np.flatnonzero(_KIND[text[stop : stop + size]] == 2)[:1] + stop + 1
                ends = [int(e) for e in (*ahead, starts[np.searchsorted(starts, stop)]) if e <= stop + size]
                edge = min(ends, default=at)
                stop += size
        yield at, edge
        at = edge


def words_of(batch: pa.RecordBatch, seed: int, size: int = CHUNK) -> Iterator[Words]:
    """Words of a batch (lang, text), chunk by chunk."""
    texts = pc.fill_null(batch.column(1), "").cast(pa.large_string())
    coded = pc.fill_null(batch.column(0), UNKNOWN).dictionary_encode()
    langs = [x or "" for x in coded.dictionary.to_pylist()]
    salts = np.array([_salt(x, seed) for x in langs], np.uint64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    if held is None or not len(texts):
        return
    whole = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]]
    starts = offsets - offsets[0]
    code = coded.indices.to_numpy(zero_copy_only=False)
    for low, high in chunks(whole, starts, size):
        text = _LOWER[whole[low:high]]
        kind = _KIND[text]
        word = kind == 0
        inner = starts[(starts > low) & (starts < high)] - low
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        begins[inner] = word[inner]
        ends[inner - 1] = word[inner - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        if not len(start):
            continue
        pieces = kind == 2
        piece = np.cumsum(pieces)[start]
        row = np.searchsorted(starts, start + low, "right") - 1
        lang = code[row]
        yield Words(text, start, end, (piece[1:] == piece[:-1]) & (row[1:] == row[:-1]), lang, langs, keys(text, start, end, salts[lang]))


# ---- counting in tasks


def grouped(columns: Sequence[np.ndarray], n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One row of each distinct row of 64-bit columns, and how often it occurs (by ``n``, if given)."""
    name = columns[0] if len(columns) == 1 else joined(*columns)
    order = np.argsort(name)
    inside = np.zeros(max(len(order) - 1, 0), bool)
    sorted_name = name[order]
    same = sorted_name[1:] == sorted_name[:-1]
    for column in columns:
        at = column[order]
        inside |= same & (at[1:] != at[:-1])
    if inside.any():            # two rows with one name: sort by all columns
        order = np.lexsort(columns)
        same = np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in columns])
    first = np.flatnonzero(np.append(True, ~same)) if len(order) else np.zeros(0, np.int64)
    if n is None:
        return order[first], np.diff(np.append(first, len(order)))
    return order[first], np.add.reduceat(n[order], first) if len(first) else np.zeros(0, np.int64)


class Tally:
    """Distinct rows of columns with their counts; ``extra`` columns go along with the first."""

    def __init__(self, width: int, limit: int = HELD):
        self.width, self.limit = width, limit
        self.parts: list[tuple[list[np.ndarray], np.ndarray]] = []
        self.size = 0

    def add(self, columns: list[np.ndarray], n: np.ndarray) -> None:
        self.parts.append((columns, n))
        self.size += len(n)

    def compacted(self) -> tuple[list[np.ndarray], np.ndarray]:
        columns = [np.concatenate([p[0][i] for p in self.parts]) for i in range(len(self.parts[0][0]))]
        first, n = grouped(columns[: self.width], np.concatenate([p[1] for p in self.parts]))
        return [c[first] for c in columns], n

    def full(self, last: bool = False) -> tuple[list[np.ndarray], np.ndarray] | None:
        """What must be sent on now, if anything."""
        if not self.parts or (self.size < self.limit and not last):
            return None
        columns, n = self.compacted()
        self.parts, self.size = [], 0
        if not last and len(n) <= self.limit // 2:
            self.add(columns, n)
            return None
        return columns, n


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64), pa.int64())


def _count_words(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    names = ["whole", "lang", "key", "other", "n"]
    totals: dict[str, int] = {}
    tally, known = Tally(2), {}

    def rows(found) -> pa.RecordBatch:
        (key, other, lang), n = found
        named = pa.array(list(known), pa.string()).take(pa.array(lang))
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), bool)), named, _long(key), _long(other), _long(n)], names)

    for batch in batches:
        for words in words_of(batch, seed):
            salts = np.array([_salt(x, ~seed) for x in words.langs], np.uint64)
            other = keys(words.text, words.start, words.end, salts[words.lang])
            # words of one key that differ keep rows of their own, so that they are seen
            first, n = grouped([words.key, other])
            place = np.array([known.setdefault(x, len(known)) for x in words.langs])
            tally.add([words.key[first], other[first], place[words.lang[first]]], n)
            for i, count in enumerate(np.bincount(words.lang, minlength=len(words.langs))):
                totals[words.langs[i]] = totals.get(words.langs[i], 0) + int(count)
            if (found := tally.full()) is not None:
                yield rows(found)
    if (found := tally.full(last=True)) is not None:
        yield rows(found)
    langs, zeros = list(totals), np.zeros(len(totals), np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array([True] * len(langs)), pa.array(langs, pa.string()), _long(zeros), _long(zeros), pa.array(list(totals.values()), pa.int64())], names
    )


def _in(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether the bit of each key is set."""
    place = key >> np.uint64(64 - MAP_BITS)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def _count_pairs(batches: Iterator[pa.RecordBatch], seed: int, frequent: Broadcast) -> Iterator[pa.RecordBatch]:
    tally = Tally(2)

    def rows(found) -> pa.RecordBatch:
        (a, b), n = found
        return pa.RecordBatch.from_arrays([_long(a), _long(b), _long(n)], ["a", "b", "n"])

    for batch in batches:
        for words in words_of(batch, seed):
            often = _in(frequent.value, words.key)
            at = np.flatnonzero(words.follows & often[1:] & often[:-1])
            a, b = words.key[at], words.key[at + 1]
            first, n = grouped([a, b])
            tally.add([a[first], b[first]], n)
            if (found := tally.full()) is not None:
                yield rows(found)
    if (found := tally.full(last=True)) is not None:
        yield rows(found)


PHRASES = "lang string, words int, a long, b long, c long, d long, phrase string, n long"


def _count_phrases(batches: Iterator[pa.RecordBatch], seed: int, pick: Callable, maps: dict[str, Broadcast]) -> Iterator[pa.RecordBatch]:
    """Phrases at the places that ``pick`` names for each number of words, with their texts."""
    held: dict[tuple, list] = {}

    def rows() -> pa.RecordBatch:
        table = [(lang, *key, phrase, n) for key, (lang, phrase, n) in held.items()]
        held.clear()
        columns = list(zip(*table, strict=True))
        kinds = [pa.string(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.int64()]
        names = ["lang", "words", "a", "b", "c", "d", "phrase", "n"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    for batch in batches:
        for words in words_of(batch, seed):
            for size, at in pick(words, {k: m.value for k, m in maps.items()}):
                parts = [words.key[at + i] for i in range(size)]
                first, n = grouped(parts)
                signed = [p[first].view(np.int64).tolist() for p in parts] + [[0] * len(first)] * (4 - size)
                for *key, place, count in zip(*signed, at[first].tolist(), n.tolist(), strict=True):
                    row = held.get((size, *key))
                    if row is None:
                        held[(size, *key)] = [words.langs[words.lang[place]], words.phrase(place, size), count]
                    else:
                        row[2] += count
            if len(held) > HELD // 10:
                yield rows()
    if held:
        yield rows()


def _pairs_in(words: Words, maps: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    name = joined(words.key[:-1], words.key[1:])
    return name, words.follows & _in(maps["pairs"], name)


def _grow_pairs(words: Words, maps: dict[str, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Pairs of the frontier, and phrases of three words that a pair of the frontier begins or ends."""
    name, often = _pairs_in(words, maps)
    grown = often & _in(maps["frontier"], name)
    yield 2, np.flatnonzero(grown)
    yield 3, np.flatnonzero(often[1:] & often[:-1] & (grown[1:] | grown[:-1]))


def _grow_triples(words: Words, maps: dict[str, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Phrases of four words that a triple of the frontier begins or ends, and their last three words."""
    name, often = _pairs_in(words, maps)
    both = often[1:] & often[:-1]
    grown = both & _in(maps["triples"], joined(words.key[:-2], words.key[1:-1], words.key[2:]))
    yield 4, np.flatnonzero(both[1:] & both[:-1] & (grown[1:] | grown[:-1]))
    counted = _in(maps["frontier"], name)
    yield 3, np.flatnonzero(both & _in(maps["ends"], name)[:-1] & ~counted[1:] & ~counted[:-1])


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [c.to_numpy().view(np.uint64) for c in batch.columns]
        name = parts[0] if len(parts) == 1 else joined(*parts)
        place = name >> np.uint64(64 - MAP_BITS)
        bit = np.left_shift(np.uint64(1), place & np.uint64(63))
        yield pa.RecordBatch.from_arrays([_long(place >> np.uint64(6)), _long(bit)], ["word", "bits"])


def bit_map(rows: DataFrame) -> Broadcast:
    """The bits of rows of 64-bit columns, on every worker. At most 2**21 words of it come to the driver."""
    words = rows.mapInArrow(_bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return rows.sparkSession.sparkContext.broadcast(bits)


# ---- scores and frontier


def _score(n: str, left: Column, right: Column) -> Column:
    """floor(2000000 n / (left + right)) in whole numbers, wide enough for any count."""
    wide = F.lit(SCALE).cast("decimal(18,0)") * F.col(n).cast("decimal(18,0)")
    return F.call_function("div", wide, (left + right).cast("decimal(20,0)")).cast("long")


def count_words(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, int]:
    """Frequent words (lang, key, n), all words per language (lang, n), and the seed without a clash."""
    for seed in range(8):
        counts = docs.mapInArrow(partial(_count_words, seed=seed), "whole boolean, lang string, key long, other long, n long")
        summed = counts.groupBy("whole", F.when(F.col("whole"), F.col("lang")).alias("of"), "key").agg(
            F.sum("n").alias("n"), F.min("lang").alias("lang"), (F.min("other") != F.max("other")).alias("clash")
        )
        kept = written(summed.where(F.col("whole") | (F.col("n") >= least) | F.col("clash")), "colloc-words")
        if not kept.where("clash").limit(1).count():
            return kept.where("NOT whole").select("lang", "key", "n"), kept.where("whole").select("lang", "n"), seed
    raise ValueError("words share 64-bit numbers under every seed")


def count_pairs(docs: DataFrame, words: DataFrame, seed: int, least: int) -> DataFrame:
    """Frequent pairs (lang, a, b, n, fa, fb) with score and bound."""
    frequent = bit_map(words.select("key"))
    counts = docs.mapInArrow(partial(_count_pairs, seed=seed, frequent=frequent), "a long, b long, n long")
    often = counts.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    one = words.select("lang", F.col("key").alias("a"), F.col("n").alias("fa"))
    two = words.select(F.col("key").alias("b"), F.col("n").alias("fb"))
    scored = often.join(one, "a").join(two, "b")
    return scored.withColumns({"score": _score("n", F.col("fa"), F.col("fb")), "bound": _score("n", F.col("fa"), F.col("n"))})


def cuts(pairs: DataFrame, wanted: int) -> DataFrame:
    """Per language the score class in which the ``wanted``-th best pair stands; 0 where there are fewer."""
    classes = pairs.groupBy("lang", F.expr(f"score div {STEPS}").alias("step")).agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("step")))
    reached = classes.withColumn("above", above).where(F.col("above") >= wanted)
    found = reached.groupBy("lang").agg((F.max("step") * STEPS).alias("cut"))
    return pairs.select("lang").distinct().join(found, "lang", "left").select("lang", F.coalesce("cut", F.lit(0)).alias("cut"))


def _summed(counts: DataFrame, least: int) -> DataFrame:
    keys = ["words", "a", "b", "c", "d"]
    found = counts.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("lang").alias("lang"), F.min("phrase").alias("phrase"))
    return found.where(F.col("n") >= least)


def _lowest(cut_counts: Sequence[tuple[str, str]]) -> list[Column]:
    """Score, l and r of the lowest cut; ties to the earliest."""
    options = [F.struct(_score("n", F.col(x), F.col(y)).alias("score"), F.lit(i).alias("k"), F.col(x).alias("l"), F.col(y).alias("r")) for i, (x, y) in enumerate(cut_counts)]
    least = F.least(*options) if len(options) > 1 else options[0]
    return [least[name].alias(name) for name in ("score", "l", "r")]


def _named(pairs: DataFrame, a: str, b: str, **columns: str) -> DataFrame:
    return pairs.select(F.col("a").alias(a), F.col("b").alias(b), *[F.col(c).alias(n) for n, c in columns.items()])


def expand(docs: DataFrame, pairs: DataFrame, limits: DataFrame, seed: int, least: int) -> DataFrame:
    """All candidates with a score of at least their language's cut that no longer one covers.

    ``limits`` (lang, cut) names the languages to work on.
    """
    known = pairs.join(bounded_broadcast(limits), "lang")
    frontier = known.where(F.col("bound") >= F.col("cut"))
    maps = {"pairs": bit_map(known.select("a", "b")), "frontier": bit_map(frontier.select("a", "b"))}
    first = written(_summed(docs.mapInArrow(partial(_count_phrases, seed=seed, pick=_grow_pairs, maps=maps), PHRASES), least), "colloc-three")

    def grown_from(rows: DataFrame) -> DataFrame:
        """Triples with the counts of their parts; one without its first pair only covers others."""
        both = rows.where("words = 3").drop("d").join(_named(known, "b", "c", n_bc="n", fc="fb"), ["b", "c"])
        return both.join(_named(known, "a", "b", n_ab="n", fa="fa", cut="cut"), ["a", "b"])

    bound = _score("n", F.col("fa"), F.col("n"))
    ahead = written(grown_from(first).where(bound >= F.col("cut")).select("a", "b", "c"), "colloc-frontier")
    maps |= {"triples": bit_map(ahead), "ends": bit_map(ahead.select("b", "c"))}
    second = written(_summed(docs.mapInArrow(partial(_count_phrases, seed=seed, pick=_grow_triples, maps=maps), PHRASES), least), "colloc-four")
    for shared in maps.values():
        shared.unpersist()

    counted = first.unionByName(second)
    triples = grown_from(counted)
    three = triples.select("lang", "words", "a", "b", "c", F.lit(0).cast("long").alias("d"), "phrase", "n", "cut", *_lowest([("fa", "n_bc"), ("n_ab", "fc")]))
    two = known.join(first.where("words = 2").select("a", "b", "phrase"), ["a", "b"]).select(
        "lang", F.lit(2).alias("words"), "a", "b", *[F.lit(0).cast("long").alias(x) for x in "cd"], "phrase", "n", "cut", *_lowest([("fa", "fb")])
    )
    part = counted.where("words = 3")
    quads = (
        second.where("words = 4")
        .join(part.select("a", "b", "c", F.col("n").alias("n_abc")), ["a", "b", "c"])
        .join(part.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("c").alias("d"), F.col("n").alias("n_bcd")), ["b", "c", "d"])
        .join(_named(known, "a", "b", n_ab="n", fa="fa", cut="cut"), ["a", "b"])
        .join(_named(known, "c", "d", n_cd="n", fd="fb"), ["c", "d"])
    )
    four = quads.select("lang", "words", *"abcd", "phrase", "n", "cut", *_lowest([("fa", "n_bcd"), ("n_ab", "n_cd"), ("n_abc", "fd")]))
    good = two.unionByName(three).unionByName(four).where(F.col("score") >= F.col("cut"))
    return good.join(_covers(counted), ["words", "a", "b", "c", "d"], "left").where(
        F.coalesce(F.col("most"), F.lit(0)) * 100 < F.col("n") * COVER
    )


def _covers(counted: DataFrame) -> DataFrame:
    """For phrases of two and three words, the count of the most frequent phrase that is one word longer."""
    zero = F.lit(0).cast("long")
    head = F.struct((F.col("words") - 1).alias("words"), "a", "b", F.when(F.col("words") == 4, F.col("c")).otherwise(zero).alias("c"))
    tail = F.struct((F.col("words") - 1).alias("words"), F.col("b").alias("a"), F.col("c").alias("b"), F.when(F.col("words") == 4, F.col("d")).otherwise(zero).alias("c"))
    sides = counted.where("words > 2").select(F.explode(F.array(head, tail)).alias("of"), "n")
    return sides.groupBy("of").agg(F.max("n").alias("most")).select("of.*", zero.alias("d"), "most")


def collocations(docs: DataFrame, first: int = FIRST, least: int = LEAST) -> DataFrame:
    """Per language its ``first`` phrases: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has text and lang. A phrase that lies in a longer candidate with at least 80 %
    of its count is left out. By score, then count, both descending, then by phrase.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    words, totals, seed = count_words(rows, least)
    pairs = written(count_pairs(rows, words, seed, least), "colloc-pairs")
    settled, wanted, open_langs = None, AHEAD * first, pairs.select("lang").distinct()
    while True:
        limits = written(cuts(pairs.join(bounded_broadcast(open_langs), "lang"), wanted), "colloc-cuts")
        found = written(expand(rows, pairs, limits, seed, least), "colloc-found")
        survivors = found.groupBy("lang").agg(F.count(F.lit(1)).alias("survivors"))
        state = limits.join(survivors, "lang", "left")
        enough = (F.col("cut") == 0) | (F.coalesce(F.col("survivors"), F.lit(0)) >= first)
        state = written(state.select("lang", enough.alias("enough")), "colloc-state")
        done = found.join(bounded_broadcast(state.where("enough")), "lang").drop("enough")
        settled = done if settled is None else settled.unionByName(done)
        open_langs = state.where("NOT enough").select("lang")
        if not open_langs.limit(1).count():
            break
        wanted *= 4
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("n"), F.asc("phrase"))
    ranked = settled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    named = ranked.withColumnRenamed("n", "a0").join(bounded_broadcast(totals), "lang")
    return named.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("a0").alias("a"), "l", "r", "n", "score")

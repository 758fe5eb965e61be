"""SentencePiece encoding with the n best segmentations, and decoding.

The pieces that cover a text, each with its score, form a lattice of positions. A
forward Viterbi pass finds the best score from the start to every position. Used as
the heuristic of a backward A* search from the end it is exact, so the search takes
complete segmentations off its queue in order of score.

No piece crosses certain boundaries (a new word; from letters to other characters),
which is checked against the vocabulary, so the lattice falls into units that a
worker solves once and keeps in a bounded cache. The short new units of a block of texts
are solved together (see ``lattices``), with the same results. The n best of a whole text combine
those of its units by the same kind of search: only the n - 1 units whose second
best costs least can differ from their best.

A character without a piece takes the model's unknown score, and its UTF-8 bytes as
byte pieces where the model has them. Null text counts as empty and has one
segmentation, the one of the normalised empty text. Ties are ordered by the search
and are the same on every run. Decoding gives the normalised text, in which the
white space mark is a space.

Two things are not the same: the best path of the lattice, and what the sentencepiece
library encodes. For a vocabulary of merges (as ``piece_bpe_32k.model``) the scores are
merge ranks, so the lattice ranks segmentations by the sum of their ranks, and the
library's own encoding joins the pair of best rank first. ``encode_pieces`` gives that
encoding, ``n_best_pieces`` the lattice's segmentations, ``decode_pieces`` the text of
ids; ``segmentations`` gives checksums of both. Vocabularies of unigrams, whose
own encoding is the best path, are told apart by ``merges=False``.

Rows that repeat give repeated rows, an empty table gives none, and further columns pass
through by place, so their names may clash with those that are added. A text of megabytes
is solved unit by unit; long units are solved each time and not kept.
"""

from __future__ import annotations

import heapq
import itertools
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ionloom.llm.lattices import IDS, Solved, UnitArrays
from ionloom.llm.memory import bounded_batches, worker_cache
from ionloom.llm.rows import slices, with_text_columns

MARK = "▁"
UNKNOWN_PENALTY = 10.0      # fixed value of the format: below the smallest score
CACHE_UNITS = 600_000       # units in each half of a worker's cache
CACHE_IDS = 8_000_000       # ids in each half
CACHE_CHOICES = 50_000      # units whose n best are kept
SHORT_UNIT = 32             # units up to here are solved and merged many at a time, or merged without a queue
LONG_UNIT = 256             # longer units are not kept
BEST = 4


def id_bytes(ids: Sequence[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def numbered(split: Iterable[list[str]]) -> tuple[list[str], np.ndarray, list[int]]:
    """Of texts, given as their units: the distinct units, the number of each unit among them, and where each text's units end."""
    number: dict[str, int] = defaultdict(itertools.count().__next__)
    places = [np.fromiter(map(number.__getitem__, units), np.int64, len(units)) for units in split]
    return list(number), np.concatenate(places), list(itertools.accumulate(map(len, places)))


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = range(self.library.get_piece_size())
        names = [self.library.id_to_piece(i) for i in size]
        special = [self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i) for i in size]
        self.bytes = {int(names[i][3:5], 16): i for i in size if self.library.is_byte(i)}
        self.ids = {n: i for i, n in enumerate(names) if not special[i] and not self.library.is_byte(i)}
        self.unknown = self.library.unk_id()
        self.names = pa.array(names)
        self.scores = scores = {n: self.library.get_score(i) for n, i in self.ids.items()}
        self.unknown_score = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        # (next character -> node, score and id if a piece ends here)
        self.trie: tuple[dict, float | None, int] = ({}, None, -1)
        for name, score in scores.items():
            path = [self.trie]
            for c in name:
                path.append(path[-1][0].setdefault(c, ({}, None, -1)))
            parent = path[-2][0]
            parent[name[-1]] = (parent[name[-1]][0], score, self.ids[name])
        self.surface = [b"" if s else n.replace(MARK, " ").encode() for n, s in zip(names, special, strict=True)]
        for value, i in self.bytes.items():
            self.surface[i] = bytes([value])
        self.surface[self.unknown] = " ⁇ ".encode()
        self.surface_sizes = np.array(list(map(len, self.surface)))
        self.prefix = self.library.normalize("x").startswith(MARK)
        self.unit = self._unit_pattern()
        self.arrays = UnitArrays(self.ids, scores)
        # unit -> row of the best segmentations
        self.cache: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.solved, self.older_solved = Solved(), Solved()
        # unit -> row of the encodings by merges
        self.merged: dict[str, int] = {}
        self.merges = Solved()
        self.chosen: dict[tuple[str, int], list[tuple[float, bytes]]] = {}

    def _unit_pattern(self) -> re.Pattern | None:
        """What splits a text so that no piece crosses a boundary; None if only the whole text does."""

        def pattern(odd: set[str]) -> re.Pattern:
            letter = rf"[^\W\d_{''.join(map(re.escape, sorted(odd)))}]"
            not_letter = rf"(?:(?!{letter})[^{MARK}])"
            return re.compile(rf"{MARK}*{letter}+|{MARK}*{not_letter}+|{MARK}+", re.DOTALL)

        plain = pattern(set())
        mixed = [n for n in self.ids if not plain.fullmatch(n)]
        odd = {c for n in mixed for c in n if not c.isalpha() and c != MARK}
        found = pattern(odd)
        return found if all(found.fullmatch(n) for n in self.ids) else None

    def units(self, normalised: str) -> list[str]:
        return self.unit.findall(normalised) if self.unit else [normalised] if normalised else []

    def block(self, normalised: Sequence[str]) -> tuple[list[str], np.ndarray, list[int]]:
        return numbered(map(self.units, normalised))

    def edges(self, unit: str) -> list[tuple[int, int, float, int]]:
        """(from, to, score, id) of every piece in the unit, by place, shortest first.

        A character that is no piece by itself gets an edge with the unknown score and id -1.
        """
        out: list[tuple[int, int, float, int]] = []
        root, unknown, n = self.trie[0], self.unknown_score, len(unit)
        for i in range(n):
            node, j = root.get(unit[i]), i + 1
            if node is None or node[1] is None:
                out.append((i, j, unknown, -1))
            while node is not None:
                if node[1] is not None:
                    out.append((i, j, node[1], node[2]))
                if j == n:
                    break
                node = node[0].get(unit[j])
                j += 1
        return out

    def solve(self, unit: str) -> tuple[bytes, int, float, float]:
        """Ids of the best segmentation, their number, its score, and what the second best loses."""
        edges, n = self.edges(unit), len(unit)
        forward, came = [0.0] + [-np.inf] * n, [None] * (n + 1)
        for edge in edges:
            i, j, value, _ = edge
            value += forward[i]
            if value > forward[j]:
                forward[j], came[j] = value, edge
        path, after, j = [], [0] * (n + 1), n
        while j:
            path.append(came[j])
            i = came[j][0]
            after[i], j = j, i
        backward, second = [-np.inf] * n + [0.0], -np.inf
        for i, j, value, _ in reversed(edges):
            value += backward[j]
            if value > backward[i]:
                backward[i] = value
            # any other segmentation has an edge that the best has not
            if forward[i] + value > second and after[i] != j:
                second = forward[i] + value
        ids = [edge[3] for edge in reversed(path)]
        if -1 in ids:
            ids = self.ids_of(unit, [0, *[edge[1] for edge in reversed(path)]])
        return id_bytes(ids), len(ids), forward[n], forward[n] - second

    def ids_of(self, unit: str, cuts: Sequence[int]) -> list[int]:
        out = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            name = self.ids.get(unit[a:b])
            if name is not None:
                out.append(name)
            elif self.bytes:
                out += [self.bytes[x] for x in unit[a:b].encode()]
            else:
                out.append(self.unknown)
        return out

    def n_best(self, unit: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a unit: (score, ids), best first."""
        if not unit:
            return [(0.0, [])]
        edges, size = self.edges(unit), len(unit)
        forward: list[float] = [0.0] + [-np.inf] * size
        into: list[list[tuple[int, float]]] = [[] for _ in range(size + 1)]
        for i, j, value, _ in edges:
            forward[j] = max(forward[j], forward[i] + value)
            into[j].append((i, value))
        # (minus what the whole will score, position, order, score so far, cuts from here to the end);
        # of equal promises the one nearest to the start goes first, so ties are not all unfolded
        queue, pushed, out = [(-forward[size], size, 0, 0.0, (size, None))], 0, []
        while queue and len(out) < n:
            _, j, _, done, link = heapq.heappop(queue)
            if j == 0:
                cuts = []
                while link:
                    cuts.append(link[0])
                    link = link[1]
                out.append((done, self.ids_of(unit, cuts)))
                continue
            for i, value in into[j]:
                pushed += 1
                heapq.heappush(queue, (-(forward[i] + value + done), i, pushed, value + done, (i, link)))
        return out

    def merge(self, unit: str) -> list[int]:
        """Ids of a unit by merges: of all adjacent pairs that are a piece, the best one joins, the leftmost of equals."""
        n = len(unit)
        if n <= SHORT_UNIT:
            return self._merge_short(unit)
        end, before = list(range(1, n + 1)), list(range(-1, n))   # a part's end; the part that ends at a place
        queue: list[tuple[float, int, int, int]] = []

        def offer(left: int, middle: int, stop: int) -> None:
            score = self.scores.get(unit[left:stop])
            if score is not None:
                heapq.heappush(queue, (-score, left, middle, stop))

        for i in range(n - 1):
            offer(i, i + 1, i + 2)
        while queue:
            _, left, middle, stop = heapq.heappop(queue)
            if end[left] != middle or end[middle] != stop:
                continue        # one of its parts has grown or gone meanwhile
            end[left], end[middle], before[stop] = stop, -1, left
            if stop < n:
                offer(left, stop, end[stop])
            if left:
                offer(before[left], left, stop)
        cuts = [0]
        while cuts[-1] < n:
            cuts.append(end[cuts[-1]])
        return self.ids_of(unit, cuts)

    def _merge_short(self, unit: str) -> list[int]:
        """The same by looking at all pairs for each merge, which is faster for a few characters."""
        parts, score, none = list(unit), self.scores.get, -np.inf
        ranks = [score(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = max(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = score(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = score(parts[i] + parts[i + 1], none)
        ids = list(map(self.ids.get, parts))
        if None in ids:
            return self.ids_of(unit, [0, *itertools.accumulate(map(len, parts))])
        return ids

    def merge_text(self, text: str) -> bytes:
        """Ids of a whole text as the library gives them, where its scores are merge ranks."""
        return self.merge_units(self.units(self.library.normalize(text)))

    def merge_units(self, units: list[str]) -> bytes:
        distinct, places, _ = numbered([units])
        return self.merge_all(distinct, places)[0].tobytes()

    def merge_all(self, distinct: list[str], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids by merges of the units at the places, one after the other, and the number of each."""

        def learn(new: list[str], full: bool) -> None:
            if full:
                self.merged, self.merges = {}, Solved()
            easy, hard = self.arrays.sort(new, SHORT_UNIT)
            if easy:
                self._enter(self.merged, self.merges, easy, *self.arrays.merge(easy))
            if hard:
                found = [self.merge(unit) for unit in hard]
                ids = np.array(list(itertools.chain.from_iterable(found)), IDS)
                self._enter(self.merged, self.merges, hard, ids, np.array(list(map(len, found))))

        rows = self._rows(distinct, lambda: self.merged, lambda: self.merges, learn)
        return self.merges.take(rows[places])

    @staticmethod
    def _enter(index: dict[str, int], table: Solved, units: list[str], *columns: np.ndarray) -> None:
        index.update(zip(units, range(len(table), len(table) + len(units)), strict=True))
        table.extend(*columns)

    @staticmethod
    def _rows(units: list[str], index: Callable[[], dict[str, int]], table: Callable[[], Solved], learn: Callable) -> np.ndarray:
        """Rows of distinct units, new ones brought in by ``learn(units, whether the cache is full)``; long units are not kept."""
        rows = np.fromiter(map(index().get, units, itertools.repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            full = len(index()) + len(missing) > CACHE_UNITS or table().ids.size > CACHE_IDS
            if full:
                missing = np.arange(len(units))
            new = [units[i] for i in missing.tolist()]
            learn(new, full)
            rows[missing] = np.fromiter(map(index().__getitem__, new), np.int64, len(new))
            for unit in new:
                if len(unit) > LONG_UNIT:
                    del index()[unit]
        return rows

    def _learn(self, new: list[str], full: bool) -> None:
        if full:
            self.cache, self.older = {}, self.cache
            self.solved, self.older_solved = Solved(), self.solved
        if self.older:
            rows = [self.older.get(unit, -1) for unit in new]
            kept = [unit for unit, row in zip(new, rows, strict=True) if row >= 0]
            if kept:
                places = np.array([row for row in rows if row >= 0])
                self._enter(self.cache, self.solved, kept, *self.older_solved.take(places), *self.older_solved.lattice(places))
                new = [unit for unit, row in zip(new, rows, strict=True) if row < 0]
        easy, hard = self.arrays.sort(new, SHORT_UNIT)
        if easy:
            ids, sizes, scores, losses = self.arrays.solve(easy)
            self._enter(self.cache, self.solved, easy, ids, sizes, scores, losses, self._decode(easy, ids, sizes))
        if hard:
            parts, sizes, scores, losses = zip(*map(self.solve, hard), strict=True)
            ids, sizes = np.frombuffer(b"".join(parts), IDS), np.array(sizes)
            self._enter(self.cache, self.solved, hard, ids, sizes, np.array(scores), np.array(losses), self._decode(hard, ids, sizes))

    def _decode(self, units: list[str], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the ids of each unit decode to it."""
        texts, parts = [unit.replace(MARK, " ").encode() for unit in units], list(map(self.surface.__getitem__, ids.tolist()))
        ends = np.cumsum(sizes)
        lengths = np.add.reduceat(self.surface_sizes[ids], ends - sizes)
        if b"".join(parts) == b"".join(texts) and lengths.tolist() == list(map(len, texts)):
            return np.ones(len(units), bool)
        found = (b"".join(parts[a:b]) for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False))
        return np.array([a == b for a, b in zip(found, texts, strict=True)])

    def _choices(self, unit: str, n: int, best: bytes) -> list[tuple[float, bytes]]:
        """The n best of a unit, ids as bytes; of ties the cached best stays first."""
        found = self.chosen.get((unit, n))
        if found is None:
            found = [(score, id_bytes(ids)) for score, ids in self.n_best(unit, n)]
            at = next((p for p, (_, ids) in enumerate(found) if ids == best), None)
            if at is not None:
                found.insert(0, found.pop(at))
            if len(unit) <= LONG_UNIT:
                if len(self.chosen) >= CACHE_CHOICES:
                    self.chosen = {}
                self.chosen[unit, n] = found
        return found

    def encode(self, text: str, n: int = BEST) -> list[tuple[float, bytes]]:
        """The n best segmentations of a text (fewer if there are fewer): score and ids as bytes."""
        return self.encode_units(self.units(self.library.normalize(text)), n)

    def encode_units(self, units: list[str], n: int = BEST) -> list[tuple[float, bytes]]:
        return self.encode_all(*numbered([units]), n)[0][0]

    def encode_all(
        self, distinct: list[str], places: np.ndarray, stops: Sequence[int], n: int = BEST
    ) -> list[tuple[list[tuple[float, bytes]], bool]]:
        """Of each text, given by where its units end among the places: the n best segmentations, and whether all units decode."""
        rows = self._rows(distinct, lambda: self.cache, lambda: self.solved, self._learn)[places]
        ids, sizes = self.solved.take(rows)
        scores, losses, decodes = self.solved.lattice(rows)
        cuts, out, start = np.append(0, np.cumsum(sizes)), [], 0
        for stop in stops:
            here = slice(start, stop)
            found = self._combine(distinct, places[here], ids, cuts[start : stop + 1], scores[here], losses[here], n)
            out.append((found, bool(decodes[here].all())))
            start = stop
        return out

    def _combine(
        self, distinct: list[str], units: np.ndarray, ids: np.ndarray, cuts: np.ndarray, scores: np.ndarray, losses: np.ndarray, n: int
    ) -> list[tuple[float, bytes]]:
        """The n best of a text from those of its units, whose best ids lie between the cuts."""
        score, free = sum(scores.tolist()), []
        while len(free) < min(n - 1, len(units)):
            i = int(losses.argmin())        # the first of equals
            if losses[i] == np.inf:
                break
            free.append(i)
            losses[i] = np.inf
        choices = [self._choices(distinct[units[i]], n, ids[cuts[i] : cuts[i + 1]].tobytes()) for i in free]
        # what lies between the free units, with a place for each of these
        parts, at, own = [], cuts[0], {}
        for i in sorted(free):
            own[i] = len(parts) + 1
            parts += [ids[at : cuts[i]].tobytes(), b""]
            at = cuts[i + 1]
        parts.append(ids[at : cuts[-1]].tobytes())
        places = [own[i] for i in free]
        out, start = [], (0,) * len(free)
        queue, seen = [(0.0, start)], {start}
        while queue and len(out) < n:
            lost, picks = heapq.heappop(queue)
            for i, choice, pick in zip(places, choices, picks, strict=True):
                parts[i] = choice[pick][1]
            out.append((score - lost, b"".join(parts)))
            for place, pick in enumerate(picks):
                following = (*picks[:place], pick + 1, *picks[place + 1 :])
                if pick + 1 < len(choices[place]) and following not in seen:
                    seen.add(following)
                    step = choices[place][pick][0] - choices[place][pick + 1][0]
                    heapq.heappush(queue, (lost + step, following))
        return out

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = text.decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def piece_model(path: str) -> PieceModel:
    """One model per worker process, kept from task to task."""
    return worker_cache(("pieces", path), lambda: PieceModel(path))


FIELDS = [
    T.StructField("n_ids", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("nbest_scores", T.ArrayType(T.DoubleType())),
    T.StructField("nbest_crc32", T.ArrayType(T.LongType())),
    T.StructField("decodes", T.BooleanType()),
    T.StructField("n_merged", T.LongType()),
    T.StructField("merged_crc32", T.LongType()),
]


def _encode(texts: list[str], path: str, n: int) -> tuple:
    model, rows = piece_model(path), []
    normalised = [model.library.normalize(text) for text in texts]
    distinct, places, stops = model.block(normalised)
    merged, sizes = model.merge_all(distinct, places)
    cuts = np.append(0, np.cumsum(sizes))[[0, *stops]].tolist()
    for at, (best, same) in enumerate(model.encode_all(distinct, places, stops, n)):
        if not same:
            whole = normalised[at].replace(MARK, " ")
            same = model.decode(best[0][1]) == (whole[1:] if model.prefix and whole.startswith(" ") else whole)
        sums, scores = [zlib.crc32(ids) for _, ids in best], [s for s, _ in best]
        own = merged[cuts[at] : cuts[at + 1]]
        rows.append((len(best[0][1]) // 4, sums[0], best[0][0], scores, sums, same, len(own), zlib.crc32(own)))
    columns = list(zip(*rows, strict=True))
    types = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.bool_(), pa.int64(), pa.int64()]
    return tuple(pa.array(c, t) for c, t in zip(columns, types, strict=True))


def segmentations(docs: DataFrame, path: str, n: int = BEST, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Per row the columns ``keep`` and, of its n best segmentations, best first: their scores
    and checksums of their ids; of the best also its number of ids and whether it decodes to
    the normalised text; and number and checksum of the ids of the encoding by merges."""
    return with_text_columns(docs, keep, text_col, partial(_encode, path=path, n=n), FIELDS)


def _id_lists(parts: list[bytes]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(parts), np.int32))


def _encode_ids(texts: list[str], path: str, merges: bool) -> tuple:
    model = piece_model(path)
    distinct, places, stops = model.block(list(map(model.library.normalize, texts)))
    if merges:
        values, sizes = model.merge_all(distinct, places)
        ends = np.append(0, np.cumsum(sizes))[[0, *stops]].astype(np.int32)
        ids = pa.ListArray.from_arrays(ends, values.astype(np.int32))
    else:
        ids = _id_lists([best[0][1] for best, _ in model.encode_all(distinct, places, stops, 1)])
    return ids, pa.ListArray.from_arrays(ids.offsets, model.names.take(ids.values))


def encode_pieces(
    docs: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), text_col: str = "text", merges: bool = True
) -> DataFrame:
    """Per row the columns ``keep``, and the ids and pieces that the sentencepiece library gives for its text."""
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("pieces", T.ArrayType(T.StringType()))]
    return with_text_columns(docs, keep, text_col, partial(_encode_ids, path=path, merges=merges), fields)


def _n_best(texts: list[str], path: str, n: int) -> tuple:
    model = piece_model(path)
    block = model.block(list(map(model.library.normalize, texts)))
    found = [best for best, _ in model.encode_all(*block, n)]
    ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
    scores = pa.array([s for f in found for s, _ in f], pa.float64())
    ids = _id_lists([i for f in found for _, i in f])
    return (pa.ListArray.from_arrays(ends, scores), pa.ListArray.from_arrays(ends, ids))


def n_best_pieces(docs: DataFrame, path: str, n: int = BEST, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Per row the columns ``keep``, and scores and ids of its n best segmentations, best first."""
    ids = T.ArrayType(T.ArrayType(T.IntegerType()))
    fields = [T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("ids", ids)]
    return with_text_columns(docs, keep, text_col, partial(_n_best, path=path, n=n), fields)


def _decode_batches(batches: Iterator[pa.RecordBatch], path: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    model = piece_model(path)
    for batch in slices(batches):
        texts = [None if ids is None else model.decode(id_bytes(ids)) for ids in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=names)


def decode_pieces(encoded: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """Per row the columns ``keep`` and the text of its ids. Null ids give a null text, no ids an empty one.

    Byte pieces that are no UTF-8 become replacement characters; an id that the model has not is an error.
    """
    bounded_batches(encoded.sparkSession)
    rows = encoded.select(*keep, F.col(ids_col).cast("array<long>").alias("_ids"))
    kept = rows.schema.fields[:-1]
    places = [f"c{i}" for i in range(len(kept) + 1)]
    shape = T.StructType([*[T.StructField(p, f.dataType) for p, f in zip(places, kept, strict=False)], T.StructField(places[-1], T.StringType())])
    out = rows.toDF(*places).mapInArrow(partial(_decode_batches, path=path, names=places), shape)
    return out.toDF(*[f.name for f in kept], "text")

"""Piece lattices of many short units at a time, in arrays.

The units of a block are padded to a matrix of character classes, and one walk of the
trie finds the pieces from every place. The Viterbi passes and the merges then go place by
place over all units. Results, ties included, are those of ``PieceModel.solve`` and
``PieceModel.merge``. Only units in which every character is a piece by itself are taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np

CHUNK_UNITS = 1024      # units of similar length that are worked on together
IDS = np.dtype("<u4")


class Column:
    """An array that grows at its end."""

    def __init__(self, kind: type | np.dtype):
        self.held, self.size = np.empty(1024, kind), 0

    def extend(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.held):
            wider = np.empty(max(end, 2 * len(self.held)), self.held.dtype)
            wider[: self.size] = self.held[: self.size]
            self.held = wider
        self.held[self.size : end] = values
        self.size = end


class Solved:
    """One row per unit: ids, and for lattices score, what the second best loses and whether the ids decode to the unit."""

    def __init__(self):
        self.ids, self.starts, self.sizes = Column(IDS), Column(np.int64), Column(np.int64)
        self.scores, self.losses, self.decodes = Column(float), Column(float), Column(bool)

    def __len__(self) -> int:
        return self.starts.size

    def extend(self, ids: np.ndarray, sizes: np.ndarray, *lattice: np.ndarray) -> None:
        self.starts.extend(self.ids.size + np.cumsum(sizes) - sizes)
        self.ids.extend(ids)
        self.sizes.extend(sizes)
        for column, values in zip((self.scores, self.losses, self.decodes), lattice, strict=False):
            column.extend(values)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows, one after the other, and the number of ids of each."""
        sizes = self.sizes.held[rows]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1] if len(ends) else 0)
        places += np.repeat(self.starts.held[rows] - ends + sizes, sizes)
        return self.ids.held[places], sizes

    def lattice(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.scores.held[rows], self.losses.held[rows], self.decodes.held[rows]


def _table(pairs: dict[int, tuple]) -> tuple[np.ndarray, ...]:
    """Sorted keys, closed by one that is never asked for, and the columns of their values."""
    keys = np.array(sorted(pairs), np.int64)
    values = [np.array(column) for column in zip(*map(pairs.__getitem__, keys.tolist()), strict=True)]
    return np.append(keys, np.iinfo(np.int64).max), *values


class UnitArrays:
    def __init__(self, ids: dict[str, int], scores: dict[str, float]):
        single = [name for name in ids if len(name) == 1]
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[list(map(ord, single))] = np.arange(1, len(single) + 1)
        self.width = len(single) + 1
        self.single = np.array([-1, *map(ids.__getitem__, single)], np.int64)
        number = {c: k for k, c in enumerate(single, 1)}     # of every beginning of a piece; 0 is none
        steps, pairs = {}, {}
        self.longest = 1
        for name, piece in ids.items():
            if len(name) == 1 or not all(c in ids for c in name):
                continue
            self.longest = max(self.longest, len(name))
            for k in range(2, len(name) + 1):
                if name[:k] not in number:
                    number[name[:k]] = node = len(number) + 1
                    steps[number[name[: k - 1]] * self.width + int(self.classes[ord(name[k - 1])])] = (node,)
            for k in range(1, len(name)):
                left, right = ids.get(name[:k]), ids.get(name[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (scores[name], piece)
        self.step_keys, self.step_nodes = _table(steps or {-1: (0,)})
        self.pair_keys, self.pair_scores, self.pair_pieces = _table(pairs or {-1: (-np.inf, -1)})
        self.node_scores = np.full(len(number) + 1, -np.inf)
        self.node_pieces = np.full(len(number) + 1, -1, np.int64)
        for name, node in number.items():
            if name in ids:
                self.node_scores[node], self.node_pieces[node] = scores[name], ids[name]

    def sort(self, units: Sequence[str], longest: int) -> tuple[list[str], list[str]]:
        """The units that fit, shortest first, and the others."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        classes = self._classes(units)
        known = np.append(0, np.cumsum(classes > 0))
        ends = np.cumsum(lengths)
        fits = (known[ends] - known[ends - lengths] == lengths) & (lengths > 0) & (lengths <= longest)
        order = np.argsort(lengths, kind="stable")
        here = order[fits[order]]
        return [units[i] for i in here.tolist()], [units[i] for i in np.flatnonzero(~fits).tolist()]

    def _classes(self, units: Sequence[str]) -> np.ndarray:
        return self.classes[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")]

    def _chunks(self, units: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Classes by unit and place (0 beyond its end), and lengths."""
        for start in range(0, len(units), CHUNK_UNITS):
            part = units[start : start + CHUNK_UNITS]
            lengths = np.fromiter(map(len, part), np.int64, len(part))
            chars = np.zeros((len(part), int(lengths.max())), np.int32)
            chars[np.arange(chars.shape[1]) < lengths[:, None]] = self._classes(part)
            yield chars, lengths

    def _each(self, units: Sequence[str], work: Callable) -> tuple[np.ndarray, ...]:
        parts = [work(chars, lengths) for chars, lengths in self._chunks(units)]
        return tuple(np.concatenate(column) for column in zip(*parts, strict=True))

    def solve(self, units: Sequence[str]) -> tuple[np.ndarray, ...]:
        """Of the best segmentations: all ids, their number by unit, score, and what the second best loses."""
        return self._each(units, self._solve)

    def merge(self, units: Sequence[str]) -> tuple[np.ndarray, ...]:
        """Of the encodings by merges: all ids, their number by unit."""
        return self._each(units, self._merge)

    def _nodes(self, chars: np.ndarray) -> np.ndarray:
        """By unit, place and length - 1: the node of the trie that is reached, 0 if none."""
        count, n = chars.shape
        longest = min(self.longest, n)
        nodes = np.zeros((count * n, longest), np.int32)
        flat = chars.ravel()
        at = np.flatnonzero(flat)
        room, node = n - at % n, flat[at].astype(np.int64)
        nodes[at, 0] = node
        for k in range(1, longest):
            inside = room > k
            at, room, node = at[inside], room[inside], node[inside]
            keys = node * self.width + flat[at + k]
            found = np.searchsorted(self.step_keys, keys)
            hit = np.flatnonzero(self.step_keys[found] == keys)
            at, room, node = at[hit], room[hit], self.step_nodes[found[hit]]
            nodes[at, k] = node
        return nodes.reshape(count, n, longest)

    def _solve(self, chars: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        count, n = chars.shape
        nodes = self._nodes(chars)
        values, longest = self.node_scores[nodes], nodes.shape[2]
        forward = np.full((count, n + 1 + longest), -np.inf)
        forward[:, 0] = 0.0
        came = np.zeros(forward.shape, np.int64)
        for i in range(n):
            value, after = forward[:, i, None] + values[:, i], slice(i + 1, i + 1 + longest)
            better = value > forward[:, after]
            np.copyto(forward[:, after], value, where=better)
            np.copyto(came[:, after], i, where=better)
        # ids by the place where their piece begins, and the length - 1 of that piece
        ids, taken = np.full((count, n), -1, np.int64), np.full((count, n), -1, np.int64)
        rows, stop = np.arange(count), lengths
        while len(rows):
            start = came[rows, stop]
            length = stop - start - 1
            taken[rows, start] = length
            ids[rows, start] = self.node_pieces[nodes[rows, start, length]]
            rows, stop = rows[start > 0], start[start > 0]
        every = np.arange(count)
        backward, second = np.full(forward.shape, -np.inf), np.full(count, -np.inf)
        backward[every, lengths] = 0.0
        for i in reversed(range(n)):
            value = values[:, i] + backward[:, i + 1 : i + 1 + longest]
            np.maximum(backward[:, i], value.max(axis=1), out=backward[:, i])
            # any other segmentation has an edge that the best has not
            value += forward[:, i, None]
            best = np.flatnonzero(taken[:, i] >= 0)
            value[best, taken[best, i]] = -np.inf
            np.maximum(second, value.max(axis=1), out=second)
        score, used = forward[every, lengths], ids >= 0
        return ids[used], used.sum(axis=1), score, score - second

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and id of the piece that two pieces make, -inf if none."""
        keys = left << 32 | right
        found = np.searchsorted(self.pair_keys, keys)
        hit = self.pair_keys[found] == keys
        found[~hit] = 0
        return np.where(hit, self.pair_scores[found], -np.inf), self.pair_pieces[found]

    def _merge(self, chars: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        count, n = chars.shape
        parts = self.single[chars].ravel()      # id of the part that begins at a place, -1 if none does
        after = np.tile(np.arange(1, n + 1), count)
        before = np.tile(np.arange(-1, n - 1), count)
        scores, pieces = np.full(count * n, -np.inf), np.full(count * n, -1, np.int64)

        def offer(left: np.ndarray, right: np.ndarray) -> None:
            scores[left], pieces[left] = self._pair(parts[left], parts[right])

        places = np.flatnonzero((np.arange(n) + 1 < lengths[:, None]).ravel())
        offer(places, places + 1)
        rows = np.flatnonzero(lengths > 1)
        while len(rows):
            best = scores.reshape(count, n)[rows].argmax(axis=1)     # the leftmost of equals
            at = rows * n + best
            joins = scores[at] > -np.inf
            rows, best, at = rows[joins], best[joins], at[joins]
            base = at - best
            right = base + after[at]
            stop = after[right]
            parts[at], parts[right], after[at] = pieces[at], -1, stop
            scores[at] = scores[right] = -np.inf
            more = stop < lengths[rows]
            before[base[more] + stop[more]] = best[more]
            offer(at[more], base[more] + stop[more])
            more = before[at] >= 0
            offer(base[more] + before[at[more]], at[more])
        parts = parts.reshape(count, n)
        used = parts >= 0
        return parts[used], used.sum(axis=1)

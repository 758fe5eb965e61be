"""Toxic documents by a subsequence string kernel: a support vector machine on Nyström landmarks.

The kernel of two strings sums, over all subsequences of four symbols that both hold within
seven places, the product of their weights 0.8**places. So an insult with characters put in
between still shares subsequences with the plain one, at a lower weight. Symbols are letters
without case, three classes of accented ones, digits, and a separator; marks and characters
without width are no symbols, and separators between single letters are left out, so that
``i-d-i o.t`` reads as the word. No subsequence crosses the end of a sentence.

Sentences are read in stretches of twelve starting places, all of them. Labels are of
documents: of a toxic one, its most toxic stretch is the example, found anew after each
fit (multiple-instance learning), and of a clean one its most toxic stretches are
counter-examples. The words that decide stretches of both kinds are the landmarks; a stretch is described by its
kernel with them, whitened by their own kernel matrix, and a linear machine with squared hinge
loss is fitted on that. As the kernel has a finite feature map (2**20 subsequences), the
decision is the sum of one weight per subsequence, folded once from landmarks and machine, so
scoring needs no kernel evaluations. A document's score is that of its most toxic stretch.

Null texts count as empty; those and texts without a letter have no subsequence and the
score of an empty stretch. Rows that repeat score alike. A label other than 0 and 1 counts
as none; a document with both labels is an example of both. Without labels of both kinds all
scores are 0.5. Other columns pass through by place. Texts of any length are read whole.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ionloom.llm.codes import code_points, is_letter
from ionloom.llm.files import written
from ionloom.llm.memory import bounded_batches
from ionloom.llm.rows import slices, with_text_columns
from ionloom.llm.tokens import blocks

ORDER, SPAN, DECAY = 4, 7, 0.8
BITS = 5                    # of a symbol
CELLS = 1 << (BITS * ORDER)
STRETCH = 12                # starting places of a stretch
WIDTH = STRETCH + SPAN - 1  # symbols it reads
SEPARATOR, DIGIT, ACCENTED, OUTSIDE, NOTHING = 0, 27, 28, 31, 255
LANDMARKS = 256
SAMPLE_DOCS = 3_000         # training documents per label, about
ROUNDS = 4
NEGATIVES = 3               # stretches of a clean document in each round
REGULAR = 1e-3
THRESHOLD = 0.7
AT_ONCE = 1 << 16           # places looked up together
PATTERNS = [(a, b, c) for c in range(ORDER - 1, SPAN) for a, b in combinations(range(1, c), 2)]
_SYMBOLS: list[np.ndarray] = []


def _symbol(code: int) -> int:
    char = chr(code)
    if unicodedata.category(char) in ("Mn", "Cf"):
        return NOTHING
    lower = char.lower()
    base = unicodedata.normalize("NFKD", lower)[:1]
    if "a" <= base <= "z":
        return ord(base) - 96 if unicodedata.normalize("NFKC", lower) == base else ACCENTED + ord(lower[0]) % 3
    if char.isdigit():
        return DIGIT
    return 1 + code % 26 if char.isalpha() else SEPARATOR


def symbols(codes: np.ndarray) -> np.ndarray:
    """Symbol of each code point."""
    if not _SYMBOLS:
        _SYMBOLS.append(np.array([_symbol(i) for i in range(1 << 16)], np.uint8))
    out = _SYMBOLS[0][np.minimum(codes, 0xFFFF)]
    high = np.flatnonzero(codes > 0xFFFF)
    if len(high):
        out[high] = np.where(is_letter(codes[high]), 1 + codes[high] % 26, SEPARATOR)
    return out


def streams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts in a row, where each text begins in it (one more at the end), and where symbols come from.

    A text has a separator before and after it and ``SPAN`` places outside around these.
    """
    codes, starts = code_points(texts)
    found = symbols(codes)
    stop = (codes == 46) | (codes == 33) | (codes == 63)
    after = np.append(found[1:], np.uint8(SEPARATOR)) == SEPARATOR
    last = starts[1:][np.diff(starts) > 0] - 1
    after[last] = True
    space_next = np.append((codes[1:] == 32) | (codes[1:] == 10) | (codes[1:] == 13), True)
    space_next[last] = True
    found[(codes == 10) | (stop & after & space_next)] = OUTSIDE
    at = np.flatnonzero(found != NOTHING)
    found, text = found[at], np.searchsorted(starts, at, "right") - 1
    # a run of separators, or of separators and ends, is one
    gap = (found == SEPARATOR) | (found == OUTSIDE)
    same = np.append(False, text[1:] == text[:-1])
    repeated = np.append(False, gap[:-1]) & gap & same & (found == SEPARATOR)
    at, found, text, gap = (x[~repeated] for x in (at, found, text, gap))
    begins = np.append(True, text[1:] != text[:-1]) if len(text) else np.zeros(0, bool)
    before = np.append(True, gap[:-1])[: len(gap)] | begins
    behind = np.append(gap[1:], True)[: len(gap)] | np.append(begins[1:], True)[: len(gap)]
    single = ~gap & before & behind
    left, right = np.append(False, single[:-1])[: len(gap)], np.append(single[1:], False)[: len(gap)]
    joined = (found == SEPARATOR) & left & right & ~before & ~behind
    at, found, text = (x[~joined] for x in (at, found, text))
    count = np.bincount(text, minlength=len(texts))
    size = count + 2 + 2 * SPAN
    first = np.cumsum(np.append(0, size))
    out = np.full(first[-1] + WIDTH, OUTSIDE, np.uint8)
    place = first[text] + SPAN + 1 + np.arange(len(text)) - np.append(0, np.cumsum(count))[text]
    out[place] = found
    out[first[:-1] + SPAN] = out[first[1:] - SPAN - 1] = SEPARATOR
    origin = np.zeros(len(out), np.int64)
    origin[place] = at - starts[text]
    return out, first, origin


def cells(stream: np.ndarray, start: int, stop: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each pattern of places its reach and the subsequence at every starting place."""
    part = stream[start : stop + SPAN - 1].astype(np.int64)
    n = stop - start
    second = {a: part[:n] << 15 | part[a : a + n] << 10 for a in range(1, ORDER + 1)}
    last = {d: part[: len(part) - d] << 5 | part[d:] for d in range(1, ORDER + 1)}
    for a, b, c in PATTERNS:
        yield c + 1, second[a] | last[c - b][b : b + n]


def allowed() -> np.ndarray:
    """Which subsequences lie inside a sentence."""
    fields = [np.arange(CELLS) >> (BITS * i) & 31 for i in range(ORDER)]
    return np.logical_and.reduce([f != OUTSIDE for f in fields])


def stretch_sums(stream: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of decayed weights of the stretch from each place, added up alike wherever it stands."""
    n = len(stream) - SPAN + 1
    one = np.zeros(n + STRETCH, np.float64)
    for start in range(0, n, AT_ONCE):
        stop = min(start + AT_ONCE, n)
        total = np.zeros((SPAN + 1, stop - start), np.float32)
        for reach, cell in cells(stream, start, stop):
            total[reach] += weights[cell]
        for reach in range(ORDER, SPAN + 1):
            one[start:stop] += total[reach] * DECAY**reach
    two = one[:-1] + one[1:]
    four = two[:-2] + two[2:]
    eight = four[:-4] + four[4:]
    return eight[:n] + four[8 : n + 8]


def features(stretches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subsequences of stretches (rows of ``WIDTH`` symbols) and their weights, 0 for those that leave the sentence."""
    rows = [[], []]
    wide = stretches.astype(np.int64)
    for a, b, c in PATTERNS:
        parts = [wide[:, i : i + STRETCH] for i in (0, a, b, c)]
        inside = np.logical_and.reduce([p != OUTSIDE for p in parts])
        rows[0].append(parts[0] << 15 | parts[1] << 10 | parts[2] << 5 | parts[3])
        rows[1].append(inside * np.float32(DECAY ** (c + 1)))
    return np.concatenate(rows[0], axis=1), np.concatenate(rows[1], axis=1)


@dataclass
class ToxicityModel:
    """Weight of each subsequence, bias, and the scale and shift that make a margin a score. No weights: no labels."""

    weights: np.ndarray
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0

    def margins(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: the margin of its most toxic stretch; and where that begins and ends in the text."""
        stream, first, origin = streams(texts)
        sums = stretch_sums(stream, self.weights)
        # a stretch from a later place would reach into the next text
        ends = first[1:] - SPAN + 1
        best = np.maximum.reduceat(sums, np.column_stack([first[:-1], ends]).ravel())[::2] if len(texts) else np.zeros(0)
        spans = np.zeros((len(texts), 2), np.int64)
        for i in np.flatnonzero(self.chance(best + self.bias) >= THRESHOLD):
            at = first[i] + int(np.argmax(sums[first[i] : ends[i]]))
            inside = origin[at : at + WIDTH][stream[at : at + WIDTH] != OUTSIDE]
            spans[i] = inside[inside > 0].min(initial=inside.max(initial=0)), inside.max(initial=0) + 1
        return best + self.bias, spans[:, 0], spans[:, 1]

    def chance(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * margin + self.shift, -500, 500)))

    def score(self, texts: Sequence[str]) -> tuple[np.ndarray, list[str | None]]:
        """Score of each text and, from the threshold on, the sentence that decides."""
        if not len(self.weights):
            return np.full(len(texts), 0.5), [None] * len(texts)
        margin, low, high = self.margins(texts)
        score = self.chance(margin)
        said = [_sentence(t, a, b) if s >= THRESHOLD else None for t, a, b, s in zip(texts, low, high, score, strict=True)]
        return score, said


def _sentence(text: str, low: int, high: int) -> str:
    begin = max(text.rfind(mark, 0, low) for mark in (". ", "! ", "? ", "\n")) + 1
    ends = [e for e in (text.find(mark, high) for mark in (". ", "! ", "? ", "\n")) if e >= 0]
    return text[begin : min(ends, default=len(text) - 1) + 1].strip()


# ---- learning


def nystrom(stretches: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Kernel of every stretch with every landmark."""
    cell, weight = features(landmarks)
    known = np.unique(cell[weight > 0])
    place = np.full(CELLS, -1, np.int32)
    place[known] = np.arange(len(known))
    table = np.zeros((len(known), len(landmarks)), np.float32)
    row, column = np.nonzero(weight)
    np.add.at(table, (place[cell[row, column]], row), weight[row, column])
    out = np.zeros((len(stretches), len(landmarks)), np.float32)
    for start in range(0, len(stretches), 64):
        cell, weight = features(stretches[start : start + 64])
        row, column = np.nonzero(weight * (place[cell] >= 0))
        held = np.zeros((len(cell), len(known)), np.float32)
        np.add.at(held, (row, place[cell[row, column]]), weight[row, column])
        out[start : start + 64] = held @ table
    return out


def fit_machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, regular: float = REGULAR, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias with the least squared hinge loss, by Newton steps on the examples inside the margin."""
    wide = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    keep = regular * np.append(np.ones(x.shape[1]), 1e-6)
    w, cost = np.zeros(wide.shape[1]), cost / cost.sum()
    active = np.ones(len(y), bool)
    for _ in range(steps):
        part, c = wide[active], cost[active]
        w = np.linalg.solve((part * c[:, None]).T @ part + np.diag(keep), part.T @ (c * y[active]))
        now = y * (wide @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def learn(stretches: np.ndarray, labels: np.ndarray, landmarks: np.ndarray) -> ToxicityModel:
    """The machine on whitened landmark kernels, folded to a weight per subsequence."""
    own = nystrom(landmarks, landmarks).astype(np.float64)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    keep = value > 1e-6 * value[-1]
    whiten = vector[:, keep] / np.sqrt(value[keep])
    x = nystrom(stretches, landmarks) @ whiten
    y = np.where(labels == 1, 1.0, -1.0)
    cost = np.where(labels == 1, 1 / max((labels == 1).sum(), 1), 1 / max((labels == 0).sum(), 1))
    w, bias = fit_machine(x, y, cost)
    each = whiten @ w
    cell, weight = features(landmarks)
    folded = np.bincount(cell.ravel(), (weight * each[:, None]).ravel(), CELLS)
    return ToxicityModel(folded.astype(np.float32), bias)


def calibrate(margin: np.ndarray, label: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Scale and shift of a logistic curve through margins, both labels alike, with targets short of 0 and 1."""
    plus, minus = max((label == 1).sum(), 1), max((label == 0).sum(), 1)
    target = np.where(label == 1, (plus + 1) / (plus + 2), 1 / (minus + 2))
    cost = np.where(label == 1, 0.5 / plus, 0.5 / minus)
    x, w = np.column_stack([margin, np.ones(len(margin))]), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (cost * (p - target)) + 1e-6 * w
        curve = (x * (cost * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros((2, CELLS), np.int32)
    inside = allowed()
    for batch in slices(batches):
        texts, labels = _texts(batch), batch.column(1).to_pylist()
        for i, text in enumerate(texts):
            seen = np.zeros(CELLS, bool)
            stream, _, _ = streams([text])
            for start in range(0, len(stream) - SPAN + 1, AT_ONCE):
                for _, cell in cells(stream, start, min(start + AT_ONCE, len(stream) - SPAN + 1)):
                    seen[cell] = True
            held[labels[i]] += seen & inside
    at = np.flatnonzero(held.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[1, at].astype(np.int64)), pa.array(held[0, at].astype(np.int64))], ["cell", "plus", "minus"])


def _best(batches: Iterator[pa.RecordBatch], model, most: int) -> Iterator[pa.RecordBatch]:
    """Per document its margin and its best stretches, which do not overlap."""
    model = model.value
    for batch in slices(batches):
        texts = _texts(batch)
        for low, high in blocks(texts):
            stream, first, _ = streams(texts[low:high])
            sums = stretch_sums(stream, model.weights)
            found, top = [], []
            for a, b in zip(first[:-1], first[1:], strict=True):
                here = sums[a : b - SPAN + 1]
                parts = np.append(here, np.full(-len(here) % STRETCH, -np.inf)).reshape(-1, STRETCH)
                at = parts.argmax(axis=1) + np.arange(len(parts)) * STRETCH
                order = np.argsort(-here[at], kind="stable")[:most]
                found.append(b"".join(stream[a + p : a + p + WIDTH].tobytes() for p in at[order].tolist()))
                top.append(float(here[at[order[0]]]) + model.bias)
            rows = batch.slice(low, high - low)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(top), pa.array(found, pa.binary())], ["doc_id", "toxic", "margin", "stretches"])


def sample_of(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, toxic and one whole text of about ``sample`` labelled ids of each kind, picked by a hash."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    rate = F.when(F.col("toxic") == 1, min(1.0, sample / max(sizes.get(1, 0), 1))).otherwise(min(1.0, sample / max(sizes.get(0, 0), 1)))
    drawn = docs.select("doc_id", "text").join(F.broadcast(known.where(draw < rate)), "doc_id")
    # one row for each labelled id, however often the id is repeated
    return drawn.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, landmarks: int = LANDMARKS) -> ToxicityModel:
    """Fit on ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic).

    About ``sample`` labelled documents of each kind are read, whole, on the cluster;
    only counts of subsequences and few short stretches of each come to the driver.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = written(sample_of(docs, labels, sample).repartition(spark.sparkContext.defaultParallelism * 2, "doc_id"), "toxic-sample")
    kinds = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if set(kinds) != {0, 1}:
        return ToxicityModel(np.zeros(0, np.float32))
    counted = rows.mapInArrow(_count_cells, "cell int, plus long, minus long").groupBy("cell")
    table = counted.agg(F.sum("plus").alias("plus"), F.sum("minus").alias("minus")).where("plus > 1").toArrow()
    share = np.zeros((2, CELLS))
    share[:, table["cell"].to_numpy()] = np.stack([table["plus"].to_numpy() / kinds[1], table["minus"].to_numpy() / kinds[0]])
    pooled = np.maximum((share[0] * kinds[1] + share[1] * kinds[0]) / (kinds[0] + kinds[1]), 1e-12)
    apart = (share[0] - share[1]) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / kinds[0] + 1 / kinds[1]))
    model = ToxicityModel((np.maximum(apart, 0) ** 2).astype(np.float32))
    chosen, clean = None, np.zeros((0, WIDTH), np.uint8)
    for turn in range(ROUNDS + 1):
        shared = spark.sparkContext.broadcast(model)
        shape = "doc_id long, toxic int, margin double, stretches binary"
        found = rows.mapInArrow(partial(_best, model=shared, most=NEGATIVES), shape).toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
        shared.unpersist()
        label = found["toxic"].to_numpy()
        if turn == ROUNDS:
            model.scale, model.shift = calibrate(found["margin"].to_numpy(), label)
            return model
        parts = [np.frombuffer(s, np.uint8).reshape(-1, WIDTH) for s in found["stretches"].to_pylist()]
        plus = np.stack([p[0] for p, kind in zip(parts, label, strict=True) if kind == 1])
        clean = np.unique(np.concatenate([clean, *[p for p, kind in zip(parts, label, strict=True) if kind == 0]]), axis=0)
        if chosen is None:
            chosen = landmarks_of(plus, clean, model.weights, landmarks)
        stretches = np.concatenate([plus, clean])
        model = learn(stretches, np.append(np.ones(len(plus), int), np.zeros(len(clean), int)), chosen)


def words_of(stretch: np.ndarray) -> Iterator[np.ndarray]:
    """The words of a stretch, each with its separators and nothing else around it."""
    edges = [-1, *np.flatnonzero((stretch == SEPARATOR) | (stretch == OUTSIDE)).tolist(), len(stretch)]
    for before, behind in zip(edges[:-1], edges[1:], strict=True):
        part = stretch[max(before, 0) : behind + 1]
        if behind - before > ORDER:
            word = np.full(WIDTH, OUTSIDE, np.uint8)
            word[: len(part)] = part
            yield word


def landmarks_of(plus: np.ndarray, minus: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """The words that decide most stretches, three of four from toxic documents; without words whole stretches."""
    picked = []
    for part, size in ((plus, n - n // 4), (minus, n // 4)):
        found: Counter = Counter()
        for stretch in part:
            words = np.stack(list(words_of(stretch)) or [stretch])
            cell, weight = features(words)
            found[words[int(np.argmax((weights[cell] * weight).sum(axis=1)))].tobytes()] += 1
        best = sorted(found.items(), key=lambda x: (-x[1], x[0]))[:size]
        picked += [np.frombuffer(word, np.uint8) for word, _ in best]
    return np.stack(picked)


# ---- scoring

FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("sentence", T.StringType()), T.StructField("predicted", T.IntegerType())]


def _score(texts: list[str], model, threshold: float) -> tuple:
    score, said = model.value.score(texts)
    return score, pa.array(said, pa.string()), (score >= threshold).astype(np.int32)


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: Sequence[str] = ("doc_id",), text_col: str | Column = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep`` of every row, with score, the deciding sentence and predicted (1 from the threshold on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return with_text_columns(docs, keep, text_col, partial(_score, model=shared, threshold=threshold), FIELDS)

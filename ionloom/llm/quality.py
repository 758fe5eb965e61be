"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 256 characters (the last may be shorter), all of
them. A passage is described by the shape of its characters, by hashed pairs of
character classes and letters, and by how often a word repeats the one before. An
encoder maps it to h = tanh(W f + b); gated attention gives it the weight
softmax(w (tanh(V h) * sigmoid(U h))) within its document; and the score is
sigmoid(c z + d) of the weighted sum z. All parts are learnt together from document
labels only.

Null text counts as empty: one empty passage. Rows that repeat are scored alike;
rows with a null or repeated label each count as they are. Without labels of both
kinds the score of every document is 0.5.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ionloom.llm.codes import code_points, hashed, is_letter
from ionloom.llm.rows import with_text_columns

PASSAGE = 256               # characters in a passage
PAIR_BITS = 7               # buckets of character pairs, as a power of two
HIDDEN, GATE = 32, 16
SAMPLE_DOCS = 3_000         # training documents per label, about
EPOCHS, BATCH, RATE, DECAY = 12, 64, 4e-3, 1e-5
THRESHOLD = 0.3
FEATURES = 8 + (1 << PAIR_BITS)


def passages(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and each text's number of passages (1 at least)."""
    codes, starts = code_points(texts)
    length = np.diff(starts)
    count = np.maximum(-(-length // PASSAGE), 1)
    first = np.cumsum(np.append(0, count))
    features = np.zeros((first[-1], FEATURES), np.float32)
    if len(codes):
        doc = np.repeat(np.arange(len(texts)), length)
        place = first[doc] + (np.arange(len(codes)) - starts[doc]) // PASSAGE
        size = np.bincount(place, minlength=len(features)).astype(np.float32)
        letter = is_letter(codes)
        space = (codes == 32) | ((codes >= 9) & (codes <= 13)) | (codes == 160)
        digit = (codes >= 48) & (codes <= 57)
        upper = letter & (((codes >= 65) & (codes <= 90)) | ((codes >= 192) & (codes <= 222)))
        other = ~(letter | space | digit)
        begins = ~space & np.append(True, space[:-1] | (doc[1:] != doc[:-1]))
        word = np.cumsum(begins) - 1
        at = np.flatnonzero(begins)
        repeats = np.zeros(len(codes), bool)
        if len(at):
            inside = (np.arange(len(codes)) - at[np.maximum(word, 0)]).astype(np.uint32)
            mixed = (codes + np.uint32(1)) * (inside * np.uint32(2654435761) | np.uint32(1))
            name = np.add.reduceat(np.where(space, np.uint32(0), mixed), at)
            repeats[at[1:]] = (name[1:] == name[:-1]) & (doc[at[1:]] == doc[at[:-1]])
        whole = np.maximum(size, 1)
        for i, flag in enumerate((letter, upper, digit, space, other, begins, repeats)):
            features[:, i] = np.bincount(place, flag, len(features)) / whole
        features[:, 6] *= 1 / np.maximum(features[:, 5], 1e-3)     # of words, not of characters
        features[:, 7] = size / PASSAGE
        # letters count as one class per case, so pairs show shape and not vocabulary
        kind = np.where(letter, np.where(upper, 1, 2), np.where(digit, 3, np.where(space, 4, codes))).astype(np.uint32)
        pair = hashed([kind[:-1], kind[1:]], PAIR_BITS, 3)
        same = place[1:] == place[:-1]
        cell = place[1:][same] * (1 << PAIR_BITS) + pair[same]
        pairs = np.bincount(cell, minlength=len(features) << PAIR_BITS).reshape(len(features), -1)
        features[:, 8:] = np.sqrt(pairs / whole[:, None])
    return features, count


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class QualityModel:
    """Weights of encoder, gate and classifier, and the scaling of features. No weights: no labels."""

    weights: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray

    def forward(self, features: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        w, count = self.weights, np.diff(np.append(starts, len(features)))
        x = (features - self.mean) / self.scale
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        logit = (t * g) @ w["w"]
        top = np.repeat(np.maximum.reduceat(logit, starts), count)
        e = np.exp(logit - top)
        attention = e / np.repeat(np.add.reduceat(e, starts), count)
        z = np.add.reduceat(attention[:, None] * h, starts, axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "a": attention, "z": z, "p": _sigmoid(z @ w["c"] + w["d"][0])}

    def score(self, texts: Sequence[str]) -> np.ndarray:
        if not self.weights:
            return np.full(len(texts), 0.5)
        features, count = passages(texts)
        return self.forward(features, np.cumsum(np.append(0, count[:-1])))["p"].astype(np.float64)

    def gradients(self, features: np.ndarray, starts: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict:
        """Of the mean weighted cross entropy."""
        w, f = self.weights, self.forward(features, starts)
        count = np.diff(np.append(starts, len(features)))
        error = (f["p"] - label) * weight / len(label)
        dz = np.repeat(error[:, None] * w["c"][None], count, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        dlogit = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), count))
        dt = dlogit[:, None] * w["w"] * f["g"] * (1 - f["t"] ** 2)
        dg = dlogit[:, None] * w["w"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
        return {
            "W": f["x"].T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg,
            "w": (f["t"] * f["g"]).T @ dlogit, "c": f["z"].T @ error, "d": np.array([error.sum()]),
        }


def learn(features: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> QualityModel:
    """Fit on bags of passage features by Adam; both labels weigh the same in total."""
    if len(set(labels.tolist())) < 2:
        return QualityModel({}, np.zeros(1), np.ones(1))
    random = np.random.default_rng(seed)
    every = np.concatenate(features)
    shapes = {"W": (FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}
    weights = {k: random.normal(0, s[0] ** -0.5, s).astype(np.float32) * (k not in "bd") for k, s in shapes.items()}
    model = QualityModel(weights, every.mean(axis=0), every.std(axis=0) + np.float32(0.02))
    share = len(labels) / 2 / np.array([(labels == 0).sum(), (labels == 1).sum()])
    first, second = ({k: np.zeros(s, np.float32) for k, s in shapes.items()} for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        order = random.permutation(len(labels))
        for part in np.array_split(order, -(-len(order) // BATCH)):
            bags = [features[i] for i in part]
            starts = np.cumsum([0, *[len(b) for b in bags[:-1]]])
            label = labels[part]
            step += 1
            for k, gradient in model.gradients(np.concatenate(bags), starts, label, share[label]).items():
                first[k] = 0.9 * first[k] + 0.1 * gradient
                second[k] = 0.999 * second[k] + 0.001 * gradient**2
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                weights[k] -= (RATE * (move + DECAY * weights[k])).astype(np.float32)
    return model


def _bags(texts: list[str]) -> tuple:
    features, count = passages(texts)
    parts = np.split(features.astype(np.float16), np.cumsum(count)[:-1])
    return (pa.array([p.tobytes() for p in parts], pa.binary()),)


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> QualityModel:
    """Fit on ``docs`` (doc_id, text) with ``labels`` (doc_id, quality); only labels 0 and 1 count, each pair once.

    About ``sample`` labels of each kind, picked by a hash, go to all tasks, so texts
    stay where they are. The passages of those documents' whole texts are described on
    the cluster, and that bounded sample is fitted on the driver.
    """
    known = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int")).distinct()
    sizes = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    rate = F.when(F.col("quality") == 1, min(1.0, sample / max(sizes.get(1, 0), 1))).otherwise(
        min(1.0, sample / max(sizes.get(0, 0), 1))
    )
    drawn = docs.select("doc_id", "text").join(F.broadcast(known.where(draw < rate)), "doc_id")
    bags = with_text_columns(drawn, ["doc_id", "quality"], "text", _bags, [T.StructField("bag", T.BinaryType())])
    table = bags.toArrow().sort_by([("doc_id", "ascending"), ("quality", "ascending")])
    features = [
        np.frombuffer(b, np.float16).reshape(-1, FEATURES).astype(np.float32) for b in table["bag"].to_pylist()
    ]
    return learn(features, table["quality"].to_numpy().astype(np.int64)) if features else learn([], np.zeros(0, np.int64))


def _score(texts: list[str], model) -> tuple:
    return (model.value.score(texts),)


def score_quality(docs: DataFrame, model: QualityModel, keep: Sequence[str] = ("doc_id",), text_col: str | Column = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep`` of every row, with score and predicted (1 from the threshold on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    found = with_text_columns(docs, keep, text_col, partial(_score, model=shared), [T.StructField("score", T.DoubleType())])
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

"""Language identification by error-correcting output codes over character n-grams.

Each language has a codeword of signs. For each bit a binary classifier tells the
languages with a plus from those with a minus: its weights are log odds of hashed
letter bigrams and trigrams, with every language counted alike. A text's margin per
bit is the mean weight of its n-grams, scaled by the evidence there is. The codeword
with the smallest logistic loss wins (loss-weighted decoding). ``score`` is its share
of exp(-loss) over all codewords, and ``ambiguous`` says that the runner-up is close.

Null text, empty text and text without a letter are ``und`` with score 0. Rows that
repeat are predicted alike. Without any training rows every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ionloom.llm.codes import SPACE, hashed, padded_letters
from ionloom.llm.memory import bounded_batches
from ionloom.llm.rows import with_text_columns
from ionloom.llm.tokens import blocks

BITS = 14                   # buckets per n-gram length, as a power of two
SAMPLE_DOCS = 5_000         # training documents per language, about
EVIDENCE = 400              # n-grams after which a margin is not trusted more
AMBIGUOUS = 0.2             # smallest lead in score of the winner
EXHAUSTIVE = 7              # up to so many languages all dichotomies are used
UNKNOWN = "und"


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of +1 and -1: all dichotomies for few classes, else the best of random dense codes."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= EXHAUSTIVE:
        columns = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(columns, np.int8).T
    random, length = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for _ in range(200):
        code = random.choice(np.array([1, -1], np.int8), size=(n, length))
        apart = (length - code.astype(int) @ code.T.astype(int)) // 2
        least = apart[~np.eye(n, dtype=bool)].min()
        useful = (abs(code.sum(axis=0)) < n).all()
        if useful and least > far:
            best, far = code, least
    return best


def ngram_buckets(codes: np.ndarray) -> list[np.ndarray]:
    """Bucket of the bigram and of the trigram at each position; -1 where it starts with two spaces."""
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    empty = (a == SPACE) & (b == SPACE)
    out = []
    for place, parts in enumerate(([a, b], [a, b, c])):
        bucket = hashed(parts, BITS, place).astype(np.int64) + (place << BITS)
        bucket[empty] = -1
        out.append(bucket)
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray            # [languages, bits]
    weights: np.ndarray         # [buckets + 1, bits]; the last row is the bucket -1

    def margins(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        codes, starts, has = padded_letters(texts)
        total = np.zeros((len(texts), self.code.shape[1]), np.float64)
        n = np.zeros(len(texts))
        for bucket in ngram_buckets(codes):
            total += np.add.reduceat(self.weights[bucket], starts, axis=0, dtype=np.float64)
            n += np.add.reduceat(bucket >= 0, starts)
        n = np.maximum(n, 1)
        return total / n[:, None] * np.sqrt(np.minimum(n, EVIDENCE))[:, None], has

    def predict(self, texts: Sequence[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each text."""
        if not self.languages or not len(texts):
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        margin, has = self.margins(texts)
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]).sum(axis=2)
        share = np.exp(loss.min(axis=1, keepdims=True) - loss)
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        ordered = np.sort(share, axis=1)
        lead = ordered[:, -1] - (ordered[:, -2] if share.shape[1] > 1 else 0)
        names = [self.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
        return names, np.where(has, ordered[:, -1], 0.0), (lead < AMBIGUOUS) | ~has


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, group in batch.groupby("lang"):
            texts = [t for t in group["text"] if isinstance(t, str)]
            for start, stop in blocks(texts):
                codes, _, _ = padded_letters(texts[start:stop])
                held = counts.setdefault(lang, np.zeros(2 << BITS, np.int64))
                for bucket in ngram_buckets(codes):
                    held += np.bincount(bucket[bucket >= 0], minlength=len(held))
    for lang, held in counts.items():
        at = np.flatnonzero(held)
        yield pd.DataFrame({"lang": lang, "bucket": at, "n": held[at]})


def fit_languages(train: DataFrame, sample: int = SAMPLE_DOCS) -> LanguageModel:
    """Fit on ``train`` (doc_id, text, lang; rows with a null are left out).

    About ``sample`` documents per language, picked by a hash, are counted; rare
    languages are counted in full. Counts are added up on the cluster, and only the
    model, whose size is that of its buckets and languages, comes to the driver.
    """
    bounded_batches(train.sparkSession)
    known = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    code = codewords(len(languages))
    if not languages:
        return LanguageModel([], code, np.zeros((1, 1), np.float32))
    rates = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample / sizes[lang]))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    rows = known.where(draw < rates[F.col("lang")]).select("lang", "text")
    counted = rows.mapInPandas(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counted.toPandas()
    counts = np.zeros((len(languages), 2 << BITS))
    place = {lang: i for i, lang in enumerate(languages)}
    counts[table["lang"].map(place).to_numpy(int), table["bucket"].to_numpy(int)] = table["n"].to_numpy()
    weights = np.zeros(((2 << BITS) + 1, code.shape[1]), np.float32)
    for order in range(2):
        part = slice(order << BITS, (order + 1) << BITS)
        total = np.maximum(counts[:, part].sum(axis=1, keepdims=True), 1)
        # the same floor for all languages: an n-gram that none has seen tells nothing
        share = counts[:, part] / total + 0.1 / total.mean()
        for bit in range(code.shape[1]):
            plus, minus = (share[code[:, bit] == sign] for sign in (1, -1))
            if len(plus) and len(minus):
                weights[part, bit] = np.log(plus.mean(axis=0)) - np.log(minus.mean(axis=0))
    return LanguageModel(languages, code, weights)


def held_out(id_col: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id's text falls into ``part`` of ``parts``; a null id does not."""
    left = F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(parts))
    return F.coalesce(left == part, F.lit(False))


FIELDS = [
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("ambiguous", T.BooleanType()),
]


def _predict(texts: list[str], model) -> tuple:
    return model.value.predict(texts)


def identify(docs: DataFrame, model: LanguageModel, keep: Sequence[str] = ("doc_id",), text_col: str | Column = "text") -> DataFrame:
    """The columns ``keep`` of every row, with lang_pred, score and ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return with_text_columns(docs, keep, text_col, partial(_predict, model=shared), FIELDS)

"""Token ids of whole texts by a public tokenizer, with a bounded cache of pre-tokens per worker."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import suppress

import numpy as np

from ionloom.llm.memory import worker_cache

BATCH_CHARS = 1_000_000     # texts are encoded in blocks of about this size
CACHE_ENTRIES = 400_000     # pre-tokens in each half of a worker's cache
JOINED = 2_000              # new pre-tokens encoded in one call

# Letters, numbers and white space below U+0250. Texts with other characters go to the
# library whole, because Unicode versions differ in what they call a letter.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBER = "0-9²³¹¼-¾"
SPACE = r"\t-\r \x85\xa0"
PRE_TOKEN = re.compile(
    f"'(?:[stmd]|re|ve|ll)| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+"
    f"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
WHITE = frozenset("\t\n\v\f\r \x85\xa0")
UNUSUAL = re.compile("[^\x00-ɏ‐-‧]")


def blocks(texts: Sequence[str], chars: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``chars`` characters each; a longer text stands alone."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > chars:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


class TextEncoder:
    """What the tokenizers library gives for a text, without added special tokens.

    A byte-level vocabulary encodes each pre-token by itself. Those of a text are
    looked up in a cache, and the library encodes the ones that are new. The cached
    value comes from ``values(ids, starts, ends)``: the ids as bytes, or only their
    number. Texts that hold a special string or unusual characters, and other kinds of tokenizer, go
    to the library whole.
    """

    def __init__(
        self,
        path: str,
        values: Callable[[np.ndarray, np.ndarray, np.ndarray], list],
        known: dict[str, object] | None = None,
        entries: int = CACHE_ENTRIES,
    ):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with suppress(AttributeError):  # its own cache does not help with words that are new
            self.library.model._resize_cache(0)
        self.values, self.entries = values, entries
        self.cache: dict[str, object] = {}
        self.older: dict[str, object] = known or {}
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec.get("pre_tokenizer") or {}
        self.by_pre_token = (
            spec.get("normalizer") is None
            and spec["model"]["type"] == "BPE"
            and not spec["model"].get("dropout")
            and split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split.get("add_prefix_space")
        )
        special = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(special)) if special else None
        if self.by_pre_token:
            line_end = self._whole(["\n"])[0]
            self.line_end, self.by_pre_token = line_end[0], len(line_end) == 1

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        encoded = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.uint32) for e in encoded]

    def pre_tokens(self, text: str) -> list[str] | None:
        """The pre-tokens of a text, or None if only the library can tell."""
        if not self.by_pre_token or UNUSUAL.search(text):
            return None
        if self.special is not None and self.special.search(text):
            return None
        return PRE_TOKEN.findall(text)

    def _learn(self, words: set[str]) -> None:
        """Bring the values of ``words`` into the cache.

        When the cache is full its older half goes, but for what is in use now.
        """
        new = words.difference(self.cache)
        if len(self.cache) + len(new) > self.entries:
            self.cache, self.older = {}, self.cache
            new = words
        if self.older:
            kept = self.older.keys() & new
            self.cache.update(zip(kept, map(self.older.__getitem__, kept), strict=True))
            new = new.difference(kept)
        spaces = [w for w in new if w[-1] in WHITE]
        plain = list(new.difference(spaces))
        # pre-tokens that are set apart by line ends are encoded as if they stood alone
        for i in range(0, len(plain), JOINED):
            part = plain[i : i + JOINED]
            ids = self._whole(["\n".join(part)])[0]
            ends = np.append(np.flatnonzero(ids == self.line_end), len(ids))
            if len(ends) != len(part):
                raise AssertionError("a pre-token holds a line end")
            starts = np.append(0, ends[:-1] + 1)
            self.cache.update(zip(part, self.values(ids, starts, ends), strict=True))
        for word, ids in zip(spaces, self._whole(spaces), strict=True):
            self.cache[word] = self.values(ids, np.array([0]), np.array([len(ids)]))[0]

    def encode(self, texts: Sequence[str], combine: Callable[[Iterable], object]) -> list:
        """``combine`` of the cached values of each text's pre-tokens, in text order."""
        out: list = [None] * len(texts)
        for start, stop in blocks(texts):
            split = [self.pre_tokens(t) for t in texts[start:stop]]
            seen = set().union(*[s for s in split if s is not None])
            if seen:
                self._learn(seen)
            value = self.cache.__getitem__
            for i, pieces in enumerate(split, start):
                if pieces is not None:
                    out[i] = combine(map(value, pieces))
            whole = [i for i, pieces in enumerate(split, start) if pieces is None]
            if whole:
                for i, ids in zip(whole, self._whole([texts[i] for i in whole]), strict=True):
                    out[i] = combine(self.values(ids, np.array([0]), np.array([len(ids)])))
        return out


def id_bytes(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Ids of each range as little-endian unsigned 32-bit integers."""
    raw = ids.astype("<u4").tobytes()
    return [raw[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True)]


def id_counts(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[int]:
    return (ends - starts).tolist()


def byte_encoder(path: str) -> TextEncoder:
    """One encoder per worker process, kept from task to task."""
    return worker_cache(("ids", path), lambda: TextEncoder(path, id_bytes))


def encode_texts(path: str, texts: Sequence[str | None]) -> list[bytes]:
    """Ids of each text as bytes (null: none); see ``id_bytes``."""
    return byte_encoder(path).encode([t or "" for t in texts], b"".join)

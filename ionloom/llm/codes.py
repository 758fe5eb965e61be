"""Texts as arrays of code points, for features that numpy counts over many texts at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

SPACE = 32
_LETTERS: list[np.ndarray] = []


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and where each text starts (one more start at the end)."""
    codes = np.frombuffer(b"".join(t.encode("utf-32-le", "surrogatepass") for t in texts), dtype="<u4")
    return codes, np.cumsum([0, *map(len, texts)])


def is_letter(codes: np.ndarray) -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(1 << 16)]))
    table = _LETTERS[0]
    found = table[np.minimum(codes, 0xFFFF)]
    high = codes > 0xFFFF
    if high.any():
        values, where = np.unique(codes[high], return_inverse=True)
        found[high] = np.array([chr(v).isalpha() for v in values])[where]
    return found


def padded_letters(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters, everything else a space, one space before and after each text.

    Returns the codes (two more spaces at the end), each text's start, and whether it has a letter.
    """
    codes, starts = code_points([f" {t.lower()} " for t in texts])
    letter = is_letter(codes)
    codes = np.append(np.where(letter, codes, SPACE), [SPACE, SPACE]).astype(np.uint32)
    has = np.add.reduceat(letter, starts[:-1]) > 0 if len(texts) else np.zeros(0, bool)
    return codes, starts[:-1], has


def hashed(codes: Sequence[np.ndarray], bits: int, seed: int) -> np.ndarray:
    """A bucket for each position from several codes, by multiplying and taking the top bits."""
    odd = [np.uint32(m | 1) for m in np.random.default_rng(seed).integers(1 << 32, size=len(codes), dtype=np.uint64)]
    mixed = np.zeros(len(codes[0]), np.uint32)
    for code, factor in zip(codes, odd, strict=True):
        mixed = (mixed ^ code) * factor
        mixed ^= mixed >> np.uint32(15)
    return mixed * np.uint32(2654435761) >> np.uint32(32 - bits)

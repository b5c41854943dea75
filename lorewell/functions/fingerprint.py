"""Shingles and winnowed hashes of normalised text, vectorised.

Hashes are FNV-1a with 64 bits over the UTF-8 bytes of character n-grams. They are stored as
signed integers with the top bit flipped, so signed order is unsigned order.
"""

from __future__ import annotations

import numpy as np

# FNV-1a's start and prime, the length of winnowed grams, and the window.
START, PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)
WINNOWED, WINDOW = 5, 8
_FLIP = np.uint64(1 << 63)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` characters, in order."""
    count = len(codes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    c = codes.astype(np.uint64)
    low = lambda shift: (c >> np.uint64(shift)) & np.uint64(0x3F) | np.uint64(0x80)
    width = 1 + (c >= 0x80).astype(int) + (c >= 0x800) + (c >= 0x10000)
    tails = (c, low(0)), (c >> np.uint64(6) | np.uint64(0xC0), low(6)), (c >> np.uint64(12) | np.uint64(0xE0), low(12)), (c >> np.uint64(18) | np.uint64(0xF0), None)
    # Byte k of a character of w bytes: its lead, or six bits of what follows.
    columns = []
    for k in range(int(width.max())):
        column = np.zeros(len(c), np.uint64)
        for w in range(k + 1, 5):
            here = width == w
            column[here] = (tails[w - 1][0] if k == 0 else tails[w - 1 - k][1])[here]
        columns.append((column, width > k))
    hashes = np.full(count, START)
    for at in range(n):
        for k, (column, present) in enumerate(columns):
            mixed = (hashes ^ column[at : at + count]) * PRIME
            hashes = mixed if k == 0 else np.where(present[at : at + count], mixed, hashes)
    return hashes


def gram_size(text: str) -> int:
    """3 if over a third of the characters are kana, Han or Hangul, else 5."""
    c = _codes(text)
    wide = ((c >= 0x3040) & (c <= 0x30FF)) | ((c >= 0x3400) & (c <= 0x9FFF)) | ((c >= 0xAC00) & (c <= 0xD7AF))
    return 3 if int(wide.sum()) * 3 > len(c) else 5


def _signed(hashes: np.ndarray) -> np.ndarray:
    return np.sort((np.unique(hashes) ^ _FLIP).view(np.int64))


def fingerprint(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes, and the sorted distinct least hashes of each window."""
    codes = _codes(text)
    grams = gram_hashes(codes, WINNOWED)
    shingles = grams if gram_size(text) == WINNOWED else gram_hashes(codes, gram_size(text))
    least = grams
    if len(grams) >= WINDOW:
        for step in (1, 2, 4):
            least = np.minimum(least[:-step], least[step:])
    else:
        least = grams[:0] if not len(grams) else grams.min(keepdims=True)
    return _signed(shingles), _signed(least)

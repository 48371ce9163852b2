"""Words and word shingles of texts."""

from __future__ import annotations

import re

import numpy as np
import xxhash

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_WORD_CACHE = 400_000  # word hashes remembered per Python worker: bounds memory only


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII digits, letters (A-Z in lower case) and all characters beyond ASCII."""
    return _WORD.findall((text or "").encode().lower())


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word, seed=11)
        if len(self) >= _WORD_CACHE:
            self.clear()
        self[word] = found
        return found


_hashes = _Hashes()


def mixed(values: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values, one to one."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes, in ascending order, of every ``size`` consecutive words.

    A text of fewer words, but not none, has one shingle of all its words.
    """
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    span = min(size, len(ids))
    total = np.full(len(ids) - span + 1, span, np.uint64)
    for at in range(span):
        total = mixed(total + ids[at:at + len(total)])
    return np.unique(total)

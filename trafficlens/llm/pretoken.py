"""Splitting texts as the public byte-level BPE pattern does, for a whole slice of texts at a time.

``public_tokenizers.PATTERN`` names contractions, runs of letters, digits or other
characters with one space before them, and white space. Which of the four kinds a
character is decides nearly all of it, so the marks of all texts of a slice are found
with array operations; equal pieces share a hash, and only distinct pieces become strings.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from trafficlens.llm.common import prefix_hashes, span_hashes, splitmix

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Fixed values of the pattern: what may follow an apostrophe at the start of a piece.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of each code point."""
    import regex

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    numbers = np.array(points)
    kinds = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for found in regex.finditer(pattern, text):
            kinds[numbers[found.start() : found.end()]] = kind
    return kinds


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    return splitmix(np.arange(0x110000, dtype=np.uint64))


def pieces(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one string, starts and ends of its pieces, their hashes, and the pieces of each text (n + 1 bounds)."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    n = len(points)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    if not n:
        none = np.zeros(0, np.int64)
        return joined, none, none, np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    kinds = _kinds()[points]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    mark = first.copy()
    mark[1:n] |= kinds[1:] != kinds[:-1]
    # the last white space before anything else starts a piece; a space takes what follows along
    last = np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & ~first[1:n])
    mark[last] = True
    mark[last[points[last] == 0x20] + 1] = False
    quotes = np.flatnonzero((points == 0x27) & mark[:n])
    for letters in CONTRACTIONS if len(quotes) else ():
        at = quotes[quotes + len(letters) < n]
        for k, letter in enumerate(letters, 1):
            at = at[(points[at + k] == ord(letter)) & ~first[at + k]]
        for k in range(1, len(letters) + 1):
            mark[at + k] = False
        mark[at + len(letters) + 1] = True
    starts = np.flatnonzero(mark[:n])
    ends = np.append(starts[1:], n)
    hashes = span_hashes(prefix_hashes(_symbols()[points]), starts, ends)
    return joined, starts, ends, hashes, np.searchsorted(starts, bounds)

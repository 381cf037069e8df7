"""Suffix arrays by induced sorting, of many texts in step.

Each step of the classical algorithm is done for all texts of a batch at once: suffixes are classified, leftmost smaller (LMS) suffixes are dropped into their
buckets and induce the order of the LMS substrings, these are named, the texts of names are sorted
recursively where names repeat, and the sorted LMS suffixes induce the order of all others in
two linear scans.
"""

from __future__ import annotations

import numpy as np


def suffix_arrays(text: np.ndarray, sizes: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix arrays of texts that stand one after another in ``text``, largest first, each array in the place of its text.

    Symbols are below ``symbols``; each text ends with 0, which stands nowhere else in it. Texts that have
    ended drop out of the steps, so a batch takes as many steps as its largest text is long.
    """
    width, total = len(sizes), len(text)
    base = np.cumsum(sizes) - sizes
    owner_of = np.repeat(np.arange(width), sizes)
    # texts that reach to each step, and buckets of each text
    reaching = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), side="right")
    row = np.arange(width) * symbols
    # S-type: smaller than the next suffix; of equal neighbours, what the run's end is
    last = base + sizes - 1
    differs = np.ones(total, bool)
    differs[:-1] = text[:-1] != text[1:]
    differs[last] = True
    end_of_run = np.minimum.accumulate(np.where(differs, np.arange(total), total)[::-1])[::-1]
    following = np.append(text, 0)[end_of_run + 1]
    small = text < following
    small[last] = True
    lms = np.zeros(total, bool)
    lms[1:] = small[1:] & ~small[:-1]
    lms[base] = False
    lms[last] = True
    key = row[owner_of] + text
    counts = np.bincount(key, minlength=width * symbols)
    ends = np.cumsum(counts.reshape(width, symbols), axis=1).ravel() + np.repeat(base, symbols)
    starts = ends - counts

    def induced(at: np.ndarray) -> np.ndarray:
        """The suffix arrays induced by the LMS suffixes at the given places of ``text``, which are in order within each text."""
        array = np.full(total, -1, np.int64)  # places in text; -1 is empty
        bucket = key[at]
        order = np.argsort(bucket, kind="stable")
        ordered = bucket[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        number = np.repeat(np.diff(np.append(first, len(order))), np.diff(np.append(first, len(order))))
        array[ends[ordered] - number + np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))] = at[order]
        # what stands before each place, if it is of the type that the scan induces
        before = np.arange(-1, total - 1)
        large_before, small_before = np.append(~small[:-1], False), np.append(small[:-1], False)
        large_before, small_before = np.roll(large_before, 1), np.roll(small_before, 1)
        large_before[base] = small_before[base] = False
        large = np.append(np.where(large_before, before, -1), -1)  # an empty entry reads the -1 at the end
        smaller = np.append(np.where(small_before, before, -1), -1)
        head = starts.copy()
        for i in range(len(reaching)):
            place = large[array[base[: reaching[i]] + i]]
            place = place[place >= 0]
            if len(place):
                c = key[place]
                slot = head[c]
                head[c] = slot + 1
                array[slot] = place
        tail = ends - 1
        for i in range(len(reaching) - 1, -1, -1):
            place = smaller[array[base[: reaching[i]] + i]]
            place = place[place >= 0]
            if len(place):
                c = key[place]
                slot = tail[c]
                tail[c] = slot - 1
                array[slot] = place
        return array

    at = np.flatnonzero(lms)
    rough = induced(at)
    ordered = rough[lms[rough]]  # LMS suffixes in the order of their substrings
    owner = owner_of[ordered]
    # an LMS substring reaches to the next LMS place
    reach = np.zeros(total, np.int64)
    same = owner_of[at[1:]] == owner_of[at[:-1]]
    reach[at[:-1][same]] = np.diff(at)[same]
    length = reach[ordered]
    fresh = np.ones(len(ordered), bool)
    pairs = np.flatnonzero((owner[1:] == owner[:-1]) & (length[1:] == length[:-1]) & (length[1:] > 0))
    a, b, left, offset = ordered[pairs], ordered[pairs + 1], length[pairs + 1], 0
    while len(pairs):
        equal = text[a + offset] == text[b + offset]
        pairs, a, b, left = pairs[equal], a[equal], b[equal], left[equal]
        done = left == offset
        fresh[pairs[done] + 1] = False
        pairs, a, b, left = pairs[~done], a[~done], b[~done], left[~done]
        offset += 1
    number = np.bincount(owner_of[at], minlength=width)  # LMS suffixes of each text
    first = np.cumsum(number) - number
    name = np.cumsum(fresh)
    name = name - name[first][owner]
    names = np.zeros(total, np.int64)
    names[ordered] = name
    distinct = np.zeros(width, np.int64)
    np.maximum.at(distinct, owner, name + 1)
    repeated = np.flatnonzero(distinct < number)
    if len(repeated):
        repeated = repeated[np.argsort(-number[repeated], kind="stable")]
        chosen = np.repeat(first[repeated], number[repeated]) + _counting(number[repeated])
        inner = suffix_arrays(names[at[chosen]], number[repeated], int(distinct[repeated].max()))
        ordered = ordered.copy()
        ordered[chosen] = at[chosen[inner]]
    return induced(ordered)


def _counting(numbers: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the numbers."""
    return np.arange(numbers.sum()) - np.repeat(np.cumsum(numbers) - numbers, numbers)


def common_prefixes(text: np.ndarray, arrays: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes: for each place, what its suffix shares with the one before it in its suffix array, ``most`` at most.

    Symbols are bytes, compared eight at a time. What lies behind a text's end counts like its own; a suffix that is first has 0.
    """
    words = np.concatenate([text, np.zeros(most + 8, np.uint8)]).astype(np.uint64)
    for k in range(1, 8):  # the eight symbols from each place on, the first in the low byte
        words[:-k] |= (words[k:] & np.uint64(0xFF)) << np.uint64(8 * k)
    follows = np.ones(len(arrays), bool)
    follows[np.cumsum(sizes) - sizes] = False
    right = np.flatnonzero(follows)
    left, right = arrays[right - 1], arrays[right]
    todo, out = np.arange(len(right)), np.zeros(len(right), np.int32)
    for offset in range(0, most, 8):
        differ = words[left[todo] + offset] ^ words[right[todo] + offset]
        ended = differ != 0
        last, differ = todo[ended], differ[ended]
        for k in range(1, 8):
            out[last] += (differ & np.uint64((1 << 8 * k) - 1)) == 0
        todo = todo[~ended]
        out[todo] += 8
    shared = np.zeros(len(arrays), np.int32)
    shared[right] = np.minimum(out, most)
    return shared

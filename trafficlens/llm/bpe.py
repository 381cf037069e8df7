"""Byte-level BPE encoding and decoding with padded matrices.

Distinct pieces of a slice are grouped by length. In a group every row is one piece, and in
each round every row merges its leftmost pair of minimum rank: ranks of pairs come from a
hashed table, the merged column is squeezed out, and rows without a pair leave the matrix.
Pieces beyond ``WIDEST`` bytes merge all occurrences of their minimum pair in a round, up to
the first merge that makes a pair of lower rank, which is the same result; memory stays
linear in the text.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trafficlens.llm.common import text_slices
from trafficlens.llm.pretoken import pieces

NONE = np.int32(2**31 - 1)
WIDEST = 1024
#: Distinct pieces that a Python worker keeps between slices.
KEPT_PIECES = 400_000
#: Cells of a matrix.
CELLS = 1_000_000


class Ranks:
    """Token bytes by id, ids of single bytes, and a hashed table of the pairs that merge, lower ids first."""

    def __init__(self, ids: dict[bytes, int], pairs: list[tuple[int, int, int]]) -> None:
        self.tokens = [b""] * (max(ids.values()) + 1)
        for token, rank in ids.items():
            self.tokens[rank] = token
        self.names = [b"%d," % rank for rank in range(len(self.tokens))]
        self.bytes = np.array([ids[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = (np.array(x) for x in zip(*pairs))
        self._table(left.astype(np.uint64), right.astype(np.uint64), merged.astype(np.int32))

    @classmethod
    def from_ranks(cls, path: str) -> "Ranks":
        """Of a rank file: two neighbours merge whenever their bytes together are a token."""
        with open(path, "rb") as lines:
            ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        pairs = [(ids[token[:cut]], ids[token[cut:]], rank) for token, rank in ids.items()
                 for cut in range(1, len(token)) if token[:cut] in ids and token[cut:] in ids]
        return cls(ids, pairs)

    @classmethod
    def from_merges(cls, path: str) -> "Ranks":
        """Of a byte-level BPE tokenizer's JSON: its own list of merges, whose order the ids must follow."""
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        raw = {symbol: value for value, symbol in _byte_symbols().items()}
        ids = {bytes(raw[c] for c in token): k for token, k in model["vocab"].items() if all(c in raw for c in token)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = [(model["vocab"][a], model["vocab"][b], model["vocab"][a + b]) for a, b in merges]
        if any(x[2] >= y[2] for x, y in zip(pairs, pairs[1:])):
            raise ValueError("ids do not follow the order of merges")
        return cls(ids, pairs)

    def _table(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(3 * len(left) + 1))))
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(2**64 - 1))
        self.values = np.full(size, NONE)
        keys = (left << np.uint64(32)) | right
        slots = self._slot(keys)
        while len(keys):
            free = self.keys[slots] == np.uint64(2**64 - 1)
            self.keys[slots[free]] = keys[free]  # of several for one slot, the last stays
            own = self.keys[slots] == keys
            self.values[slots[own]] = merged[own]
            keys, merged, slots = keys[~own], merged[~own], (slots[~own] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair merges to, or NONE; negative ids are padding."""
        out = np.full(left.shape, NONE)
        todo = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        keys = (left.ravel()[todo].astype(np.uint64) << np.uint64(32)) | right.ravel()[todo].astype(np.uint64)
        slots = self._slot(keys)
        flat = out.ravel()
        while len(todo):
            there = self.keys[slots]
            hit = there == keys
            flat[todo[hit]] = self.values[slots[hit]]
            on = ~hit & (there != np.uint64(2**64 - 1))
            todo, keys, slots = todo[on], keys[on], (slots[on] + 1) & (len(self.keys) - 1)
        return flat.reshape(left.shape)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, one after another, and the n + 1 bounds of each word's ids."""
        sizes = np.array([len(w) for w in words], np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # words, numbers of ids, ids
        low, width = 0, 4
        while low < WIDEST:
            chosen = np.flatnonzero((sizes > low) & (sizes <= width))
            step = max(1, CELLS // width)
            for k in range(0, len(chosen), step):
                self._matrix(words, chosen[k : k + step], width, found)
            low, width = width, 2 * width
        for k in np.flatnonzero(sizes > low):
            ids = self._long(words[k])
            found.append((np.array([k]), np.array([len(ids)]), ids))
        bounds = np.zeros(len(words) + 1, np.int64)
        for rows, numbers, _ in found:
            bounds[rows + 1] = numbers
        np.cumsum(bounds, out=bounds)
        flat = np.zeros(bounds[-1], np.int32)
        for rows, numbers, ids in found:
            flat[np.repeat(bounds[rows] - (np.cumsum(numbers) - numbers), numbers) + np.arange(len(ids))] = ids
        return flat, bounds

    def _matrix(self, words: list[bytes], chosen: np.ndarray, width: int, found: list) -> None:
        raw = np.frombuffer(b"".join([words[k].ljust(width, b"\0") for k in chosen.tolist()]), np.uint8).reshape(-1, width)
        length = np.array([len(words[k]) for k in chosen.tolist()])
        ids = np.full((len(chosen), width + 1), -1, np.int32)  # one more column, so that the last real pair has a neighbour
        np.copyto(ids[:, :-1], self.bytes[raw], where=np.arange(width) < length[:, None])
        ranks = self.merged(ids[:, :-1], ids[:, 1:])
        rows = chosen
        while len(rows):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), at]
            done = least == NONE
            if done.any():
                ended = ids[done]
                found.append((rows[done], (ended >= 0).sum(axis=1), ended[ended >= 0]))
                on = ~done
                ids, ranks, rows, at, least = ids[on], ranks[on], rows[on], at[on], least[on]
                if not len(rows):
                    return
            all_rows = np.arange(len(rows))
            ids[all_rows, at] = least
            keep = np.ones(ids.shape, bool)
            keep[all_rows, at + 1] = False
            ids = ids[keep].reshape(len(rows), -1)
            ranks = ranks[keep[:, 1:]].reshape(len(rows), -1)
            wide = ids.shape[1]
            after = np.flatnonzero(at + 1 < wide)
            ranks[after, at[after]] = self.merged(ids[after, at[after]], ids[after, at[after] + 1])
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.merged(ids[before, at[before] - 1], ids[before, at[before]])
            if not ranks.shape[1]:
                found.append((rows, (ids >= 0).sum(axis=1), ids[ids >= 0]))
                return

    def _long(self, word: bytes) -> np.ndarray:
        ids = self.bytes[np.frombuffer(word, np.uint8)]
        ranks = self.merged(ids[:-1], ids[1:])
        while len(ranks) and (least := ranks.min()) != NONE:
            at = np.flatnonzero(ranks == least)
            # in a run of touching pairs (aaaa) every other one is merged, from the left
            run = np.append(True, np.diff(at) != 1)
            at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))) % 2 == 0]
            # pairs that each merge makes: up to the first that ranks lower, all can be merged at once
            token = np.full(len(at), least)
            touching = np.append(False, np.diff(at) == 2)
            before = np.where(touching, least, np.where(at > 0, ids[at - 1], -1))
            after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            lower = np.minimum(self.merged(before, token), self.merged(token, after)) < least
            if lower.any():
                at = at[: lower.argmax() + 1]
            ids[at] = least
            ids = np.delete(ids, at + 1)
            at = at - np.arange(len(at))
            ranks = np.delete(ranks, np.minimum(at + np.arange(len(at)), len(ranks) - 1))
            for k in (at - 1, at):
                k = k[(k >= 0) & (k < len(ids) - 1)]
                ranks[k] = self.merged(ids[k], ids[k + 1])
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids."""
        return b"".join([self.tokens[k] for k in ids.tolist()])


def _byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


@lru_cache(maxsize=2)
def ranks_of(path: str) -> Ranks:
    return Ranks.from_merges(path) if path.endswith(".json") else Ranks.from_ranks(path)


class PieceCache:
    """Slots of the pieces of texts. Distinct pieces are encoded once and kept for later slices."""

    def __init__(self, ranks: Ranks) -> None:
        self.ranks = ranks
        self.clear()

    def clear(self) -> None:
        self.slots: dict[int, int] = {}

    def learn(self, ids: np.ndarray, cuts: np.ndarray) -> None:
        """Take in the ids of new pieces, whose slots follow those before."""
        raise NotImplementedError

    def look_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each piece, and the n + 1 bounds of each text's pieces."""
        joined, starts, ends, hashes, bounds = pieces(texts)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.slots) > KEPT_PIECES:
            self.clear()
        keys = distinct.tolist()
        fresh = [k for k, key in enumerate(keys) if key not in self.slots]
        words = [joined[a:b].encode() for a, b in zip(starts[first[fresh]].tolist(), ends[first[fresh]].tolist())]
        size = len(self.slots)
        self.slots.update(zip([keys[k] for k in fresh], range(size, size + len(fresh))))
        self.learn(*self.ranks.encode(words))
        return np.array([self.slots[key] for key in keys], np.int64)[inverse], bounds


class Digests(PieceCache):
    """Digests of ids and of decoded bytes."""

    def clear(self) -> None:
        super().clear()
        self.listed: list[bytes] = []
        self.decoded: list[bytes] = []
        self.counts: list[int] = []

    def learn(self, ids: np.ndarray, cuts: np.ndarray) -> None:
        names, tokens = self.ranks.names, self.ranks.tokens
        line, cuts = ids.tolist(), cuts.tolist()
        self.listed += [b"".join([names[x] for x in line[a:b]]) for a, b in zip(cuts, cuts[1:])]
        self.decoded += [b"".join([tokens[x] for x in line[a:b]]) for a, b in zip(cuts, cuts[1:])]
        self.counts += [b - a for a, b in zip(cuts, cuts[1:])]

    def of(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: number of ids, digest of the ids joined by commas, digest of the decoded bytes."""
        slots, bounds = self.look_up(texts)
        numbers = np.append(0, np.cumsum(np.array(self.counts, np.int64)[slots])) if len(slots) else np.zeros(1, np.int64)
        line, bounds = slots.tolist(), bounds.tolist()
        for a, b in zip(bounds, bounds[1:]):
            listed = b"".join([self.listed[k] for k in line[a:b]])[:-1]
            decoded = b"".join([self.decoded[k] for k in line[a:b]])
            yield int(numbers[b] - numbers[a]), hashlib.sha256(listed).hexdigest(), hashlib.sha256(decoded).hexdigest()


class Ids(PieceCache):
    """Ids themselves."""

    def clear(self) -> None:
        super().clear()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.bounds = np.zeros(1, np.int64)

    def learn(self, ids: np.ndarray, cuts: np.ndarray) -> None:
        end = int(self.bounds[-1])
        if end + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[:end], np.zeros(end + 2 * len(ids), np.uint32)])
        self.flat[end : end + len(ids)] = ids
        self.bounds = np.concatenate([self.bounds, end + cuts[1:]])

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and the n + 1 bounds of each text's ids."""
        slots, bounds = self.look_up(texts)
        if not len(slots):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        numbers = self.bounds[slots + 1] - self.bounds[slots]
        ends = np.append(0, np.cumsum(numbers))
        ids = self.flat[np.repeat(self.bounds[slots] - ends[:-1], numbers) + np.arange(ends[-1])]
        return ids, ends[bounds]


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no ids and the digests of nothing. Rows are independent, so
    repeated rows give repeated results and further columns are not read. There is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = Digests(ranks_of(path))
        for part, texts in text_slices(batches):
            rows = list(digests.of(texts))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

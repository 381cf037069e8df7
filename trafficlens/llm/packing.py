"""Hierarchical packing of token sequences into windows of several context sizes.

Documents are routed by length: full windows of the largest size are cut off first, and what
remains belongs to the smallest tier that holds it. Tiers are packed from the longest to the
shortest. A window starts with the longest document of its tier; its gap is filled from the
shorter tiers, always with the longest that fits, and when none fits, with the head of the
shortest document, whose rest stays in the tier of its new length. So all windows of a block but
the last one are full, whatever the lengths are. Windows are dealt to step groups, longest
first and back and forth, so that the groups of a block hold about equally many tokens.

Packing works on blocks of documents inside the partitions of the scan: no text and no token
is shuffled, memory is bounded by ``BLOCK_TOKENS`` and the longest document, and padding by one
window for each block. Sequence ids hold the partition's number, which is the same when a lost
executor's task runs again.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from trafficlens.llm.bpe import Ids, ranks_of
from trafficlens.llm.common import text_slices

#: Sizes of the windows, ascending.
TIERS = (128, 256, 512, 1024)
#: The id after each document.
END = 0
#: Tokens that are packed together; documents are whole within a block.
BLOCK_TOKENS = 4_000_000
#: Windows of a step group.
STEP_WINDOWS = 64
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "tier int, sequence_tokens int, step_group long")

Piece = tuple[int, int, int]  # document of the block, start in it, length


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[Piece]]]:
    """Windows of documents of the given lengths: (size of the tier, pieces in order)."""
    largest = tiers[-1]
    windows: list[tuple[int, list[Piece]]] = []
    rest: list[tuple[int, int, int]] = []  # length, document, start
    for doc, length in enumerate(lengths):
        full = length // largest * largest
        windows += [(largest, [(doc, start, largest)]) for start in range(0, full, largest)]
        if length > full:
            rest.append((length - full, doc, full))
    rest.sort()
    for tier, shorter in zip(tiers[::-1], (*tiers[-2::-1], 0)):
        while rest and rest[-1][0] > shorter:
            length, doc, start = rest.pop()
            window, gap = [(doc, start, length)], tier - length
            while gap and rest:
                fits = bisect_left(rest, (gap + 1,)) - 1
                length, doc, start = rest.pop(max(fits, 0))
                taken = min(length, gap)
                window.append((doc, start, taken))
                gap -= taken
                if length > taken:
                    insort(rest, (length - taken, doc, start + taken))
            windows.append((tier, window))
    return windows


def step_groups(sizes: list[int], windows: int = STEP_WINDOWS) -> list[int]:
    """The step group of each window: longest first, dealt back and forth over the groups."""
    groups = max(1, -(-len(sizes) // windows))
    out = [0] * len(sizes)
    for rank, k in enumerate(sorted(range(len(sizes)), key=lambda k: -sizes[k])):
        lap, place = divmod(rank, groups)
        out[k] = groups - 1 - place if lap % 2 else place
    return out


class _Tokenizer:
    """Ids by the tokenizer's file; texts that hold a special token's string go through the library itself."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cache = Ids(ranks_of(path))

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts with END after each, and the n + 1 bounds of each text's ids."""
        whole = {k for k, text in enumerate(texts) if any(s in text for s in self.special)}
        ids, bounds = self.cache.of(["" if k in whole else text for k, text in enumerate(texts)])
        parts = []
        for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            parts += [self.library.encode(texts[k], add_special_tokens=False).ids if k in whole else ids[a:b], [END]]
        sizes = np.array([len(a) + 1 for a in parts[::2]], np.int64)
        return np.concatenate([np.asarray(p, np.uint32) for p in parts] or [np.zeros(0, np.uint32)]), np.append(0, np.cumsum(sizes))


def _packed(ids: list[int], tokens: np.ndarray, bounds: np.ndarray, tiers: tuple[int, ...], first: int, first_group: int) -> tuple[pa.RecordBatch, int, int]:
    """A block's pieces, and the numbers of its sequences and step groups."""
    starts = bounds.tolist()
    windows = pack(np.diff(bounds).tolist(), tiers)
    sizes = [sum(p[2] for p in window) for _, window in windows]
    groups = step_groups(sizes)
    rows: list[tuple] = []
    for k, (tier, window) in enumerate(windows):
        offset = 0
        for doc, start, length in window:
            at = starts[doc] + start
            rows.append((ids[doc], start, length, zlib.crc32(tokens[at : at + length].tobytes()), starts[doc + 1] - starts[doc],
                         first + k, offset, tier, sizes[k], first_group + groups[k]))
            offset += length
    kinds = [pa.int64()] * 7 + [pa.int32()] * 2 + [pa.int64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names), len(windows), max(groups) + 1


def packed_sequences(docs: DataFrame, path: str, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Pack all documents into sequences: one row for each piece.

    ``docs`` has doc_id and text; other columns are not read. A null or empty text is one
    END id. Rows are taken as documents one by one, so repeated rows and ids are packed
    as often as they stand there, and a null doc_id stays null. No rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _Tokenizer(path)
        sequence = group = TaskContext.get().partitionId() << 40
        ids: list[int] = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0
        for part, texts in text_slices(batches):
            tokens, bounds = tokenizer.of(texts)
            ids += part.column(0).to_pylist()
            parts.append(tokens), sizes.append(np.diff(bounds))
            held += len(tokens)
            if held >= BLOCK_TOKENS:
                out, n, m = _packed(ids, np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(sizes))), tiers, sequence, group)
                yield out
                sequence, group, held, ids, parts, sizes = sequence + n, group + m, 0, [], [], []
        if ids:
            yield _packed(ids, np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(sizes))), tiers, sequence, group)[0]

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)

"""Importance resampling towards a target distribution of hashed n-grams.

1. Counts. The n-grams of all documents, and those of all target texts, are counted by bucket (crc32 modulo
   ``BUCKETS``); a task sends one row for each bucket that it saw. A bucket's gain is the floored log ratio of its smoothed shares.
2. Weights. A document's weight is the floored mean of its n-grams' gains.
3. Draw. Weight plus Gumbel noise from a hash of the id: the highest scores are a sample without replacement.

In a batch, every occurrence of an n-gram is interned in a numpy table with open addressing: keys are xxhash64 values, a
slot is taken only by equal bytes, and the slots hold bucket and count. An occurrence then is a slot number, and the
gains of a document are gathered through it. Text is never split into Python strings; only distinct n-grams get a crc32.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.llm.common import _offsets, checkpointed

BUCKETS = 10_000
NGRAM = 1
MIN_WORDS = 20
SHARE_PERCENT = 10
SEED = 2024
#: Bytes of text that a table is made for; a longer text comes alone.
SLICE_BYTES = 4 << 20
#: n-grams up to this many bytes are compared eight bytes at a time, longer ones one by one.
LANED = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Digits, lower-case letters and all bytes of other code points are parts of words.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[ord("0") : ord("9") + 1] = _IN_WORD[ord("a") : ord("z") + 1] = _IN_WORD[128:] = True


class Grams(NamedTuple):
    """The n-grams of some texts: canonical bytes (words lower-cased, one space behind each), spans in them, and each one's text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    words: np.ndarray  # of each text


def grams(column: pa.Array, most: int) -> Grams:
    """All runs of 1 to ``most`` consecutive words of each text of a string column."""
    offsets = np.asarray(_offsets(column)).astype(np.int64)
    if column.null_count:  # what stands below a null is not text
        column = column.fill_null("")
        offsets = np.asarray(_offsets(column)).astype(np.int64)
    base = int(offsets[0])
    raw = column.buffers()[2]
    text = _LOWER[np.frombuffer(raw, np.uint8)[base : int(offsets[-1])]] if raw is not None else np.zeros(0, np.uint8)
    offsets -= base
    inside = _IN_WORD[text]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(text)]
    first[begins] = inside[begins]  # words do not cross texts
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    start, end = np.nonzero(first)[0], np.nonzero(last)[0] + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    words = np.bincount(row, minlength=len(column))
    # words and one space each, one behind another
    sizes = end - start + 1
    ends = np.cumsum(sizes)
    data = np.full(int(ends[-1]) if len(ends) else 0, ord(" "), np.uint8)
    letters = np.ones(len(data), bool)
    letters[ends - 1] = False
    data[letters] = text[inside]
    starts = ends - sizes
    parts = [(starts, ends - 1, row)]
    for n in range(2, most + 1):
        whole = np.nonzero(row[n - 1 :] == row[: len(row) - n + 1])[0] if len(row) >= n else np.zeros(0, np.int64)
        parts.append((starts[whole], ends[whole + n - 1] - 1, row[whole]))
    start, end, row = (np.concatenate(x) for x in zip(*parts))
    return Grams(data, start, end, row, words)


class Table:
    """Distinct n-grams of a batch: open addressing with linear probing, all occurrences in step."""

    def __init__(self, found: Grams, buckets: int) -> None:
        data = found.data.tobytes()
        keys = np.fromiter(map(xxhash.xxh64_intdigest, map(data.__getitem__, map(slice, found.start.tolist(), found.end.tolist()))), np.uint64, len(found.start))
        capacity = 1 << max(4, (2 * len(keys)).bit_length())
        owner = np.full(capacity, -1, np.int64)  # of a slot: the occurrence that took it
        slot = (keys & np.uint64(capacity - 1)).astype(np.int64)
        todo = np.arange(len(keys))
        self._found, self._data = found, data
        self._lanes = np.lib.stride_tricks.as_strided(np.frombuffer(data + bytes(8), np.uint64, 1), (len(data) + 1,), (1,), writeable=False) if data else np.zeros(1, np.uint64)
        while len(todo):
            at = slot[todo]
            free = owner[at] < 0
            owner[at[free]] = todo[free]
            held = owner[at]
            same = keys[held] == keys[todo]
            same[same] = self._equal(held[same], todo[same])
            todo = todo[~same]
            slot[todo] = (slot[todo] + 1) & (capacity - 1)
        taken = np.nonzero(owner >= 0)[0]
        place = np.zeros(capacity, np.int64)
        place[taken] = np.arange(len(taken))
        self.slots = place[slot]  # of each occurrence
        self.count = np.bincount(self.slots, minlength=len(taken))
        spans = zip(found.start[owner[taken]].tolist(), found.end[owner[taken]].tolist())
        self.bucket = np.fromiter((zlib.crc32(data[a:b]) % buckets for a, b in spans), np.int64, len(taken))

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the n-grams of two lists of occurrences have the same bytes."""
        found, data = self._found, self._data
        size = found.end[a] - found.start[a]
        same = size == found.end[b] - found.start[b]
        left = np.nonzero(same & (a != b) & (size <= LANED))[0]
        for k in range(0, LANED, 8):
            if not len(left):
                break
            bits = np.minimum(size[left] - k, 8).astype(np.uint64) * np.uint64(8)
            mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - bits)
            differ = (self._lanes[found.start[a[left]] + k] ^ self._lanes[found.start[b[left]] + k]) & mask != 0
            same[left[differ]] = False
            left = left[~differ & (size[left] > k + 8)]
        for k in np.nonzero(same & (a != b) & (size > LANED))[0].tolist():
            x, y = int(found.start[a[k]]), int(found.start[b[k]])
            same[k] = data[x : x + int(size[k])] == data[y : y + int(size[k])]
        return same


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``SLICE_BYTES`` of text."""
    ends = np.cumsum(np.diff(np.asarray(_offsets(batch.column(batch.schema.get_field_index("text"))))))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def bucket_counts(texts: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """How many n-grams of all ``text`` values fall into each bucket: ``buckets`` numbers, whatever the texts are."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in _slices(batch):
                table = Table(grams(part.column(0), ngram), buckets)
                np.add.at(total, table.bucket, table.count)
        seen = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share of the target over that of the source."""
    buckets = len(source)
    s_all, t_all = float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Floored Gumbel noise, times 1000, by a hash of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(docs: DataFrame, gain: np.ndarray, ngram: int = NGRAM, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, n_words, weight, score of every document, given the buckets' gains."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                found = grams(part.column(1), ngram)
                table = Table(found, len(shared.value))
                features = np.bincount(found.row, minlength=part.num_rows)
                total = np.zeros(part.num_rows, np.int64)
                np.add.at(total, found.row, shared.value[table.bucket][table.slots])
                weight = np.where(features > 0, total // np.maximum(features, 1), 0)
                score = weight + np.array([noise(x, seed) for x in part.column(0).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (features, found.words, weight, score))],
                                                 names=["doc_id", "n_features", "n_words", "weight", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(scored, "doc_id long, n_features long, n_words long, weight long, score long")


def resampled(docs: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = SHARE_PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is null for those not drawn.

    ``docs`` has doc_id and text, ``target`` text; other columns are not read. Of the documents with ``min_words`` words or
    more, ``percent`` per cent (rounded down) with the highest scores are drawn; ties go to the smaller doc_id, then to more features.
    A null or empty text has no features and weight 0. Repeated rows are documents of their own with equal scores; a null doc_id is hashed
    as an empty one and comes last among equals. Without documents there are no rows, without target texts all shares of the target are equal.
    """
    gain = gains(bucket_counts(docs, ngram, buckets), bucket_counts(target, ngram, buckets))
    rows = checkpointed(weighted(docs, gain, ngram, seed))
    eligible = rows.where(F.col("n_words") >= min_words)
    # scores are whole thousandths of a bounded logarithm, so this table has a few ten thousand rows at any size
    levels = eligible.groupBy(F.col("score").alias("level")).agg(F.count("*").alias("n"))
    window = Window.partitionBy(F.lit(0)).orderBy(F.desc("level"))
    everything = Window.partitionBy(F.lit(0))
    wanted = F.floor(F.sum("n").over(everything) * percent / 100)
    levels = levels.withColumn("before", F.sum("n").over(window) - F.col("n")).withColumn("wanted", wanted).where("before < wanted").select("level", "before", "wanted")
    joined = rows.join(levels, (F.col("score") == F.col("level")) & (F.col("n_words") >= min_words), "left")
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = joined.where("level IS NULL").select(*columns, F.lit(None).cast("long").alias("rank"))
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), F.desc("n_features"))
    high = joined.where("level IS NOT NULL").withColumn("place", F.col("before") + F.row_number().over(order))
    drawn = high.select(*columns, F.when(F.col("place") <= F.col("wanted"), F.col("place")).cast("long").alias("rank"))
    return rest.unionByName(drawn)


#: The same in SQL. DuckDB has no crc32; it is folded over the bytes of each distinct word with a table made by rule.
ORACLE = r"""
WITH RECURSIVE steps AS (SELECT i AS n, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS tab FROM steps WHERE k = 8),
doc_words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
goal_words AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
doc_counts AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(words) AS w FROM doc_words) GROUP BY ALL),
known AS (SELECT DISTINCT w FROM doc_counts UNION SELECT DISTINCT w FROM goal_words),
hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(w) + 1), lambda i: ('0x' || substr(hex(encode(w)), 2 * i - 1, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket FROM known, crc),
s AS (SELECT bucket, sum(n) AS n FROM doc_counts JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM goal_words JOIN hashed USING (w) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS ss, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS tt),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (ss + 10000) / ((s.n + 1)::DOUBLE * (tt + 10000))))::BIGINT AS g FROM s LEFT JOIN t USING (bucket), sums),
weights AS (SELECT doc_id, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS weight FROM doc_counts JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM doc_words LEFT JOIN weights USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS total FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= floor(10 * total / 100) THEN place END::BIGINT AS rank FROM scored LEFT JOIN placed USING (doc_id)"""

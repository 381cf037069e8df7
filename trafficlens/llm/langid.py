"""Language identification by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters becomes one space, and the one to three neighbouring characters
at each place are hashed to ``BUCKETS``. Training counts them by language in each
partition and sums the counts; the matrix of log probabilities has a fixed number of
buckets for each language, and is broadcast. Scoring touches only the buckets of a batch's own n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.common import text_slices
from trafficlens.llm.pretoken import LETTER, _kinds

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
ORDERS = (1, 2, 3)
#: Added to each count.
SMOOTHING = 0.5
UNKNOWN = "und"
FOLDS = 5
#: Odd multipliers of the hash, by the place of a character in its n-gram.
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, text by text; the n + 1 bounds of each text's; whether each has a letter."""
    padded = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32)
    starts = np.append(0, np.cumsum([len(t) for t in padded]))
    letter = _kinds()[points] == LETTER
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[starts[:-1]] = True
    before = np.append(0, np.cumsum(keep))[starts]  # kept characters before each text
    has_letter = np.diff(np.append(0, np.cumsum(letter))[starts]) > 0
    characters = np.where(letter, points, np.uint32(0x20))[keep].astype(np.uint64)
    n = len(characters)
    # all orders of a place stand together; a place has an order only inside its own text
    left = np.repeat(before[1:], np.diff(before)) - np.arange(n)
    out = np.empty((n, len(ORDERS)), np.int32)
    there = np.empty((n, len(ORDERS)), bool)
    mixed = np.zeros(n, np.uint64)
    for k, order in enumerate(ORDERS):
        mixed[: n - order + 1] += characters[order - 1 :] * np.uint64(_FACTORS[order - 1])
        value = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(_FACTORS[3])
        out[:, k] = (value >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
        there[:, k] = left >= order
    there[:, 0] &= characters != 0x20
    return out[there], np.append(0, np.cumsum(there.sum(axis=1)))[before], has_letter


def held_out(doc_id: Column) -> Column:
    """Rows of the fold that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


class Model:
    """Log probabilities of the buckets by language, and of the languages."""

    def __init__(self, languages: list[str], counts: np.ndarray, documents: np.ndarray) -> None:
        self.languages = languages
        rows = counts + SMOOTHING
        self.table = np.ascontiguousarray(np.log(rows / rows.sum(axis=1, keepdims=True)).T.astype(np.float32)) if languages else np.zeros((BUCKETS, 0), np.float32)
        self.prior = np.log(documents / max(documents.sum(), 1)) if languages else np.zeros(0)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The most probable language of each text, the earlier name in a tie, and its posterior probability."""
        buckets, bounds, has_letter = grams(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        sums = np.zeros((len(buckets) + 1, len(self.languages)))
        np.cumsum(self.table[buckets], axis=0, dtype=np.float64, out=sums[1:])
        scores = sums[bounds[1:]] - sums[bounds[:-1]] + self.prior
        best = scores.argmax(axis=1)
        posterior = 1 / np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1)
        names = [self.languages[k] if known else UNKNOWN for k, known in zip(best.tolist(), has_letter.tolist())]
        return names, np.where(has_letter, posterior, 0.0)


def train(labelled: DataFrame) -> Model:
    """A model of all rows of ``labelled`` with a text and a lang.

    Each task holds one row of counts for each language; what reaches the driver is one
    number for each language and bucket, however many documents there are.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        counts = np.zeros((0, BUCKETS), np.int64)
        documents: list[int] = []
        for part, texts in text_slices(batches):
            langs = part.column(1).to_pylist()
            for lang in langs:
                if names.setdefault(lang, len(names)) == len(documents):
                    documents.append(0)
                documents[names[lang]] += 1
            if len(counts) < len(names):
                counts = np.concatenate([counts, np.zeros((len(names) - len(counts), BUCKETS), np.int64)])
            buckets, bounds, _ = grams(texts)
            owner = np.repeat(np.array([names[x] for x in langs], np.int64), np.diff(bounds))
            counts += np.bincount(owner * BUCKETS + buckets, minlength=counts.size).reshape(counts.shape)
        for lang, k in names.items():
            at = np.flatnonzero(counts[k])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.append(-1, at), pa.int32()), pa.array(np.append(documents[k], counts[k][at]), pa.int64())],
                names=["lang", "bucket", "n"])

    rows = labelled.where("text is not null and lang is not null").select("text", "lang").mapInArrow(count, "lang string, bucket int, n long")
    table = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs, buckets, numbers = table.column("lang").to_pylist(), table.column("bucket").to_numpy(), table.column("n").to_numpy()
    languages = sorted(set(langs))
    row = np.array([languages.index(x) for x in langs], np.int64)
    counts, documents = np.zeros((len(languages), BUCKETS)), np.zeros(len(languages))
    prior = buckets < 0
    documents[row[prior]] = numbers[prior]
    counts[row[~prior], buckets[~prior]] = numbers[~prior]
    return Model(languages, counts, documents)


def predicted(docs: DataFrame, model: Model, added: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` (text and any other columns, which stay) with the language and its score in the columns ``added``, which are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*added)
    names = [*docs.columns, *added]
    schema = docs.select("*", F.lit("").alias(added[0]), F.lit(0.0).alias(added[1])).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            langs, scores = shared.value.predict(texts)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=names)

    return docs.mapInArrow(run, schema)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from the rows outside the held-out fold.

    ``und`` with score 0 where the text is null or has no letter, or where nothing could be
    learned. lang, source and doc_id take no part in a prediction; repeated rows are predicted
    alike, other columns are not read, and no rows give no rows.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predicted(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

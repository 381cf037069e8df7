"""Near-duplicate documents by a chosen-path similarity join over minwise tokens.

A document is the set of its word shingles. Documents with equal sets are one class, and only the
classes' representatives are joined. A tree puts a document into a node by the minwise token of
the tree's own coordinate; a node that is too large is branched by ``BRANCHES`` further
coordinates that its id selects, down to ``DEPTH``. Nodes of one document end. In a small node all
documents are compared by their signatures. ``trees`` repeats that independently, so that a pair at the
threshold is missed with a chance below ``1 - recall``.

Comparing takes two rounds. The first takes a spanning forest of the most similar pairs of each
node as candidates: one for each document, not each pair. What the full sets confirm is joined to
components. The second round takes the documents that may be linked with one of another component, and
compares the full sets of those in a node at once; again it puts out one link for each document. So
copies of one text by the thousands need a link each. Nodes that are large at the last depth are compared in blocks: in the first
round each block with the node's first documents, in the second the documents outside the node's commonest
component with all blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.llm.common import checkpointed, compacted, prefix_hashes, span_hashes, splitmix, text_slices
from trafficlens.llm.components import components

#: Coordinates of a signature, a byte each.
COORDINATES = 256
#: Documents of a node that are compared at once.
NODE = 2048
BRANCHES = 2
DEPTH = 3
RECALL = 0.999_99
#: Estimated similarity that a pair at the threshold falls short of four times in 100,000.
SLACK = 4.0
#: Documents that all blocks of a large node are compared with in the first round.
PIVOTS = 16
#: Shingles that are counted at once when full sets of a node are compared.
COLUMNS = 2048
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_BYTE = splitmix(_LOWER + np.uint64(1 << 32))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_SEEDS = splitmix(np.arange(2 * COORDINATES, dtype=np.uint64) + np.uint64(77))
_FACTORS = (_SEEDS[:COORDINATES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_OFFSETS = (_SEEDS[COORDINATES:] >> np.uint64(32)).astype(np.uint32)


def shingles(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the word shingles of all texts, ascending in each, and the n + 1 bounds of each text's.

    A-Z are taken as lower case. A text of fewer words than a shingle is one shingle, one without words has none.
    """
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    limits = np.append(0, np.cumsum([len(r) + 1 for r in raw]))
    word = ~_BLANK[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]])))
    starts, ends = edges[::2], edges[1::2]
    hashes = span_hashes(prefix_hashes(_BYTE[data]), starts, ends)
    first = np.searchsorted(starts, limits)  # the first word of each text
    numbers = np.diff(first)
    whole = np.maximum(numbers - words + 1, np.minimum(numbers, 1))  # shingles of each text
    owner = np.repeat(np.arange(len(texts)), whole)
    begin = np.arange(len(owner)) - np.repeat(np.cumsum(whole) - whole, whole) + np.repeat(first[:-1], whole)
    value = np.full(len(begin), np.uint64(words))
    for k in range(words):
        there = begin + k < first[owner + 1]
        value[there] = splitmix(value[there] * np.uint64(0x9FB21C651E98DF25) + hashes[begin[there] + k])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])) if len(value) else np.zeros(0, bool)
    return value[fresh], np.searchsorted(owner[fresh], np.arange(len(texts) + 1))


def signatures(values: np.ndarray, bounds: np.ndarray, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """The signature bytes of each set, and its node in each tree; sets may not be empty."""
    short = (values >> np.uint64(32)).astype(np.uint32)
    least = np.empty((len(bounds) - 1, COORDINATES), np.uint32)
    for k in range(COORDINATES if len(least) else 0):
        least[:, k] = np.minimum.reduceat(short * _FACTORS[k] + _OFFSETS[k], bounds[:-1])
    roots = splitmix((least[:, :trees].astype(np.uint64) << np.uint64(16)) + np.arange(trees, dtype=np.uint64))
    return (splitmix(least.astype(np.uint64)) & np.uint64(0xFF)).astype(np.uint8), roots


def trees_for(threshold: float, recall: float = RECALL) -> int:
    """Independent trees that find a pair at the threshold with probability ``recall``, its nodes being branched to the last depth."""
    found = threshold * (1 - (1 - threshold) ** BRANCHES) ** DEPTH
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - found)))


def _sets(docs: DataFrame, words: int, trees: int) -> DataFrame:
    """doc_id, n_shingles, two hashes of the whole set, its signature and root nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            values, bounds = shingles(texts, words)
            sizes = np.diff(bounds)
            some = np.flatnonzero(sizes)
            bytes_, roots = signatures(values, np.append(bounds[:-1][some], bounds[-1]), trees)
            whole = [np.append(np.uint64(0), np.cumsum(splitmix(values ^ np.uint64(c)))) for c in (1, 2)]
            hashes = [(w[bounds[1:]] - w[bounds[:-1]]).view(np.int64) for w in whole]
            sig: list[bytes | None] = [None] * len(texts)
            root: list[list[int] | None] = [None] * len(texts)
            for k, s, r in zip(some.tolist(), bytes_, roots.view(np.int64).tolist()):
                sig[k], root[k] = s.tobytes(), r
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(hashes[0]), pa.array(hashes[1]), pa.array(sig, pa.binary()), pa.array(root, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "h1", "h2", "sig", "roots"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, sig binary, roots array<long>")


def _nodes(reps: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Node and rep of the documents in nodes of two or more: small nodes, and those that stay large, if any do."""
    level = reps.select(F.explode("roots").alias("node"), "rep")
    small, large = None, level
    for depth in range(DEPTH + 1):
        sizes = level.groupBy("node").agg(F.count("*").alias("size")).where(F.col("size") > 1)
        # a key of its own for the join, so that large nodes can be split
        sizes = sizes.select(F.concat(F.lit("n"), F.col("node").cast("string")).alias("key"), "size")
        sized = compacted(level.withColumn("key", F.concat(F.lit("n"), F.col("node").cast("string"))).join(sizes, "key").select("node", "rep", "size"))
        part = sized.where(F.col("size") <= NODE).select("node", "rep")
        small = part if small is None else small.union(part)
        large = sized.where(F.col("size") > NODE).select("node", "rep")
        if large.isEmpty():
            return small, None
        if depth < DEPTH:
            coordinates = F.array(*(F.pmod(F.xxhash64("node", F.lit(k)), F.lit(COORDINATES)).cast("int") for k in range(BRANCHES)))
            branched = large.join(reps.select("rep", "sig"), "rep").select("node", "rep", "sig", F.explode(coordinates).alias("c"))
            level = branched.select(F.xxhash64("node", "c", F.substring("sig", F.col("c") + 1, F.lit(1))).alias("node"), "rep")
    return small, large


def _similar(sig: np.ndarray, sizes: np.ndarray, k: int, threshold: float) -> np.ndarray:
    """Estimated similarities of document k with all; -1 where the sizes alone rule a link out."""
    estimate = (np.count_nonzero(sig == sig[k], axis=1) / COORDINATES - 1 / 256) / (1 - 1 / 256)
    possible = np.minimum(sizes, sizes[k]) >= threshold * np.maximum(sizes, sizes[k]) - 1e-9
    return np.where(possible, estimate, -1.0)


def _least_estimate(threshold: float) -> float:
    return threshold - SLACK * math.sqrt(threshold * (1 - threshold) / COORDINATES)


def _forest(ids: np.ndarray, sizes: np.ndarray, sig: np.ndarray, labels: np.ndarray, left: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the most similar pairs that may be links, grown document by document."""
    least, n = _least_estimate(threshold), len(ids)
    best, by, out = np.full(n, -2.0), np.full(n, -1), []
    waiting = np.ones(n, bool)
    for _ in range(n):
        k = int(np.where(waiting, best, -3.0).argmax())
        if best[k] >= least:
            out.append((ids[by[k]], ids[k]))
        waiting[k] = False
        similar = _similar(sig, sizes, k, threshold)
        closer = waiting & (similar > best)
        best[closer], by[closer] = similar[closer], k
    return out


def _suspects(ids: np.ndarray, sizes: np.ndarray, sig: np.ndarray, labels: np.ndarray, left: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """The documents that may be linked with one of another component; of such a pair, ``left`` marks one at least."""
    if (labels == labels[0]).all():
        return []
    least, found = _least_estimate(threshold), np.zeros(len(ids), bool)
    for k in np.flatnonzero(left).tolist():
        near = (_similar(sig, sizes, k, threshold) >= least) & (labels != labels[k])
        if near.any():
            found |= near
            found[k] = True
    return [(ids[k], ids[k]) for k in np.flatnonzero(found).tolist()]


def _compared(nodes: DataFrame, keys: list[str], way: Callable, threshold: float) -> DataFrame:
    """What ``way`` finds among the documents with the same keys: the keys and pairs (a <= b). A task holds one node at a time."""
    names = [*keys, "rep", "n_shingles", "sig", "label", "left"]
    schema = ", ".join([*(f"{k} long" for k in keys), "a long", "b long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(rows: list[tuple]) -> list[tuple]:
            ids, sizes, sig, labels, left = zip(*(r[len(keys):] for r in rows))
            found = way(np.array(ids), np.array(sizes), np.frombuffer(b"".join(sig), np.uint8).reshape(len(ids), -1), np.array(labels), np.array(left), threshold)
            return [(*rows[0][: len(keys)], min(x), max(x)) for x in found]

        def batch_of(found: set[tuple]) -> pa.RecordBatch:
            columns = zip(*found) if found else [[]] * (len(keys) + 2)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*keys, "a", "b"])

        node: list[tuple] = []
        out: set[tuple] = set()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if node and node[-1][: len(keys)] != row[: len(keys)]:
                    if len(node) > 1:
                        out.update(pairs(node))
                    node = []
                node.append(row)
            if len(out) > 10_000:
                yield batch_of(out)
                out = set()
        if len(node) > 1:
            out.update(pairs(node))
        yield batch_of(out)

    rows = nodes.select(*names).repartition(*keys).sortWithinPartitions(*keys, "rep")
    return rows.mapInArrow(run, schema)


def _first_round(small: DataFrame, large: DataFrame | None, reps: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs: the spanning forests of all nodes."""
    wide = reps.select("rep", "n_shingles", "sig")
    plain = lambda df: df.withColumn("label", F.col("rep")).withColumn("left", F.lit(True))
    out = _compared(plain(small.join(wide, "rep")), ["node"], _forest, threshold).select("a", "b").where("a <> b")
    if large is None:
        return out.distinct()
    blocks = large.groupBy("node").agg(F.count("*").alias("size"), F.min("rep").alias("least"))
    blocked = large.join(blocks, "node").withColumn("blocks", F.ceil(F.col("size") / (NODE - PIVOTS)))
    own = blocked.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    # the node's first documents in hash order are in every block
    order = Window.partitionBy("node").orderBy(F.xxhash64("rep"), "rep")
    first = large.select("node", "rep").withColumn("place", F.row_number().over(order)).where(F.col("place") <= PIVOTS).select("node", "rep")
    everywhere = blocked.join(first, ["node", "rep"], "left_semi").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    both = own.unionByName(everywhere).dropDuplicates(["node", "block", "rep"]).join(wide, "rep")
    return out.union(_compared(plain(both), ["node", "block"], _forest, threshold).select("a", "b").where("a <> b")).distinct()


def _second_round(small: DataFrame, large: DataFrame | None, reps: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """node, r, g and rep of the documents that may be linked with one of another component.

    In a small node, documents without any candidate in the first round have none in the second; nodes
    of one component are left out before their signatures are fetched.
    """
    own = labels.select(F.col("v").alias("rep"), F.col("component").alias("label"))
    wide = reps.select("rep", "n_shingles", "sig")
    none = F.lit(0).cast("long")
    keys = ["node", "r", "g"]
    labelled = small.join(own, "rep")
    mixed = labelled.groupBy("node").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("node")
    asked = labelled.join(mixed, "node").join(wide, "rep").withColumns({"left": F.lit(True), "r": none, "g": none})
    out = _compared(asked, keys, _suspects, threshold).select(*keys, F.col("a").alias("rep"))
    if large is None:
        return out
    known = large.join(own, "rep")
    sizes = known.groupBy("node", "label").agg(F.count("*").alias("n"))
    common = sizes.groupBy("node").agg(F.max_by("label", F.struct("n", "label")).alias("common"), F.sum("n").alias("size"), F.max("n").alias("most"))
    sized = known.join(common, "node").withColumn("left", F.col("label") != F.col("common"))
    sized = sized.withColumn("blocks", F.ceil(2 * F.col("size") / NODE)).withColumn("others", F.ceil(2 * (F.col("size") - F.col("most")) / NODE)).where("others > 0")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = sized.where("left").withColumn("r", F.pmod(F.xxhash64("rep"), F.col("others"))).withColumn("g", every("blocks"))
    there = sized.withColumn("g", block).withColumn("r", every("others")).withColumn("left", F.lit(False))
    both = asked.unionByName(there).join(wide, "rep")
    return out.union(_compared(both, keys, _suspects, threshold).select(*keys, F.col("a").alias("rep"))).distinct()


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """For each set, the first of those that are reachable from it over links. Sizes of intersections are products of a 0-1 matrix."""
    sizes = np.array([len(x) for x in sets])
    _, column, number = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = number[column] > 1
    row, column = row[shared], (np.cumsum(number > 1) - 1)[column[shared]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (at, at + COLUMNS))
        ones = np.zeros((len(sets), min(COLUMNS, int(column[-1]) + 1 - at)), np.float32)
        ones[row[a:b], column[a:b] - at] = 1
        both += ones @ ones.T
    link = 100 * both >= round(100 * threshold) * (sizes[:, None] + sizes - both)
    np.fill_diagonal(link, True)
    first = np.arange(len(sets))
    while True:
        least = np.where(link, first, len(sets)).min(axis=1)
        least = least[least]
        if (least == first).all():
            return first
        first = least


def _linked_in_nodes(suspects: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that are in one component by the full sets of a node's suspects: one for each of them at most."""
    keys = ["node", "r", "g"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            first = linked([np.frombuffer(r[4], np.uint64) for r in rows], threshold).tolist() if len(rows) > 1 else []
            found = [(rows[x][3], rows[k][3]) for k, x in enumerate(first) if x != k]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        node: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if node and node[-1][:3] != row[:3]:
                    yield batch_of(node)
                    node = []
                node.append(row)
        yield batch_of(node)

    rows = suspects.join(sets, "rep").select(*keys, "rep", "shingles").repartition(*keys).sortWithinPartitions(*keys, "rep")
    return rows.mapInArrow(run, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_cent = round(100 * threshold)
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= per_cent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _full_sets(docs: DataFrame, reps: DataFrame, words: int) -> DataFrame:
    """rep and its sorted shingle hashes, of the given documents only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches):
            values, bounds = shingles(texts, words)
            sets = [values[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["rep", "shingles"])

    wanted = docs.select(F.col("doc_id").alias("rep"), "text").join(reps, "rep", "left_semi")
    return wanted.dropDuplicates(["rep"]).mapInArrow(run, "rep long, shingles binary")


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, recall: float = RECALL) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept, for every row.

    Linked are documents whose sets of ``words``-word shingles have a Jaccard similarity of
    ``threshold`` or more, a multiple of 0.01. Null and empty texts and texts of blanks have empty sets and
    are linked with nothing. Rows that repeat a doc_id have to repeat its text, too, and give repeated
    rows. A null doc_id is linked with nothing; its component is null and it is kept. Columns besides
    doc_id and text are not read. No rows give no rows.
    """
    sets = checkpointed(_sets(docs, words, trees_for(threshold, recall)))
    full = sets.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = compacted(full.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep")))
    reps = full.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    reps = checkpointed(reps.select(F.col("doc_id").alias("rep"), "n_shingles", "sig", "roots"))
    small, large = _nodes(reps)
    first = compacted(_first_round(small, large, reps, threshold))
    active = first.select(F.col("a").alias("rep")).union(first.select(F.col("b").alias("rep")))
    active = (active if large is None else active.union(large.select("rep"))).distinct()
    shingled = checkpointed(_full_sets(docs, active, words))
    links = compacted(_confirmed(first, shingled, threshold))
    own = active.select(F.col("rep").alias("a"), F.col("rep").alias("b"))  # so that each has a label
    labels = components(links.union(own))
    more = _linked_in_nodes(_second_round(small, large, reps, labels, threshold), shingled, threshold)
    # what is new joins whole components
    to = lambda v: labels.select(F.col("v").alias(v), F.col("component").alias(f"c{v}"))
    more = compacted(more.join(to("a"), "a").join(to("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct())
    if not more.isEmpty():
        higher = components(more).select(F.col("v").alias("component"), F.col("component").alias("top"))
        labels = labels.join(higher, "component", "left").select("v", F.coalesce("top", "component").alias("component"))
    of_class = classes.join(labels.withColumnRenamed("v", "rep"), "rep", "left").select("h1", "h2", "n_shingles", F.coalesce("component", "rep").alias("c"))
    out = sets.select("doc_id", "n_shingles", "h1", "h2").join(of_class, ["h1", "h2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

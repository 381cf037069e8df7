"""Centroid clustering of integer vectors with a vantage-point tree over the centroids.

Each round the driver builds a tree over the few centroids and broadcasts it. An inner node holds one
centroid, its vantage point, and parts the others by their distance from it; a leaf holds up to ``LEAF`` centroids. A
vector walks the tree best first: of its open nodes it takes the one with the smallest possible distance, compares
with the centroids there by exact integer distances, and stops once no open node can hold a centroid as near
as its best. The pruning radius is inclusive, so centroids at the same distance are all seen and the smaller
number wins. The vectors of a batch walk in step.

Rounds read the table again and shuffle nothing but sums: one row for each task, centroid and component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.llm.common import checkpointed

DIMENSIONS = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
SEED = 1
#: Centroids of a leaf.
LEAF = 3
#: Vectors that walk in step.
STEP = 4096
#: Relative slack of bounds that come from rounded square roots.
SLACK = 1e-9
#: Bits of a piece of a sum; pieces of a task are 64-bit numbers whatever the components are.
PIECE = 48
LARGEST = (1 << 63) - 1


def exact_limit(dimensions: int) -> int:
    """Components below it have squared distances, and their parts, that doubles hold exactly; greater ones become Python integers."""
    return math.isqrt((1 << 51) // dimensions)


def _squares(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors, as doubles or Python integers."""
    if vectors.dtype == object:
        return ((vectors[:, None, :] - centres.astype(object)[None, :, :]) ** 2).sum(axis=2)
    return (vectors**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] - 2 * (vectors @ centres.T)


class Tree:
    """Vantage-point tree over the different ones of the centroids; of equal ones the first stands for all."""

    def __init__(self, centroids: list[list[int]]) -> None:
        self.large = any(abs(x) > exact_limit(len(c)) for c in centroids for x in c)
        self.centroids = np.array(centroids, dtype=object if self.large else np.float64).reshape(len(centroids), -1)
        first: dict[tuple[int, ...], int] = {}
        for number, c in enumerate(centroids):
            first.setdefault(tuple(c), number)
        self.members: list[np.ndarray] = []  # of a node: its vantage point, or the centroids of a leaf
        self.children: list[list[tuple[int, float, float]]] = []  # node, least and greatest distance from the vantage point
        self._grow(np.array(sorted(first.values()), np.int64))

    def _grow(self, numbers: np.ndarray) -> int:
        node = len(self.members)
        self.members.append(numbers), self.children.append([])
        if len(numbers) <= LEAF:
            return node
        self.members[node], others = numbers[:1], numbers[1:]
        squares = _squares(self.centroids[numbers[:1]], self.centroids[others])[0]
        order = np.argsort(squares, kind="stable")
        for part in (order[: len(order) // 2], order[len(order) // 2 :]):
            near, far = (_root(squares[part[k]]) for k in (0, -1))
            self.children[node].append((self._grow(others[part]), near, far))
        return node

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and exact squared distance of the nearest centroid of each vector; equal distances go to the smaller number."""
        if self.large and vectors.dtype != object:
            vectors = _integers(vectors)
        if len(vectors) == 0:
            return np.zeros(0, np.int64), np.zeros(0)
        found = [self._walk(vectors[a : a + STEP]) for a in range(0, len(vectors), STEP)]
        return np.concatenate([n for n, _ in found]), np.concatenate([d for _, d in found])

    def _walk(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain = vectors.dtype != object
        number = np.full(len(vectors), -1, np.int64)
        best = np.full(len(vectors), np.inf, np.float64 if plain else object)
        # the queue of each vector: the least possible distance of each open node
        queue = np.full((len(vectors), len(self.members)), np.inf)
        queue[:, 0] = 0.0
        going = np.arange(len(vectors))
        while len(going):
            node = queue[going].argmin(axis=1)
            bound = queue[going, node]
            reach = np.sqrt(best[going]) * (1 + SLACK) if plain else np.inf
            open_ = np.isfinite(bound) & (bound <= reach)
            going, node = going[open_], node[open_]
            queue[going, node] = np.inf
            for k in np.unique(node).tolist():
                rows = going[node == k]
                squares = _squares(vectors[rows], self.centroids[self.members[k]])
                for column, candidate in enumerate(self.members[k].tolist()):
                    d = squares[:, column]
                    better = (d < best[rows]) | ((d == best[rows]) & (candidate < number[rows]))
                    best[rows[better]], number[rows[better]] = d[better], candidate
                for child, near, far in self.children[k]:
                    if plain:
                        root = np.sqrt(squares[:, 0])
                        queue[rows, child] = np.maximum(np.maximum(near - root, root - far) - SLACK * (root + far), 0.0)
                    else:
                        queue[rows, child] = 0.0
        return number, best


def _root(square) -> float:
    return math.sqrt(square) if square < 1 << 1000 else math.inf


def _integers(values: np.ndarray) -> np.ndarray:
    out = np.empty(values.shape, object)
    out.ravel()[:] = [int(x) for x in values.ravel().tolist()]
    return out


def flattened(column: pa.Array, scale: int, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each vector's scaled components stay in the range of exact doubles, and the vectors."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dimensions)
    small = np.abs(flat).max(axis=1, initial=0) < exact_limit(dimensions) // scale
    return small, flat


def scaled_large(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python integers, whatever the size."""
    out = np.empty(flat.shape, object)
    out.ravel()[:] = [math.floor(Fraction(x) * scale) for x in flat.ravel().tolist()]
    return out


def kept(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part: ``dimensions`` components, none null or non-finite."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where((F.size("embedding") == dimensions) & fine).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


def _assigned(batch: pa.RecordBatch, tree: Tree, scale: int, dimensions: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of the batch, their integer vectors, centroid numbers and squared distances; small and large components apart."""
    small, flat = flattened(batch.column(1), scale, dimensions)
    for rows, vectors in ((np.nonzero(small)[0], np.floor(flat[small] * scale)), (np.nonzero(~small)[0], scaled_large(flat[~small], scale) if not small.all() else None)):
        if len(rows):
            yield (rows, vectors, *tree.nearest(vectors))


def _starts(rows: DataFrame, centroids: int, seed: int, scale: int) -> list[list[int]]:
    """The vectors with the smallest hashes of seed and id, in that order; rows without an id come last, equal hashes go by vector."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.select("embedding", digest.alias("digest")).orderBy(F.col("digest").asc_nulls_last(), "embedding").limit(centroids)
    return [scaled_large(np.array([r.embedding]), scale)[0].tolist() for r in first.collect()]


def _moved(spark: SparkSession, rows: DataFrame, centroids: list[list[int]], scale: int, dimensions: int) -> list[list[int]]:
    """The floored means of the vectors nearest to each centroid; a centroid without vectors stays."""
    shared = spark.sparkContext.broadcast(Tree(centroids))
    k = len(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[0] * dimensions for _ in range(k)]
        count = np.zeros(k, np.int64)
        for batch in batches:
            for _, vectors, number, _ in _assigned(batch, shared.value, scale, dimensions):
                count += np.bincount(number, minlength=k)
                for c in np.unique(number).tolist():
                    # doubles hold the sum of a batch exactly only as integers
                    own = vectors[number == c]
                    part = own.sum(axis=0) if own.dtype == object else own.astype(np.int64).sum(axis=0)
                    total[c] = [a + int(b) for a, b in zip(total[c], part.tolist())]
        out: list[tuple[int, int, int, int]] = []
        for c in np.nonzero(count)[0].tolist():
            out.append((c, -1, 0, int(count[c])))
            for d, x in enumerate(total[c]):
                sign, left, piece = (-1 if x < 0 else 1), abs(x), 0
                while left:
                    out.append((c, d, piece, sign * (left & ((1 << PIECE) - 1))))
                    left, piece = left >> PIECE, piece + 1
        columns = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["cluster", "dimension", "piece", "value"])

    found = rows.mapInArrow(sums, "cluster long, dimension long, piece long, value long")
    # at most one row for each centroid, component and piece
    found = found.groupBy("cluster", "dimension", "piece").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value"))
    count = [0] * k
    total = [[0] * dimensions for _ in range(k)]
    for r in found.collect():
        if r.dimension < 0:
            count[r.cluster] = int(r.value)
        else:
            total[r.cluster][r.dimension] += int(r.value) << (PIECE * r.piece) if r.value >= 0 else -(int(-r.value) << (PIECE * r.piece))
    shared.destroy()
    return [[x // n for x in t] if n else c for c, t, n in zip(centroids, total, count)]


def clustered(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, dimensions: int = DIMENSIONS, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster, distance of every vector that takes part, written to the checkpoint folder, and the final centroids.

    ``vectors`` has vec_id and embedding; other columns are not read. Vectors of another length, null ones and those with a null or
    non-finite component take no part. Repeated rows are vectors of their own, a null vec_id too; it starts a centroid only where
    ids are too few. With fewer vectors than ``centroids`` each starts one; equal centroids leave the later ones empty.
    No vectors give no rows and no centroids. A squared distance beyond a long is null. ``centroids`` x ``dimensions`` numbers are
    held by the driver and broadcast: a bound by parameters.
    """
    spark = vectors.sparkSession
    rows = kept(vectors, dimensions)
    centres = _starts(rows, centroids, seed, scale)
    if not centres:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    for _ in range(rounds):
        centres = _moved(spark, rows, centres, scale, dimensions)
    shared = spark.sparkContext.broadcast(Tree(centres))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, _, number, square in _assigned(batch, shared.value, scale, dimensions):
                distance = [int(x) if x <= LARGEST else None for x in square.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    ids = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return checkpointed(ids.mapInArrow(assign, "vec_id long, cluster int, distance long")), centres


def digest(assigned: DataFrame, centres: list[list[int]]) -> DataFrame:
    """The contract's columns: each vector's cluster and distance, the sums of distances, and the final centroid's hash. Sums beyond a long are null."""
    sums = {r.cluster: None if r.lost else r.inertia for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(20,0)")).alias("inertia"), F.max(F.col("distance").isNull()).alias("lost")).collect()}
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]

    def number(x: int | None) -> Column:
        return F.lit(int(x) if x is not None and x <= LARGEST else None).cast("long")

    whole = None if None in sums.values() else sum(sums.values())
    own = F.lit(None).cast("long")
    name = F.lit(None).cast("string")
    if centres:
        at = F.col("cluster") + 1
        own = F.element_at(F.array(*(number(sums.get(c, 0)) for c in range(len(centres)))), at)
        name = F.element_at(F.array(*map(F.lit, hashes)), at)
    return assigned.select("vec_id", "cluster", "distance", own.alias("cluster_inertia"), number(whole).alias("inertia"), name.alias("centroid_sha256"))

"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample of the vectors and holds nothing but centres. Every
vector is put into the leaf that it reaches by the nearest centre at each level. A query walks the
tree best bin first: a priority queue holds the branches seen so far, the most promising one is opened
next, until as many leaves are visited as calibration asks for and those hold enough vectors for a whole answer.
Calibration widens the number of visited leaves until queries of the sample find ``TARGET`` of their true neighbours.

Vectors of a leaf and queries that visit it meet in blocks of bounded size, so no leaf, however
popular, is a task of its own. A block keeps the best few of each query, and so does the final ranking.
Scores are inner products of the original vectors in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.session import materialize

#: Vectors that the tree is fitted on at most, and those of them that calibrate it.
SAMPLE = 20_000
CALIBRATION_QUERIES = 400
BRANCHES = 8
#: Vectors of the sample in a leaf at most (unless they are equal).
LEAF = 64
ROUNDS = 8
#: Share of the true neighbours that calibration asks for.
TARGET = 0.97
#: Vectors and queries of a block.
BLOCK = 4096
SEED = 17
RESULT = "query_id long, vec_id long, score double"


class Tree:
    """Centres of a hierarchical k-means tree; children of a node are consecutive, leaves are numbered from 0."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.centres: list[np.ndarray] = []  # of each inner node's children
        self.children: list[list[int]] = []  # inner node k, or leaf -1 - k
        self.reach: list[np.ndarray] = []  # of each inner node's children: the farthest of its vectors from the centre
        self.leaves = 0
        draw = np.random.default_rng(SEED)
        root = self._grow(vectors, draw, 0)
        assert root <= 0

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, vectors: np.ndarray, draw: np.random.Generator, depth: int) -> int:
        if depth and (len(vectors) <= LEAF or np.all(vectors == vectors[0])):
            return self._leaf()
        node = len(self.centres)
        centres, owner = _k_means(vectors, draw)
        self.centres.append(centres), self.children.append([]), self.reach.append(np.zeros(len(centres)))
        for k in range(len(centres)):
            own = vectors[owner == k]
            if len(own):
                self.reach[node][k] = np.sqrt(((own - centres[k]) ** 2).sum(axis=1).max())
            self.children[node].append(self._leaf() if len(own) == len(vectors) or not len(own) else self._grow(own, draw, depth + 1))
        return node

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out = np.zeros(len(vectors), np.int64)
        todo = [(0, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            nearest = _distances(vectors[rows], self.centres[node]).argmin(axis=1)
            for k, child in enumerate(self.children[node]):
                own = rows[nearest == k]
                if child < 0:
                    out[own] = -1 - child
                elif len(own):
                    todo.append((child, own))
        return out

    def visit(self, query: np.ndarray, leaves: int, members: np.ndarray | None = None, wanted: int = 0) -> list[int]:
        """The first ``leaves`` leaves of the walk, best bin first: the bin with the largest possible inner product.

        With ``members``, the vectors in each leaf, empty leaves are passed by, and the walk goes on until it met ``wanted`` of them.
        """
        norm = float(np.sqrt(query @ query))
        queue: list[tuple[float, int]] = [(0.0, 0)]
        visited: list[int] = []
        steps = met = 0
        while queue and (steps < leaves or met < wanted):
            _, node = heapq.heappop(queue)
            if node < 0:
                steps += 1
                if members is None or members[-1 - node]:
                    visited.append(-1 - node)
                    met += 0 if members is None else int(members[-1 - node])
                continue
            promise = self.centres[node] @ query + 0.5 * norm * self.reach[node]
            for value, child in zip(promise.tolist(), self.children[node]):
                heapq.heappush(queue, (-value, child))
        return visited


def _distances(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres**2).sum(axis=1) - 2 * (vectors @ centres.T)


def _k_means(vectors: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    centres = vectors[draw.choice(len(vectors), min(BRANCHES, len(vectors)), replace=False)].copy()
    owner = np.zeros(len(vectors), np.int64)
    for _ in range(ROUNDS):
        owner = _distances(vectors, centres).argmin(axis=1)
        for k in range(len(centres)):
            if len(own := vectors[owner == k]):
                centres[k] = own.mean(axis=0)
    return centres, _distances(vectors, centres).argmin(axis=1)


def calibrated_visits(tree: Tree, vectors: np.ndarray, k: int, target: float = TARGET) -> int:
    """Leaves to visit so that queries drawn from the sample find ``target`` of their k nearest in it."""
    draw = np.random.default_rng(SEED)
    queries = draw.choice(len(vectors), min(CALIBRATION_QUERIES, len(vectors)), replace=False)
    leaf = tree.assign(vectors)
    wanted = found = 0
    needed = np.zeros(tree.leaves + 1, np.int64)  # true neighbours by the place of their leaf in the walk
    for q in queries.tolist():
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        true = np.argsort(-scores)[: min(k, len(vectors) - 1)]
        place = np.zeros(tree.leaves, np.int64)
        place[tree.visit(vectors[q], tree.leaves)] = np.arange(1, tree.leaves + 1)
        needed += np.bincount(place[leaf[true]], minlength=len(needed))
        wanted += len(true)
    for visits in range(1, tree.leaves + 1):
        found += needed[visits]
        if found >= target * wanted:
            return visits
    return max(tree.leaves, 1)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not empty or zero, without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> pd.DataFrame:
    """The k best vectors of a block for each query, by exact score, then id."""
    out = []
    for a in range(0, len(queries), 256):
        rough = queries[a : a + 256] @ vectors.T
        rough[query_ids[a : a + 256, None] == ids] = -np.inf
        n = min(k, len(ids))
        least = -np.partition(-rough, n - 1, axis=1)[:, n - 1 : n]
        # sums in another order may differ in the last bits: whatever comes close is scored exactly
        rows, columns = np.nonzero((rough >= least - 1e-9 * np.maximum(np.abs(least), 1)) & (rough > -np.inf))
        exact = np.einsum("ij,ij->i", queries[a + rows], vectors[columns])
        frame = pd.DataFrame({"query_id": query_ids[a + rows], "vec_id": ids[columns], "score": exact})
        frame = frame.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
        out.append(frame.groupby("query_id", sort=False).head(k))
    return pd.concat(out)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, sample: int = SAMPLE, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score of the k vectors with the largest inner product found for each query.

    ``vectors`` has vec_id and embedding, all of one length; other columns are not read. Rows whose
    vector is not usable, or whose vec_id is null, take no part. Repeated rows of an id count once (the
    first in vector order). Vectors of another length than the most common one (the longest of these) take no part.
    Ties go to the smaller vec_id. Every query finds k candidates, or all if there are fewer.
    """
    spark = vectors.sparkSession
    clean = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    lengths = clean.groupBy(F.size("embedding").alias("length")).agg(F.count("*").alias("n"))
    common = lengths.agg(F.max_by("length", F.struct("n", "length")).alias("length")).select("length").scalar()
    # read again for the sample, the leaves and the walks
    clean = materialize(clean.where(F.size("embedding") == common).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    clean = clean.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    schema = "query_id long, rank int, vec_id long, score double"
    # the rows that come first in hash order: a bounded sample that does not depend on partitions
    first = clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow().column(0).combine_chunks()
    if not len(first):
        return spark.createDataFrame([], schema)
    fitted_on = _matrix(first)
    tree = Tree(fitted_on)
    shared = spark.sparkContext.broadcast(tree)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = shared.value.assign(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], names=["vec_id", "embedding", "leaf"])

    # at the most one number for each leaf of the tree
    def sizes(rows: DataFrame) -> np.ndarray:
        out = np.zeros(tree.leaves, np.int64)
        for r in rows.groupBy("leaf").agg(F.count("*").alias("n")).collect():
            out[r.leaf] = r["n"]
        return out

    members = clean.mapInArrow(leaves, "vec_id long, embedding array<double>, leaf long")
    in_leaf = sizes(members)
    walk = spark.sparkContext.broadcast((in_leaf, calibrated_visits(tree, fitted_on, k, target)))

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_leaf, visits = walk.value
        for batch in batches:
            if batch.num_rows:  # k others, and the query itself
                visited = [shared.value.visit(q, visits, in_leaf, k + 1) for q in _matrix(batch.column(1))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(visited, pa.list_(pa.int64()))], names=["query_id", "embedding", "leaves"])

    queries = clean.where(is_query).withColumnRenamed("vec_id", "query_id").mapInArrow(walks, "query_id long, embedding array<double>, leaves array<long>")
    queries = materialize(queries, "walks").select("query_id", "embedding", F.explode("leaves").alias("leaf"))

    # blocks of a leaf: as many as its rows need
    def width(rows: np.ndarray) -> Column:
        table = F.array(*(F.lit(n) for n in np.maximum(-(-rows // BLOCK), 1).tolist()))
        return F.element_at(table, F.col("leaf").cast("int") + 1)

    member_blocks, query_blocks = width(in_leaf), width(sizes(queries))
    members = members.select("leaf", F.pmod(F.xxhash64("vec_id"), member_blocks).cast("long").alias("mb"), F.explode(F.sequence(F.lit(0), query_blocks - 1)).alias("qb"), "vec_id", "embedding")
    queries = queries.select("leaf", F.explode(F.sequence(F.lit(0), member_blocks - 1).cast("array<long>")).alias("mb"), F.pmod(F.xxhash64("query_id"), query_blocks).cast("int").alias("qb"), "query_id", "embedding")

    def meet(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        return _best(asked.query_id.to_numpy(), np.stack(asked.embedding.to_numpy()), own.vec_id.to_numpy(), np.stack(own.embedding.to_numpy()), k)

    keys = ["leaf", "mb", "qb"]
    found = members.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(meet, RESULT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

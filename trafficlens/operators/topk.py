"""Top-k rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Up to this rank limit Spark prunes each partition before the shuffle by itself.
PRUNED_BY_SPARK = 1000


def topk_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None,
                   rank: str = "rank", spread: Sequence[str] = (), salts: int = 64) -> DataFrame:
    """The first ``k`` rows of every group, or all of them ranked; ``order`` must be total.

    For small ``k`` the window limit is pushed below the shuffle, so a hot group
    sends at most ``k`` rows per map task. Above Spark's own bound the same is done
    here: rows are ranked inside ``salts`` slices of the group first (sliced by a
    hash of the ``spread`` columns), and only the survivors are ranked per group.
    """
    if k is None:
        return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    if k > PRUNED_BY_SPARK and spread:
        slice_of = F.pmod(F.xxhash64(*spread), F.lit(salts))
        df = df.withColumn("_slice", slice_of)
        inner = Window.partitionBy(*keys, "_slice").orderBy(*order)
        df = (df.withColumn("_local", F.row_number().over(inner))
              .filter(F.col("_local") <= k).drop("_local", "_slice"))
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window).cast("bigint")).filter(F.col(rank) <= k)


def top_counts(df: DataFrame, keys: Sequence[str], item: str, k: int,
               weight: str | None = None, count: str = "count") -> DataFrame:
    """Weighted top-k items per group: count descending, item ascending."""
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    counted = df.groupBy(*keys, item).agg(amount.alias(count))
    return topk_per_group(counted, keys, [F.col(count).desc(), F.col(item).asc()], k)


def as_list(ranked: DataFrame, keys: Sequence[str], fields: Sequence[str], name: str,
            rank: str = "rank") -> DataFrame:
    """Fold at most k ranked rows per group into one ordered array of structs."""
    entries = F.array_sort(F.collect_list(F.struct(rank, *fields)))
    bare = F.transform(entries, lambda e: F.struct(*[e[f].alias(f) for f in fields]))
    return ranked.groupBy(*keys).agg(bare.alias(name))

"""Event-time measures of live flows and requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.operators.l7 import additive_counts, request_flags, stat_columns
from trafficlens.operators.measures import additive_sums, rates


def stream_measures(flows: DataFrame, keys: Sequence[str], lateness: str = "10 seconds") -> DataFrame:
    """One-second measures per key, with the columns of the batch measures, emitted once the watermark has passed the second.

    Sources are counted with a sketch, so the state per key is of constant size. Write
    the rows to a table; the live detectors read that table as a stream.
    """
    distinct = F.approx_count_distinct(F.when(F.col("src_ip") != "", F.col("src_ip")), 0.01)
    totals = (flows.withWatermark("ts", lateness).groupBy(F.window("ts", "1 second"), *keys)
              .agg(*additive_sums(flows), distinct.alias("src_ip_count")))
    timed = totals.withColumns({"ts": F.col("window.start"), "tick": F.unix_timestamp("window.start")})
    return rates(timed, ["ts", *keys, "tick"])


def stream_l7(requests: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """Request statistics of the trailing ten seconds, every second and site, with the columns of the batch statistics.

    Two aggregations, one behind the other: sums of every address and path of a window, then the sums, numbers and
    top ones of the window. A hot site's state so is spread over its addresses and paths. The window that ends at
    second t + 1 is the trailing window of tick t.
    """
    items = F.explode(F.array(*[F.struct(F.lit(name).alias("kind"), F.col(name).alias("item")) for name in ("ip", "path")]))
    flagged = request_flags(requests).withWatermark("ts", lateness).withColumn("of", items)
    counts = flagged.groupBy(F.window("ts", "10 seconds", "1 second"), "site_id", "of.kind", "of.item").agg(
        *additive_counts(), F.min(F.unix_timestamp("ts")).alias("oldest"))
    sums = [name for name in counts.columns if name not in ("window", "site_id", "kind", "item", "oldest")]
    # every request stands under its address and under its path
    by_ip, by_path = F.col("kind") == "ip", F.col("kind") == "path"
    totals = counts.groupBy("window", "site_id").agg(
        *[F.sum(F.when(by_ip, F.col(name))).alias(name) for name in sums], F.min("oldest").alias("oldest"),
        F.count(F.when(by_ip, 1)).alias("unique_ips"), F.max(F.when(by_ip, F.col("n"))).alias("top_ip_count"),
        F.max_by("item", F.when(by_ip, F.struct("n", "item"))).alias("top_ip"),
        F.max(F.when(by_path, F.col("n"))).alias("top_path_count"),
        F.min_by("item", F.when(by_path, F.struct(-F.col("n"), F.col("item")))).alias("top_path"))
    tick = F.unix_timestamp("window.end") - 1
    timed = totals.withColumns({"tick": tick, "ts": F.timestamp_seconds(tick)})
    return stat_columns(timed, ["ts", "site_id", "tick"])

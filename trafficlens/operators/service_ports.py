"""Traffic towards ports that are not offered as a service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.operators.joins import nonservice_connections, safelist_anti
from trafficlens.operators.topk import topk_per_group

# Fixed values of the block rules.
MIN_BLOCK_PPS = 10
MAX_NEW_BLOCKS = 50
MAX_ACTIVE_BLOCKS = 200
DEFAULT_COOLDOWN = 300
MIN_COOLDOWN = 60


def nonservice_sources(connections: DataFrame, ports: DataFrame, safelist: DataFrame | None = None,
                       keys: tuple[str, ...] = (), k: int | None = None, max_ports: int | None = None) -> DataFrame:
    """Sources of non-service connections with their ports: all, or the ``k`` busiest with the ``max_ports`` lowest.

    Connections are counted per (source, port) first: at most 65,536 rows per source.
    """
    per_port = nonservice_connections(connections, ports).groupBy(*keys, "src_ip", "dport").agg(
        F.count(F.lit(1)).alias("n"))
    ports = F.array_sort(F.collect_set("dport"))
    per_source = per_port.groupBy(*keys, "src_ip").agg(
        F.sum("n").alias("connections"), (ports if max_ports is None else F.slice(ports, 1, max_ports)).alias("ports"))
    if safelist is not None:
        per_source = safelist_anti(per_source, "src_ip", safelist)
    if k is None:
        return per_source
    order = [F.col("connections").desc(), F.col("src_ip").asc()]
    if keys:
        return topk_per_group(per_source, list(keys), order, k)
    return per_source.orderBy(*order).limit(k)


def block_plan(sources: DataFrame, now: Column, active: DataFrame | None = None, safelist: DataFrame | None = None,
               cooldown: int = DEFAULT_COOLDOWN, scope: str = "non_service") -> DataFrame:
    """Recommended blocks with their expiry; nothing is applied.

    ``sources``: src_ip, connections, ports. ``active``: src_ip, expires_tick of
    blocks in force; expired ones do not count.
    """
    cooldown = max(cooldown, MIN_COOLDOWN)
    rows = sources.filter((F.col("src_ip") != "") & (F.col("connections") >= MIN_BLOCK_PPS))
    if safelist is not None:
        rows = safelist_anti(rows, "src_ip", safelist)
    room = F.lit(MAX_ACTIVE_BLOCKS)
    if active is not None:
        current = active.filter(F.col("expires_tick") > now)
        room = F.lit(MAX_ACTIVE_BLOCKS) - current.agg(F.count(F.lit(1)).alias("n")).scalar()
        rows = rows.join(current.select("src_ip"), "src_ip", "left_anti")
    allowed = F.least(F.lit(MAX_NEW_BLOCKS), F.greatest(room, F.lit(0)))
    best = rows.orderBy(F.col("connections").desc(), "src_ip").limit(MAX_NEW_BLOCKS)
    ranked = best.withColumn("position", F.row_number().over(
        Window.orderBy(F.col("connections").desc(), "src_ip")))
    return ranked.filter(F.col("position") <= allowed).select(
        F.col("src_ip").alias("source_ip"), F.lit(scope).alias("block_scope"),
        F.col("connections").alias("src_pps"), F.col("ports").alias("dst_ports"),
        F.lit(cooldown).cast("bigint").alias("cooldown"), (now + cooldown).cast("bigint").alias("expires_tick"))

"""Per-second traffic measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.network import TCP, TCP_FLAGS, has_flag, percentage, proto_class
from trafficlens.operators.topk import top_counts


def _sum_when(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value).otherwise(0))


def additive_sums(flows: DataFrame) -> list[Column]:
    """Sums that stay correct when they are summed again."""
    packets = F.col("packets")
    kind = proto_class(F.col("protocol"))
    sums = [F.sum("packets").alias("packets"), F.sum("octets").alias("octets"),
            F.count(F.lit(1)).alias("flow_count")]
    sums += [_sum_when(kind == name, packets).alias(f"{name}_packets") for name in ("tcp", "udp", "icmp", "other")]
    is_tcp = F.col("protocol") == TCP
    sums += [_sum_when(is_tcp & has_flag(F.col("tcp_flags"), name), packets).alias(name) for name in TCP_FLAGS]
    if "is_fragment" in flows.columns:
        sums.append(_sum_when(F.col("is_fragment"), packets).alias("fragment_packets"))
    return sums


def rates(totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rates and shares of the sums per second."""
    known = F.col("tcp_packets") + F.col("udp_packets") + F.col("icmp_packets")
    columns = [*keys, "packets", "octets", "flow_count", "tcp_packets", "udp_packets", "icmp_packets",
               "other_packets", *TCP_FLAGS,
               F.col("packets").cast("double").alias("pps"),
               (F.col("octets") * 8).cast("double").alias("bps"),
               percentage(F.col("tcp_packets"), known).alias("tcp_pct"),
               percentage(F.col("udp_packets"), known).alias("udp_pct"),
               percentage(F.col("icmp_packets"), known).alias("icmp_pct"),
               "src_ip_count"]
    if "fragment_packets" in totals.columns:
        columns.append(percentage(F.col("fragment_packets"), F.col("packets")).alias("fragment_pct"))
        columns.append(F.when(F.col("packets") > 0, F.col("octets") / F.col("packets"))
                       .otherwise(0.0).alias("avg_pkt_size"))
    return totals.select(*columns)


def measures(flows: DataFrame, keys: Sequence[str], exact_sources: bool = True) -> DataFrame:
    """Traffic measures per ``keys`` (usually a node or destination, and the tick).

    Sources are counted by grouping on the source address first; the second
    grouping then adds up one row per source, which a hot destination can combine
    on the map side. ``exact_sources=False`` swaps that step for a HyperLogLog
    sketch and needs a single shuffle of constant-size rows.
    """
    if exact_sources:
        per_source = flows.groupBy(*keys, "src_ip").agg(*additive_sums(flows))
        names = [name for name in per_source.columns if name not in (*keys, "src_ip")]
        totals = per_source.groupBy(*keys).agg(
            *[F.sum(name).alias(name) for name in names],
            F.count(F.when(F.col("src_ip") != "", 1)).alias("src_ip_count"))
    else:
        distinct = F.approx_count_distinct(F.when(F.col("src_ip") != "", F.col("src_ip")), 0.01)
        totals = flows.groupBy(*keys).agg(*additive_sums(flows), distinct.alias("src_ip_count"))
    return rates(totals, keys)


def node_ip_filter(flows: DataFrame, node_ip: str | None) -> DataFrame:
    """Flows towards this node; rows without a destination stay."""
    if not node_ip:
        return flows
    return flows.filter((F.col("dst_ip") == "") | F.col("dst_ip").isNull() | (F.col("dst_ip") == node_ip))


def node_measures(flows: DataFrame, node_ip: str | None = None, exact_sources: bool = True) -> DataFrame:
    return measures(node_ip_filter(flows, node_ip), ["node_id", "tick"], exact_sources)


def dst_measures(flows: DataFrame, exact_sources: bool = True) -> DataFrame:
    return measures(flows.filter(F.col("dst_ip") != ""), ["dst_ip", "tick"], exact_sources)


def top_src_ips(flows: DataFrame, keys: Sequence[str], k: int = 20) -> DataFrame:
    return top_counts(flows.filter(F.col("src_ip") != ""), keys, "src_ip", k, "packets")


def top_dst_ports(flows: DataFrame, keys: Sequence[str], k: int = 20) -> DataFrame:
    return top_counts(flows.filter(F.col("dst_port") != 0), keys, "dst_port", k, "packets")


def top_src_ports(flows: DataFrame, keys: Sequence[str], k: int = 20) -> DataFrame:
    return top_counts(flows.filter(F.col("src_port") != 0), keys, "src_port", k, "packets")


def approx_top(flows: DataFrame, keys: Sequence[str], item: str, k: int = 20) -> DataFrame:
    """Space-saving heavy hitters of an item by rows; constant state per group."""
    hitters = F.expr(f"approx_top_k({item}, {k})")
    return (flows.filter(F.col(item).isNotNull()).groupBy(*keys).agg(hitters.alias("hitters"))
            .select(*keys, F.explode("hitters").alias("hit"))
            .select(*keys, F.col("hit.item").alias(item), F.col("hit.count").alias("count")))


def src_cardinality(flows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact distinct sources, grouped twice so that a hot key is combined before the shuffle."""
    return (flows.filter(F.col("src_ip") != "").groupBy(*keys, "src_ip").agg(F.lit(1).alias("seen"))
            .groupBy(*keys).agg(F.count("seen").alias("src_ip_count")))


def src_cardinality_sketch(flows: DataFrame, keys: Sequence[str], lg_k: int = 14) -> DataFrame:
    """Mergeable distinct sketches; estimate with ``hll_sketch_estimate``."""
    return flows.filter(F.col("src_ip") != "").groupBy(*keys).agg(
        F.hll_sketch_agg("src_ip", lg_k).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    return sketches.groupBy(*keys).agg(
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("src_ip_estimate"))


def segment_totals(per_dst: DataFrame) -> DataFrame:
    """Whole-segment totals per tick; protocol shares weighted by packets."""
    packets = F.col("packets")
    total = F.sum(packets)

    def weighted(name: str) -> Column:
        return (F.when(total > 0, F.round(F.sum(F.col(name) * packets) / total, 1))
                .otherwise(0.0).alias(name))

    return per_dst.groupBy("tick").agg(
        F.round(F.sum("pps"), 1).alias("total_pps"), F.round(F.sum("bps"), 1).alias("total_bps"),
        weighted("tcp_pct"), weighted("udp_pct"), weighted("icmp_pct"),
        F.count(F.lit(1)).alias("tracked_ips"))


def metrics_rollup(samples: DataFrame, keys: Sequence[str], every: int = 5) -> DataFrame:
    """Peaks, mean and last values over fixed intervals of ticks."""
    slot = (F.floor(F.col("tick") / every) * every).cast("bigint").alias("slot")

    def last(name: str) -> Column:
        return F.max_by(name, "tick").alias(name)

    carried = [name for name in ("tcp_pct", "udp_pct", "icmp_pct", "conn_count", "threshold")
               if name in samples.columns]
    return samples.groupBy(*keys, slot).agg(
        F.round(F.max("pps"), 1).alias("pps"), F.round(F.max("bps"), 1).alias("bps"),
        F.round(F.sum("pps") / F.count(F.lit(1)), 1).alias("avg_pps"),
        F.count(F.lit(1)).alias("samples"), *[last(name) for name in carried])

"""Packet evidence of an incident or destination.

Everything is additive: one grouping per (key, source) feeds counts, entropy,
confidence and spoofing, and the second grouping per key adds up its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.classify import is_botnet_name
from trafficlens.functions.network import (LARGEST_BUCKET, SIZE_BUCKETS, TCP, TCP_FLAGS, has_flag, percentage,
                                           proto_class, size_bucket)
from trafficlens.operators.sweep import placed
from trafficlens.operators.topk import top_counts, topk_per_group
from trafficlens.session import scalar

# First payload bytes of reflected responses; the first match counts.
PAYLOAD_SIGNATURES = (
    (b"\x17\x00\x03\x2a", "ntp_monlist"),
    (b"\xd7\x00\x03\x2a", "ntp_monlist"),
    (b"STAT\r\n", "memcached"),
    (b"VALUE ", "memcached"),
    (b"\x30\x84", "cldap"),
    (b"\x30\x82", "cldap"),
    (b"\xff\xff\xff\xff\xff\xff", "chargen"),
)


def _count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def _bit_words(value: Column) -> list[Column]:
    """Four 64-bit words that collect which of 256 values occurred."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (value % 64).cast("int"))
    return [F.bit_or(F.when(F.floor(value / 64) == word, bit).otherwise(F.lit(0).cast("bigint")))
            for word in range(4)]


def per_source(packets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts per (keys, source). Distinct TTLs are a fixed 256-bit set, so no second shuffle."""
    kind = proto_class(F.col("protocol"))
    is_tcp = F.col("protocol") == TCP
    ttl_words = _bit_words(F.col("ttl")) if "ttl" in packets.columns else []
    grouped = packets.filter(F.col("src_ip") != "").groupBy(*keys, "src_ip").agg(
        F.count(F.lit(1)).alias("count"), F.sum("pkt_len").alias("bytes"),
        *[_count_if(kind == name).alias(name) for name in ("tcp", "udp", "icmp", "other")],
        *[_count_if(is_tcp & has_flag(F.col("tcp_flags"), name)).alias(name) for name in TCP_FLAGS],
        *[word.alias(f"_ttl{i}") for i, word in enumerate(ttl_words)])
    if not ttl_words:
        return grouped.withColumn("ttl_unique", F.lit(None).cast("bigint"))
    distinct = sum((F.bit_count(f"_ttl{i}") for i in range(1, 4)), F.bit_count("_ttl0"))
    return grouped.withColumn("ttl_unique", distinct.cast("bigint")).drop(*[f"_ttl{i}" for i in range(4)])


def _entropy(count: Column) -> Column:
    """Shannon entropy in bits of the counts of one group, without knowing the total first."""
    total = F.sum(count)
    return F.when(total > 0, F.round(F.log2(total) - F.sum(count * F.log2(count)) / total, 3)).otherwise(0.0)


def src_entropy(sources: DataFrame, keys: Sequence[str]) -> DataFrame:
    return sources.groupBy(*keys).agg(_entropy(F.col("count")).alias("src_entropy"))


def ttl_entropy(packets: DataFrame, keys: Sequence[str]) -> DataFrame:
    counted = packets.groupBy(*keys, "ttl").agg(F.count(F.lit(1)).alias("count"))
    return counted.groupBy(*keys).agg(_entropy(F.col("count")).alias("ttl_entropy"))


def looks_spoofed(sources: Column, src_bits: Column, ttl_bits: Column) -> Column:
    return ((sources >= 500)
            & (((ttl_bits > 4.0) & (src_bits > 8.0)) | ((sources > 5000) & (src_bits > 10.0))))


def spoofing(packets: DataFrame, keys: Sequence[str], sources: DataFrame | None = None) -> DataFrame:
    """Source count, both entropies and the spoofing verdict per group."""
    sources = per_source(packets, keys) if sources is None else sources
    by_src = sources.groupBy(*keys).agg(F.count(F.lit(1)).alias("src_ip_count"),
                                        _entropy(F.col("count")).alias("src_entropy"))
    joined = by_src.join(ttl_entropy(packets, keys), list(keys))
    return joined.withColumn("spoofing_detected", looks_spoofed(
        F.col("src_ip_count"), F.col("src_entropy"), F.col("ttl_entropy")))


def botnet(sources: DataFrame, hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Many sources, or a threat-intelligence hit that names a botnet family.

    ``hits``: keys, ioc_hit.
    """
    counted = sources.groupBy(*keys).agg(F.count(F.lit(1)).alias("src_ip_count"))
    named = hits.groupBy(*keys).agg(F.bool_or(is_botnet_name(F.col("ioc_hit"))).alias("named"))
    return counted.join(named, list(keys), "full_outer").select(
        *keys, F.coalesce("src_ip_count", F.lit(0)).alias("src_ip_count"),
        ((F.coalesce("src_ip_count", F.lit(0)) > 5000) | F.coalesce("named", F.lit(False))).alias("botnet_detected"))


def packet_size_stats(packets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, population deviation and the seven-bucket histogram of packet sizes."""
    bucket = size_bucket(F.col("pkt_len"))
    labels = [label for _, label in SIZE_BUCKETS] + [LARGEST_BUCKET]
    n = F.count("pkt_len")
    # Integer moments keep the result independent of the order of partial sums.
    total, squares = F.sum("pkt_len"), F.sum(F.col("pkt_len") * F.col("pkt_len"))
    # The products of a flood's sums outgrow 64 bits.
    wide, mass, many = (x.cast("decimal(38,0)") for x in (squares, total, n.cast("decimal(19,0)")))
    variance = (wide * many - mass * mass).cast("double") / (many * many).cast("double")
    return packets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packets"),
        F.coalesce(F.round(total / n, 1), F.lit(0.0)).alias("avg_pkt_length"),
        F.when(n < 2, 999.0).otherwise(F.round(F.sqrt(variance), 1)).alias("pkt_length_std"),
        *[_count_if(bucket == label).alias(f"size_{label.replace('-', '_').replace('+', '_plus')}")
          for label in labels])


def ttl_distribution(packets: DataFrame, keys: Sequence[str], k: int = 15) -> DataFrame:
    return top_counts(packets, keys, "ttl", k)


def protocol_breakdown(packets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Protocol shares including other protocols, fragment share, flag counts and SYN ratio."""
    kind = proto_class(F.col("protocol"))
    is_tcp = F.col("protocol") == TCP
    totals = packets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packets"),
        *[_count_if(kind == name).alias(name) for name in ("tcp", "udp", "icmp", "other")],
        _count_if(F.col("is_fragment")).alias("fragment_count"),
        *[_count_if(is_tcp & has_flag(F.col("tcp_flags"), name)).alias(name) for name in TCP_FLAGS])
    flags = sum((F.col(name) for name in list(TCP_FLAGS)[1:]), F.col("syn"))
    return totals.select(
        *keys, "packets", *[percentage(F.col(name), F.col("packets")).alias(f"{name}_pct")
                            for name in ("tcp", "udp", "icmp", "other")],
        "fragment_count", percentage(F.col("fragment_count"), F.col("packets")).alias("fragment_pct"),
        *TCP_FLAGS, F.when(flags > 0, F.col("syn") / flags).otherwise(0.0).alias("syn_ratio"))


def dns_stats(packets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total and distinct query names per group."""
    names = (packets.filter(F.col("dns_qname").isNotNull()).groupBy(*keys, "dns_qname")
             .agg(F.count(F.lit(1)).alias("count")))
    return names.groupBy(*keys).agg(F.sum("count").alias("dns_total"), F.count(F.lit(1)).alias("dns_unique"))


def top_dns_names(packets: DataFrame, keys: Sequence[str], k: int = 10) -> DataFrame:
    return top_counts(packets.filter(F.col("dns_qname").isNotNull()), keys, "dns_qname", k)


def payload_signature(payload: Column) -> Column:
    """Signature name of a binary payload, or null."""
    column = None
    for prefix, name in PAYLOAD_SIGNATURES:
        match = F.substring(payload, F.lit(1), F.lit(len(prefix))) == F.lit(bytearray(prefix))
        column = F.when(match, name) if column is None else column.when(match, name)
    return column


def payload_sig_counts(payloads: DataFrame, keys: Sequence[str]) -> DataFrame:
    named = payloads.withColumn("signature", payload_signature(F.col("payload").cast("binary")))
    return (named.filter(F.col("signature").isNotNull()).groupBy(*keys, "signature")
            .agg(F.count(F.lit(1)).alias("count")))


def source_confidence(sources: DataFrame, keys: Sequence[str], blocklist: DataFrame | None = None) -> DataFrame:
    """0-100 score per source: how likely it takes part in the attack."""
    if keys:
        scored = sources.join(sources.groupBy(*keys).agg(F.sum("count").alias("total")), list(keys))
    else:
        scored = sources.withColumn("total", scalar(sources, F.sum("count")))
    c = F.col("count")
    share = c / F.greatest(F.col("total"), F.lit(1))
    protocols = sum(((F.col(name) > 0).cast("int") for name in ("udp", "icmp")), (F.col("tcp") > 0).cast("int"))

    def points(condition: Column, value: int) -> Column:
        return F.when(condition, value).otherwise(0)

    score = (
        F.when(share > 0.05, 30).when(share > 0.02, 15).otherwise(0)
        + points((F.col("tcp") > 0) & (F.col("ack") == 0) & (F.col("syn") > 0), 25)
        + points((F.col("ttl_unique") <= 1) & (c > 50), 20)
        + points((protocols == 1) & (c > 100), 10)
        + F.when(c > 500, 15).when(c > 200, 5).otherwise(0)
        + points((F.col("udp") > F.col("tcp")) & (F.col("bytes") / F.greatest(c, F.lit(1)) < 100) & (c > 100), 10))
    scored = scored.withColumn("confidence", F.least(score, F.lit(100)).cast("bigint")) \
        .withColumn("pct", F.round(share * 100, 2))
    if blocklist is None:
        return scored.withColumn("threat_intel", F.lit(False))
    listed = blocklist.select(F.col("indicator").alias("src_ip"), F.lit(True).alias("threat_intel")).distinct()
    scored = scored.join(listed, "src_ip", "left").withColumn(
        "threat_intel", F.coalesce("threat_intel", F.lit(False)))
    return scored.withColumn("confidence", F.when(
        F.col("threat_intel"), F.greatest(F.col("confidence"), F.lit(90).cast("bigint"))).otherwise(F.col("confidence")))


def top_sources(sources: DataFrame, keys: Sequence[str], blocklist: DataFrame | None = None, k: int = 20) -> DataFrame:
    """The k busiest sources of each group with their confidence."""
    scored = source_confidence(sources, keys, blocklist)
    return topk_per_group(scored, keys, [F.col("count").desc(), F.col("src_ip").asc()], k)


def per_vm_breakdown(packets: DataFrame, keys: Sequence[str], labels: DataFrame | None = None,
                     k: int = 50) -> DataFrame:
    """Traffic per inner destination of tunnelled packets, busiest first."""
    kind = proto_class(F.col("protocol"))
    tunnelled = packets.filter(F.col("was_gre") & F.col("inner_dst_ip").isNotNull())
    per_src = tunnelled.groupBy(*keys, "inner_dst_ip", "src_ip").agg(
        F.count(F.lit(1)).alias("packets"), F.sum("inner_len").alias("bytes"),
        *[_count_if(kind == name).alias(name) for name in ("tcp", "udp", "icmp")])
    totals = per_src.groupBy(*keys, "inner_dst_ip").agg(
        *[F.sum(name).alias(name) for name in ("packets", "bytes", "tcp", "udp", "icmp")],
        F.count(F.lit(1)).alias("src_ip_count"))
    known = F.col("tcp") + F.col("udp") + F.col("icmp")
    ranked = topk_per_group(totals, keys, [F.col("packets").desc(), F.col("inner_dst_ip").asc()], k)
    result = ranked.select(
        *keys, "rank", F.col("inner_dst_ip").alias("inner_ip"), "packets", "bytes",
        *[percentage(F.col(name), known, 2).alias(f"{name}_pct") for name in ("tcp", "udp", "icmp")],
        "src_ip_count", (F.col("rank") == 1).alias("is_top_attacked"))
    if labels is None:
        return result.withColumn("label", F.lit(""))
    named = labels.groupBy(F.col("ip").alias("inner_ip")).agg(F.min("label").alias("label"))
    return result.join(named, "inner_ip", "left").withColumn("label", F.coalesce("label", F.lit("")))


def gre_overhead(packets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of bytes that is tunnel header, and share of packets that is tunnelled."""
    outer = F.sum(F.when(F.col("was_gre"), F.col("outer_len")).otherwise(0))
    inner = F.sum(F.when(F.col("was_gre"), F.col("inner_len")).otherwise(0))
    return packets.groupBy(*keys).agg(
        F.when(outer > 0, F.greatest(F.lit(0.0), (outer - inner) / outer)).otherwise(0.0).alias("overhead_ratio"),
        (_count_if(F.col("was_gre")) / F.count(F.lit(1))).alias("gre_traffic_ratio"))


def correct_for_gre(rates: DataFrame, overhead: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bandwidth without the tunnel headers."""
    ratio = F.coalesce("overhead_ratio", F.lit(0.0))
    return (rates.join(overhead.select(*keys, "overhead_ratio"), list(keys), "left")
            .withColumn("corrected_bps", F.col("bps") * (1.0 - ratio)).drop("overhead_ratio"))


def ioc_hit_counts(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Most frequent hit, its count and the distinct hits per group.

    ``hits``: keys, ioc_hit. Ties go to the hit that sorts first.
    """
    counted = hits.filter(F.col("ioc_hit").isNotNull()).groupBy(*keys, "ioc_hit").agg(
        F.count(F.lit(1)).alias("count"))
    return counted.groupBy(*keys).agg(
        F.sum("count").alias("hits"),
        F.min_by("ioc_hit", F.struct(-F.col("count"), F.col("ioc_hit"))).alias("top_hit"),
        F.max("count").alias("top_hit_count"),
        F.array_sort(F.collect_set("ioc_hit")).alias("distinct_hits"))


def deep_sample(packets: DataFrame, every: int = 10, key: str = "node_id",
                order: Sequence[str] = ("tick",)) -> DataFrame:
    """Every n-th packet of a node in arrival order.

    Positions are those of ``sweep.placed``: a node with many packets in a second is spread over tasks.
    """
    numbered = placed(packets, key, ["tick", *(name for name in order if name != "tick")])
    return numbered.filter(F.col("_place") % every == 0).select(*packets.columns)


def incident_confidence(duration: Column, peak_pps: Column, threshold: Column, sources: Column,
                        dominant_pct: Column, avg_size: Column, size_std: Column, boost: Column,
                        spoofed: Column, botnet_seen: Column) -> Column:
    """0-100 score of a closed incident."""
    def points(condition: Column, value: int) -> Column:
        return F.when(condition, value).otherwise(0)

    ratio = F.floor(peak_pps / F.greatest(threshold, F.lit(1.0)) * 5).cast("bigint")
    score = (
        F.when(duration < 10, 15).when(duration < 30, 25).when(duration < 120, 35).otherwise(45)
        + F.least(F.lit(25), ratio)
        + F.when(sources > 5000, 10).when(sources > 1000, 5).otherwise(0)
        + points(dominant_pct > 80, 10)
        + points((avg_size > 0) & (size_std < 50), 10)
        + F.when(duration > 300, 10).when(duration > 60, 5).otherwise(0)
        + F.least(F.lit(20), boost)
        + points(spoofed, 10) + points(botnet_seen, 10))
    return F.least(F.greatest(score, F.lit(0)), F.lit(100)).cast("bigint")

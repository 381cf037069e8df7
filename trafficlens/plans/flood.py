"""End-to-end flood queries built from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.classify import classify_attack, ip_status, syn_ratio
from trafficlens.functions.network import TCP_FLAGS
from trafficlens.operators.baseline import UNSEEN_PPS, exceeds, runs_of, with_calibrated_threshold
from trafficlens.operators.joins import label_join
from trafficlens.operators.measures import dst_measures
from trafficlens.operators.topk import topk_per_group
from trafficlens.session import materialize


def flag_columns() -> dict:
    return {name: F.col(name) for name in TCP_FLAGS}


def measure_family(measures: DataFrame) -> DataFrame:
    """Attack family of each measure row as a per-destination incident would open with it."""
    return measures.withColumn("family", classify_attack(
        F.col("tcp_pct"), F.col("udp_pct"), F.col("icmp_pct"), syn_ratio(flag_columns()),
        fragments=F.col("fragment_pct")))


def sustained_floods(flows: DataFrame, cut: int, confirm: int = 3, window: int = 300) -> DataFrame:
    """Destinations under a sustained flood after tick ``cut``, with family and peak.

    A destination that was not seen before ``cut`` is judged by the fixed rates of ``exceeds``.
    The flows are read once. After the aggregation to (destination, second) there is
    one more shuffle, by destination: threshold, runs and run totals all reuse it.
    """
    judged = with_calibrated_threshold(dst_measures(flows), "dst_ip", cut, window)
    hot_now = exceeds(F.col("threshold"), F.col("pps"), F.col("bps"), F.col("p99_pps").isNotNull())
    judged = judged.filter(F.col("tick") >= cut).withColumn("hot", hot_now)
    hot = runs_of(judged, "dst_ip", "hot").filter("hot")
    totals = ("tcp_packets", "udp_packets", "icmp_packets", *TCP_FLAGS)
    span = hot.groupBy("dst_ip", "_run").agg(
        F.min("tick").alias("first_tick"), F.max("tick").alias("last_tick"), F.count(F.lit(1)).alias("length"),
        F.max("pps").alias("peak_pps"), F.max("bps").alias("peak_bps"), F.max("src_ip_count").alias("peak_sources"),
        F.max("threshold").alias("threshold"), *[F.sum(name).alias(name) for name in totals])
    span = span.filter(F.col("length") >= confirm)
    known = F.col("tcp_packets") + F.col("udp_packets") + F.col("icmp_packets")
    shares = {name: F.when(known > 0, F.round(F.col(f"{name}_packets") / known * 100, 1)).otherwise(0.0)
              for name in ("tcp", "udp", "icmp")}
    return span.select(
        "dst_ip", "first_tick", "last_tick", "length", "peak_pps", "peak_bps", "peak_sources", "threshold",
        *[share.alias(f"{name}_pct") for name, share in shares.items()],
        classify_attack(shares["tcp"], shares["udp"], shares["icmp"], syn_ratio(flag_columns())).alias("family"))


def dst_report(measures: DataFrame, baselines: DataFrame, attacking: DataFrame, labels: DataFrame,
               others: int = 100) -> DataFrame:
    """One tick of a segment: every attacked destination and the busiest others.

    ``measures``: rows of one tick per report key; ``baselines``: dst_ip, avg_pps,
    threshold; ``attacking``: dst_ip, tick. Destinations without a baseline are judged by UNSEEN_PPS.
    """
    marked = measures.join(attacking.select("dst_ip", "tick", F.lit(True).alias("attacked")).distinct(),
                           ["dst_ip", "tick"], "left")
    marked = marked.withColumn("attacked", F.coalesce("attacked", F.lit(False)))
    hot = marked.filter("attacked")
    rest = topk_per_group(marked.filter("NOT attacked"), ["tick"],
                          [F.col("pps").desc(), F.col("dst_ip").asc()], others).drop("rank")
    listed = hot.unionByName(rest).join(baselines, "dst_ip", "left")
    listed = label_join(listed, labels, "dst_ip")
    threshold = F.coalesce("threshold", F.lit(UNSEEN_PPS))
    return listed.select(
        "tick", F.col("dst_ip").alias("ip"), "label", F.round("pps", 1).alias("pps"), F.round("bps", 1).alias("bps"),
        "tcp_pct", "udp_pct", "icmp_pct", F.round(F.coalesce("avg_pps", F.lit(0.0)), 1).alias("baseline_pps"),
        F.round(threshold, 1).alias("threshold_pps"), ip_status(F.col("attacked"), F.col("pps"), threshold)
        .alias("status"), "src_ip_count")


def report_totals(measures: DataFrame, attacking: DataFrame) -> DataFrame:
    """Segment totals and the number of open attacks per tick."""
    totals = measures.groupBy("tick").agg(F.round(F.sum("pps"), 1).alias("total_pps"),
                                          F.round(F.sum("bps"), 1).alias("total_bps"),
                                          F.count(F.lit(1)).alias("tracked_ip_count"))
    active = attacking.select("dst_ip", "tick").distinct().groupBy("tick").agg(
        F.count(F.lit(1)).alias("active_attacks"))
    return totals.join(active, "tick", "left").withColumn("active_attacks", F.coalesce("active_attacks", F.lit(0)))


def baseline_summary(baseline: DataFrame, key: str, k: int = 20) -> DataFrame:
    """Ready keys with the highest thresholds, from each key's newest baseline row."""
    newest = baseline.groupBy(key).agg(F.max_by(F.struct("ready", "threshold", "avg_pps", "p99_pps"), "tick")
                                       .alias("b"))
    return (newest.filter("b.ready")
            .select(key, *[F.round(f"b.{name}", 1).alias(name) for name in ("threshold", "avg_pps", "p99_pps")])
            .orderBy(F.col("threshold").desc(), key).limit(k))


def incident_report(packets: DataFrame, incidents: DataFrame, hits: DataFrame, signatures: DataFrame,
                    curves: DataFrame, blocklist: DataFrame | None = None) -> DataFrame:
    """Full record of every incident: evidence, final family, confidence and traffic curve.

    ``incidents``: incident_id, dst_ip, started_tick, ended_tick, duration, peak_pps,
    peak_bps, threshold. ``hits``: dst_ip, tick, ioc_hit. ``signatures``: dst_ip, tick, signature,
    count. ``curves``: incident_id, velocity_curve. Evidence is the packets, pattern hits and
    signatures of the attacked destination from the first to the last second of the incident.
    """
    from trafficlens.functions.classify import resolve_family_subtype
    from trafficlens.operators import evidence
    from trafficlens.operators.topk import as_list, top_counts

    key = ["incident_id"]
    width = 60
    spans = incidents.select("incident_id", "dst_ip", "started_tick", "ended_tick", F.explode(F.sequence(
        F.floor(F.col("started_tick") / width), F.floor(F.col("ended_tick") / width))).alias("_slot"))

    def within(rows: DataFrame) -> DataFrame:
        met = rows.withColumn("_slot", F.floor(F.col("tick") / width)).join(spans, ["dst_ip", "_slot"])
        return met.filter(F.col("tick").between(F.col("started_tick"), F.col("ended_tick"))).drop("_slot")

    # Eight groupings read these packets; the packet table itself is then read only once.
    during = materialize(within(packets).select(
        "incident_id", "src_ip", "src_port", "dst_port", "protocol", "pkt_len", "tcp_flags", "ttl", "is_fragment",
        "dns_qname"), "incident-packets")
    sources = evidence.per_source(during, key)
    met = within(hits).select("incident_id", "ioc_hit")
    named = within(signatures).groupBy("incident_id", "signature").agg(F.sum("count").alias("count")).groupBy("incident_id").agg(
        F.min_by("signature", F.struct(-F.col("count"), F.col("signature"))).alias("top_signature"),
        F.max("count").alias("top_signature_count"))
    dst_ports = top_counts(during.filter("dst_port <> 0"), key, "dst_port", 20)
    src_ports = top_counts(during.filter("src_port <> 0"), key, "src_port", 20)
    parts = [
        evidence.protocol_breakdown(during, key).drop("packets"), evidence.packet_size_stats(during, key),
        evidence.spoofing(during, key, sources), evidence.dns_stats(during, key), evidence.ioc_hit_counts(met, key), named,
        evidence.botnet(sources, met, key).drop("src_ip_count"),
        as_list(dst_ports, key, ["dst_port", "count"], "top_dst_ports"),
        as_list(evidence.top_sources(sources, key, blocklist), key, ["src_ip", "count", "confidence"], "top_src_ips"),
        dst_ports.filter("rank = 1").select("incident_id", "dst_port"),
        src_ports.filter("rank = 1").select("incident_id", "src_port"), curves]
    joined = incidents
    for part in parts:
        joined = joined.join(part, "incident_id", "left")
    joined = joined.withColumn("resolved", resolve_family_subtype(
        F.col("tcp_pct"), F.col("udp_pct"), F.col("icmp_pct"), F.col("other_pct"), flag_columns(),
        F.col("avg_pkt_length"), F.col("dst_port"), F.col("src_port"), F.col("fragment_pct"),
        F.coalesce("dns_unique", F.lit(0)), F.col("top_hit"), F.col("top_hit_count"), F.col("top_signature"),
        F.col("top_signature_count")))
    confidence = evidence.incident_confidence(
        F.col("duration"), F.col("peak_pps"), F.col("threshold"), F.col("src_ip_count"),
        F.greatest("tcp_pct", "udp_pct", "icmp_pct"), F.col("avg_pkt_length"), F.col("pkt_length_std"),
        F.col("resolved.boost"), F.col("spoofing_detected"), F.col("botnet_detected"))
    return joined.select(
        "incident_id", "dst_ip", "started_tick", "ended_tick", "duration", "peak_pps", "peak_bps", "threshold",
        F.col("resolved.family").alias("attack_family"), F.col("resolved.subtype").alias("attack_subtype"),
        F.col("resolved.tool").alias("attack_tool"), confidence.alias("confidence"), F.col("resolved.boost").alias("boost"), "packets", "tcp_pct", "udp_pct",
        "icmp_pct", "other_pct", "fragment_pct", "src_ip_count", "src_entropy", "ttl_entropy", "avg_pkt_length",
        "pkt_length_std", "spoofing_detected", "botnet_detected", "dns_unique", "distinct_hits", "top_src_ips",
        "top_dst_ports", "velocity_curve")

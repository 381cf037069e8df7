"""Registered queries: name -> callable(spark, sf_dir).

Names follow the operator inventory. Every query runs over whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens import schemas
from trafficlens.functions import classify, network
from trafficlens.functions import http as http_functions
from trafficlens.operators import baseline, detect, evidence, joins, l7, measures, service_ports, topk
from trafficlens.plans import encoded, flood
from trafficlens.plans import workload as w
from trafficlens.session import checkpoint_dir, materialize
from trafficlens.sources import access_log, captures, datagrams, frames, sinks, tables
from trafficlens.sources.versioned import VersionedTable
from trafficlens.streaming import detect as live_detect
from trafficlens.streaming import measures as live_measures
from trafficlens.streaming import templates as live_templates

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# First tick after the quiet learning period of the derived traffic.
CUT = 600


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _text(array: str):
    return F.array_join(F.transform(array, lambda item: item.cast("string")), ",")


# --- sources ---------------------------------------------------------------

@query
def read_flows(spark, sf_dir):
    return w.flows(spark, sf_dir).select(
        "tick", "node_id", "exporter_ip", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packets",
        "octets", "tcp_flags")


@query
def read_counters(spark, sf_dir):
    return w.counters(spark, sf_dir)


@query
def read_access_log(spark, sf_dir):
    return access_log.parse_access_lines(w.access_lines(spark, sf_dir))


@query
def read_json_access_log(spark, sf_dir):
    return access_log.parse_access_lines(w.json_access_lines(spark, sf_dir))


@query
def read_connections(spark, sf_dir):
    parsed = tables.parse_connections(w.connection_lines(spark, sf_dir))
    return parsed.groupBy("node_id", "src_ip", "dport").agg(F.count(F.lit(1)).alias("connections"))


@query
def read_dimensions(spark, sf_dir):
    """Service-port configuration expanded and matched with the traffic it covers."""
    ports = tables.expand_ports(w.service_ports(spark)).select("port").distinct()
    flows = w.flows(spark, sf_dir).groupBy("dst_port").agg(F.sum("packets").alias("packets"))
    return flows.join(ports.withColumnRenamed("port", "dst_port"), "dst_port")


# --- projections -----------------------------------------------------------

@query
def proto_class(spark, sf_dir):
    return (w.flows(spark, sf_dir).withColumn("proto", network.proto_class(F.col("protocol")))
            .groupBy("proto").agg(F.count(F.lit(1)).alias("flows"), F.sum("packets").alias("packets")))


@query
def tcp_flag_bits(spark, sf_dir):
    bits = network.tcp_flag_bits(F.col("tcp_flags"))
    return (w.flows(spark, sf_dir).select("tcp_flags", bits.alias("bits")).select("tcp_flags", "bits.*")
            .groupBy("tcp_flags", *network.TCP_FLAGS).agg(F.count(F.lit(1)).alias("flows")))


@query
def is_fragment(spark, sf_dir):
    """The IPv4 flags word, rebuilt from the flow columns, tested bit by bit."""
    word = F.when(F.col("is_fragment"), F.when(F.col("ttl") % 2 == 0, 0x2000).otherwise(F.col("ttl"))).otherwise(0x4000)
    flows = w.flows(spark, sf_dir).withColumn("found", network.is_fragment(word.cast("bigint")))
    return flows.groupBy("dst_ip", "found").agg(F.count(F.lit(1)).alias("flows"))


@query
def node_ip_filter(spark, sf_dir):
    flows = measures.node_ip_filter(w.flows(spark, sf_dir), "192.0.2.3")
    return flows.groupBy("node_id", "dst_ip").agg(F.count(F.lit(1)).alias("flows"), F.sum("packets").alias("packets"))


@query
def subnet_filter(spark, sf_dir):
    kept = joins.subnet_filter(measures.dst_measures(w.flows(spark, sf_dir)), "dst_ip", w.subnets(spark))
    return kept.select("dst_ip", "tick", "packets", "octets")


@query
def http_version(spark, sf_dir):
    raw = F.expr("CASE event_id % 7 WHEN 0 THEN 'HTTP/2.0' WHEN 1 THEN 'h2' WHEN 2 THEN ' h2c' WHEN 3 THEN 'HTTP/3.0'"
                 " WHEN 4 THEN 'H3' WHEN 5 THEN 'http/1.0' ELSE '' END")
    rows = w.http(spark, sf_dir).select("site_id", http_functions.http_version(raw).alias("version"))
    return rows.groupBy("site_id", "version").agg(F.count(F.lit(1)).alias("requests"))


@query
def status_group(spark, sf_dir):
    rows = w.http(spark, sf_dir).select("site_id", http_functions.status_group(F.col("status")).alias("status_group"))
    return rows.groupBy("site_id", "status_group").agg(F.count(F.lit(1)).alias("requests"))


@query
def threat_flags(spark, sf_dir):
    rows = w.http(spark, sf_dir).select("site_id", "path", F.explode(
        http_functions.threat_flags(F.col("path"))).alias("threat"))
    return rows.groupBy("site_id", "path", "threat").agg(F.count(F.lit(1)).alias("requests"))


@query
def threat_flags_text(spark, sf_dir):
    """The signatures over whole documents and raw pages, as long request texts."""
    texts = w.table(spark, sf_dir, "documents").selectExpr("'document' AS kind", "doc_id AS id", "text AS path")
    pages = w.table(spark, sf_dir, "pages").selectExpr("'page' AS kind", "page_id AS id", "html AS path")
    rows = texts.unionByName(pages).select("kind", "id", F.explode(
        http_functions.threat_flags(F.col("path"))).alias("threat"))
    return rows.groupBy("kind", "threat").agg(F.count(F.lit(1)).alias("texts"), F.sum("id").alias("id_sum"))


@query
def is_bot_ua(spark, sf_dir):
    rows = w.http(spark, sf_dir).select("ua", http_functions.is_bot_agent(F.col("ua")).alias("is_bot"))
    return rows.groupBy("ua", "is_bot").agg(F.count(F.lit(1)).alias("requests"))


@query
def size_bucket(spark, sf_dir):
    rows = w.packets(spark, sf_dir).select("dst_ip", network.size_bucket(F.col("pkt_len")).alias("bucket"))
    return rows.groupBy("dst_ip", "bucket").agg(F.count(F.lit(1)).alias("packets"))


@query
def deep_sample(spark, sf_dir):
    kept = evidence.deep_sample(w.packets(spark, sf_dir), order=("flow_id", "flow_line", "src_ip", "dst_ip"))
    return kept.select("node_id", "tick", "flow_id", "flow_line", "src_ip", "dst_ip", "pkt_len")


# --- measures --------------------------------------------------------------

@query
def node_measures(spark, sf_dir):
    return measures.node_measures(w.flows(spark, sf_dir).drop("is_fragment"))


@query
def dst_measures(spark, sf_dir):
    return measures.dst_measures(w.flows(spark, sf_dir)).withColumn("avg_pkt_size", F.round("avg_pkt_size", 6))


@query
def top_src_ips(spark, sf_dir):
    return measures.top_src_ips(w.flows(spark, sf_dir), ["node_id", "tick"])


@query
def top_dst_ports(spark, sf_dir):
    return measures.top_dst_ports(w.flows(spark, sf_dir), ["dst_ip", "tick"])


@query
def top_src_ports(spark, sf_dir):
    return measures.top_src_ports(w.flows(spark, sf_dir), ["dst_ip"])


@query
def src_cardinality(spark, sf_dir):
    return measures.src_cardinality(w.flows(spark, sf_dir), ["dst_ip"])


@query
def segment_totals(spark, sf_dir):
    return measures.segment_totals(measures.dst_measures(w.flows(spark, sf_dir)))


@query
def metrics_rollup(spark, sf_dir):
    per_node = measures.node_measures(w.flows(spark, sf_dir))
    base = baseline.rolling_baseline(per_node, "node_id").select("node_id", "tick", "threshold")
    samples = per_node.join(base, ["node_id", "tick"]).withColumn("conn_count", F.col("flow_count"))
    return measures.metrics_rollup(samples, ["node_id"])


# --- evidence --------------------------------------------------------------

@query
def src_entropy(spark, sf_dir):
    return evidence.src_entropy(evidence.per_source(w.packets(spark, sf_dir), ["dst_ip"]), ["dst_ip"])


@query
def ttl_entropy(spark, sf_dir):
    return evidence.ttl_entropy(w.packets(spark, sf_dir), ["dst_ip"])


@query
def spoofing_detected(spark, sf_dir):
    return evidence.spoofing(w.packets(spark, sf_dir), ["dst_ip"])


@query
def botnet_detected(spark, sf_dir):
    sources = evidence.per_source(w.packets(spark, sf_dir), ["dst_ip"])
    hits = joins.ioc_join(w.payloads(spark, sf_dir), w.iocs(spark), inline=True).filter("ioc_hit IS NOT NULL")
    return evidence.botnet(sources, hits.select("dst_ip", "ioc_hit"), ["dst_ip"])


@query
def packet_size_stats(spark, sf_dir):
    return evidence.packet_size_stats(w.packets(spark, sf_dir), ["dst_ip"])


@query
def ttl_distribution(spark, sf_dir):
    return evidence.ttl_distribution(w.packets(spark, sf_dir), ["dst_ip"])


@query
def protocol_breakdown(spark, sf_dir):
    rows = evidence.protocol_breakdown(w.packets(spark, sf_dir), ["dst_ip"])
    return rows.withColumn("syn_ratio", F.round("syn_ratio", 6))


@query
def dns_stats(spark, sf_dir):
    packets = w.packets(spark, sf_dir)
    ranked = evidence.top_dns_names(packets, ["node_id"])
    return ranked.join(evidence.dns_stats(packets, ["node_id"]), "node_id")


@query
def payload_sig_counts(spark, sf_dir):
    return evidence.payload_sig_counts(w.payloads(spark, sf_dir), ["dst_ip"])


@query
def source_confidence(spark, sf_dir):
    sources = evidence.per_source(w.packets(spark, sf_dir), ["dst_ip"])
    scored = evidence.source_confidence(sources, ["dst_ip"], w.blocklist(spark, sf_dir))
    return scored.select("dst_ip", "src_ip", "count", "tcp", "udp", "icmp", "other", "syn", "ack", "bytes",
                         "ttl_unique", "pct", "confidence", "threat_intel")


@query
def per_vm_breakdown(spark, sf_dir):
    named = w.labels(spark).withColumn("ip", F.regexp_replace("ip", r"^192\.0\.2", "172.16.0"))
    return evidence.per_vm_breakdown(w.packets(spark, sf_dir), ["node_id"], named)


@query
def gre_overhead(spark, sf_dir):
    packets = w.packets(spark, sf_dir)
    keys = ["node_id", "tick"]
    overhead = evidence.gre_overhead(packets, keys)
    rates = measures.node_measures(w.flows(spark, sf_dir)).select(*keys, "bps")
    corrected = evidence.correct_for_gre(rates, overhead, keys)
    return corrected.join(overhead, keys).select(
        *keys, "bps", *[F.round(name, 6).alias(name) for name in ("overhead_ratio", "gre_traffic_ratio")],
        F.round("corrected_bps", 3).alias("corrected_bps"))


@query
def ioc_hit_counts(spark, sf_dir):
    hits = joins.ioc_join(w.payloads(spark, sf_dir), w.iocs(spark), inline=True)
    return evidence.ioc_hit_counts(hits, ["dst_ip"]).withColumn(
        "distinct_hits", F.array_join("distinct_hits", ",")).select(
        "dst_ip", "hits", "top_hit", "top_hit_count", "distinct_hits")


@query
def distinct_ioc(spark, sf_dir):
    hits = joins.ioc_join(w.payloads(spark, sf_dir), w.iocs(spark), inline=True)
    return hits.filter("ioc_hit IS NOT NULL").select("dst_ip", "ioc_hit").distinct()


@query
def nonservice_sources(spark, sf_dir):
    parsed = tables.parse_connections(w.connection_lines(spark, sf_dir))
    ports = tables.expand_ports(w.service_ports(spark))
    found = service_ports.nonservice_sources(parsed, ports, w.safelist(spark), ("node_id",), k=50, max_ports=20)
    return found.withColumn("ports", _text("ports"))


@query
def block_plan(spark, sf_dir):
    parsed = tables.parse_connections(w.connection_lines(spark, sf_dir))
    ports = tables.expand_ports(w.service_ports(spark))
    found = service_ports.nonservice_sources(parsed, ports, w.safelist(spark))
    active = found.filter(F.col("connections") % 4 == 0).selectExpr(
        "src_ip", "CAST(800 + connections * 5 AS bigint) AS expires_tick")
    plan = service_ports.block_plan(found, F.lit(900), active, w.safelist(spark), cooldown=30)
    return plan.withColumn("dst_ports", _text("dst_ports"))


# --- joins -----------------------------------------------------------------

@query
def cidr_join(spark, sf_dir):
    sources = w.flows(spark, sf_dir).groupBy("dst_ip").agg(F.sum("packets").alias("packets"))
    return joins.cidr_join(sources, "dst_ip", w.subnets(spark))


@query
def blocklist_join(spark, sf_dir):
    sources = evidence.per_source(w.packets(spark, sf_dir), ["dst_ip"])
    marked = joins.blocklist_join(sources, w.blocklist(spark, sf_dir))
    return marked.select("dst_ip", "src_ip", "count", "threat_intel")


@query
def blocklist_ratio(spark, sf_dir):
    ratio = joins.blocklist_ratio(w.flows(spark, sf_dir), ["dst_ip"], w.blocklist(spark, sf_dir))
    return ratio.withColumn("blocklist_ratio", F.round("blocklist_ratio", 6))


@query
def safelist_anti(spark, sf_dir):
    sources = w.flows(spark, sf_dir).groupBy("src_ip").agg(F.sum("packets").alias("packets"))
    return joins.safelist_anti(sources, "src_ip", w.safelist(spark))


@query
def label_join(spark, sf_dir):
    totals = w.flows(spark, sf_dir).groupBy("dst_ip").agg(F.sum("packets").alias("packets"))
    return joins.label_join(totals, w.labels(spark), "dst_ip")


@query
def ioc_join(spark, sf_dir):
    hits = joins.ioc_join(w.payloads(spark, sf_dir), w.iocs(spark), inline=True)
    return hits.filter("ioc_hit IS NOT NULL").select("doc_id", "dst_ip", "ioc_hit")


@query
def ioc_join_long_list(spark, sf_dir):
    """The equality-join form for long pattern lists, here with every benchmark passage as a pattern."""
    benchmark = w.table(spark, sf_dir, "benchmark").selectExpr(
        "100 + item_id AS ord", "text AS pattern", "concat('passage', item_id) AS attack_name",
        "'unknown' AS attack_family")
    patterns = w.iocs(spark).unionByName(benchmark)
    hits = joins.ioc_join(w.payloads(spark, sf_dir), patterns)
    return hits.filter("ioc_hit IS NOT NULL").select("doc_id", "ioc_hit")


@query
def asof_join(spark, sf_dir):
    """Newest earlier sampling announcement of every flow's exporter."""
    flows = w.flows(spark, sf_dir).selectExpr("exporter_ip", "tick", "flow_id", "flow_line", "src_ip", "packets")
    rates = w.flows(spark, sf_dir).filter("protocol = 47").groupBy("exporter_ip", "tick").agg(
        F.max("ttl").alias("rate"))
    return joins.asof_join(flows, rates, ["exporter_ip"], ["tick"], "rate")


@query
def payload_signature(spark, sf_dir):
    named = w.payloads(spark, sf_dir).select("doc_id", evidence.payload_signature(
        F.col("payload").cast("binary")).alias("signature"))
    return named.filter("signature IS NOT NULL")


@query
def merge_flow_over_packets(spark, sf_dir):
    flows = w.flows(spark, sf_dir)
    flow_rows = measures.dst_measures(flows.filter("src_port % 3 <> 0")).select("dst_ip", "tick", "pps", "bps", "tcp_pct")
    packet_rows = measures.dst_measures(flows.filter("src_port % 3 <> 1")).select("dst_ip", "tick", "pps", "bps", "tcp_pct")
    return joins.merge_flow_over_packets(flow_rows, packet_rows)


@query
def merge_node_sources(spark, sf_dir):
    rates = baseline.counter_rates(w.counters(spark, sf_dir))
    per_node = measures.node_measures(w.flows(spark, sf_dir))
    merged = joins.merge_node_sources(rates, per_node)
    return merged.withColumn("pps", F.round("pps", 6)).withColumn("bps", F.round("bps", 6))


@query
def incident_evidence(spark, sf_dir):
    """All packets of the sustained floods, and all earlier ones of their destinations."""
    return _evidence(spark, sf_dir, None, None, None)


@query
def incident_evidence_any_age(spark, sf_dir):
    """Evidence packets of the sustained floods: the first 10,000, and the last 1,000 before the start, whatever their age."""
    return _evidence(spark, sf_dir, 10_000, 1_000, None)


@query
def incident_evidence_limited(spark, sf_dir):
    """The same with limits low enough to be reached at every scale: 1,500 packets, and 40 of the 60 ticks before."""
    return _evidence(spark, sf_dir, 1500, 40, 60)


def _evidence(spark, sf_dir, during, before, look_back):
    floods = flood.sustained_floods(w.flows(spark, sf_dir), CUT)
    incidents = floods.selectExpr("dst_ip", "concat(dst_ip, '@', first_tick) AS incident_id",
                                  "first_tick AS started_tick", "last_tick AS ended_tick")
    packets = w.packets(spark, sf_dir).select("dst_ip", "tick", "flow_id", "flow_line", "src_ip", "pkt_len")
    found = joins.incident_evidence(packets, incidents, ["tick", "flow_id", "flow_line", "src_ip"], during, before, look_back)
    return found.select("incident_id", "phase", "position", "tick", "flow_id", "flow_line", "src_ip", "pkt_len")


@query
def correlate_l3_l7(spark, sf_dir):
    """Web error bursts set against per-node floods."""
    per_node = measures.node_measures(w.flows(spark, sf_dir))
    hot = per_node.withColumn("hot", F.col("pps") > 5000)
    node_incidents = baseline.sustained(hot, "node_id", "hot", 1).selectExpr(
        "node_id", "first_tick AS started_tick", "last_tick AS ended_tick")
    http_incidents = (w.http(spark, sf_dir).filter("status >= 400")
                      .selectExpr("concat('node', substr(site_id, 5)) AS node_id", "tick").distinct()
                      .selectExpr("node_id", "concat(node_id, '@', tick) AS incident_id", "tick AS started_tick"))
    return joins.correlate_l3_l7(http_incidents, node_incidents)


@query
def nonservice_connections(spark, sf_dir):
    parsed = tables.parse_connections(w.connection_lines(spark, sf_dir))
    left = joins.nonservice_connections(parsed, tables.expand_ports(w.service_ports(spark)))
    return left.groupBy("node_id", "dport").agg(F.count(F.lit(1)).alias("connections"))


# --- windows ---------------------------------------------------------------

@query
def counter_rates(spark, sf_dir):
    rates = baseline.counter_rates(w.counters(spark, sf_dir))
    return rates.withColumn("pps", F.round("pps", 6)).withColumn("bps", F.round("bps", 6))


def _dst_baseline(spark, sf_dir, **options):
    per_dst = measures.dst_measures(w.flows(spark, sf_dir)).select("dst_ip", "tick", "pps", "bps")
    return baseline.rolling_baseline(per_dst, "dst_ip", **options)


@query
def rolling_baseline(spark, sf_dir):
    rows = _dst_baseline(spark, sf_dir)
    return rows.select("dst_ip", "tick", "sample_no", F.round("avg_pps", 6).alias("avg_pps"), "p95_pps", "p99_pps",
                       F.round("avg_bps", 6).alias("avg_bps"), "p99_bps", "ready")


@query
def hourly_baseline(spark, sf_dir):
    """Hour-of-day percentiles, with hours shortened to 300 ticks so that several occur."""
    rows = _dst_baseline(spark, sf_dir, hour_seconds=300)
    return rows.select("dst_ip", "tick", "hour_ready", "hour_p99", "threshold")


@query
def threshold(spark, sf_dir):
    return _dst_baseline(spark, sf_dir).select("dst_ip", "tick", "ready", "threshold", "bps_threshold")


@query
def calibrated_threshold(spark, sf_dir):
    per_dst = measures.dst_measures(w.flows(spark, sf_dir))
    rows = baseline.calibrated_threshold(per_dst, "dst_ip", CUT)
    return rows.withColumn("avg_pps", F.round("avg_pps", 6))


@query
def velocity(spark, sf_dir):
    rows = baseline.velocity(_dst_baseline(spark, sf_dir), "dst_ip")
    return rows.withColumn("avg_pps", F.round("avg_pps", 6))


def _hot_rows(spark, sf_dir):
    per_dst = measures.dst_measures(w.flows(spark, sf_dir))
    judged = baseline.with_calibrated_threshold(per_dst, "dst_ip", CUT)
    return judged.withColumn("hot", baseline.exceeds(
        F.col("threshold"), F.col("pps"), F.col("bps"), F.col("p99_pps").isNotNull()))


@query
def sustained(spark, sf_dir):
    return baseline.sustained(_hot_rows(spark, sf_dir), "dst_ip", "hot")


@query
def holddown(spark, sf_dir):
    return baseline.holddown(_hot_rows(spark, sf_dir), "dst_ip", "hot")


@query
def classification_lock(spark, sf_dir):
    per_dst = flood.measure_family(measures.dst_measures(w.flows(spark, sf_dir)))
    return baseline.classification_lock(per_dst.select("dst_ip", "tick", "family"), "dst_ip")


@query
def velocity_curve(spark, sf_dir):
    flows = w.flows(spark, sf_dir)
    incidents = flood.sustained_floods(flows, CUT).selectExpr(
        "dst_ip", "concat(dst_ip, '@', first_tick) AS incident_id", "first_tick AS started_tick",
        "last_tick AS ended_tick")
    return baseline.velocity_points(measures.dst_measures(flows).select("dst_ip", "tick", "pps"), incidents, "dst_ip")


def _service_counters(spark, sf_dir):
    from pyspark.sql import Window

    ports = tables.expand_ports(w.service_ports(spark)).select(F.col("port").alias("dst_port"),
                                                               F.lit(True).alias("service")).distinct()
    flows = w.flows(spark, sf_dir).groupBy("node_id", "tick", "dst_port").agg(
        F.sum("packets").alias("packets"), F.sum("octets").alias("octets"),
        F.sum(F.when(F.col("tcp_flags") == 24, F.col("packets")).otherwise(0)).alias("blocked"))
    marked = flows.join(ports, "dst_port", "left")
    service = F.col("service").isNotNull()
    per_tick = marked.groupBy("node_id", "tick").agg(
        F.sum(F.when(service, F.col("packets")).otherwise(0)).alias("service_packets"),
        F.sum(F.when(service, F.col("octets")).otherwise(0)).alias("service_bytes"),
        F.sum(F.when(~service, F.col("packets")).otherwise(0)).alias("non_service_packets"),
        F.sum(F.when(~service, F.col("octets")).otherwise(0)).alias("non_service_bytes"),
        F.sum("blocked").alias("blocked_packets"))
    running = Window.partitionBy("node_id").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    names = [name for name in per_tick.columns if name not in ("node_id", "tick")]
    return per_tick.select("node_id", "tick", *[F.sum(name).over(running).alias(name) for name in names])


@query
def sp_rates(spark, sf_dir):
    return baseline.sp_rates(_service_counters(spark, sf_dir))


# --- classification --------------------------------------------------------

@query
def classify_attack(spark, sf_dir):
    per_dst = flood.measure_family(measures.dst_measures(w.flows(spark, sf_dir)))
    return per_dst.select("dst_ip", "tick", "tcp_pct", "udp_pct", "icmp_pct", "family")


def _tick_classes(spark, sf_dir):
    """Per (destination, tick): measures, top ports and family."""
    flows = w.flows(spark, sf_dir)
    per_dst = flood.measure_family(measures.dst_measures(flows))
    keys = ["dst_ip", "tick"]
    top_dst = measures.top_dst_ports(flows, keys, 1).select(*keys, "dst_port")
    top_src = measures.top_src_ports(flows, keys, 1).select(*keys, "src_port")
    return per_dst.join(top_dst, keys, "left").join(top_src, keys, "left")


@query
def classify_subtype(spark, sf_dir):
    rows = _tick_classes(spark, sf_dir)
    subtype = classify.classify_subtype(F.col("family"), F.col("dst_port"), flood.flag_columns(),
                                        F.col("avg_pkt_size"), F.col("src_port"), F.col("fragment_pct"))
    return rows.select("dst_ip", "tick", "family", subtype.alias("subtype"))


@query
def classify_tcp_subtype(spark, sf_dir):
    per_dst = measures.dst_measures(w.flows(spark, sf_dir))
    return per_dst.select("dst_ip", "tick", classify.classify_tcp_subtype(flood.flag_columns()).alias("tcp_subtype"))


def _ioc_tops(spark, sf_dir):
    return evidence.ioc_hit_counts(joins.ioc_join(w.payloads(spark, sf_dir), w.iocs(spark), inline=True), ["dst_ip"])


@query
def enrich_from_ioc(spark, sf_dir):
    rows = evidence.protocol_breakdown(w.packets(spark, sf_dir), ["dst_ip"])
    family = classify.classify_attack(F.col("tcp_pct"), F.col("udp_pct"), F.col("icmp_pct"), F.col("syn_ratio"),
                                      other=F.col("other_pct"), fragments=F.col("fragment_pct"))
    joined = rows.withColumn("before", family).join(_ioc_tops(spark, sf_dir), "dst_ip", "left")
    enriched = classify.enrich_from_ioc(F.col("top_hit"), F.col("top_hit_count"), F.col("before"), F.lit("volumetric"))
    return joined.select("dst_ip", "before", enriched.alias("e")).select(
        "dst_ip", "before", "e.family", "e.subtype", "e.tool", "e.boost")


def incident_evidence_summary(spark, sf_dir) -> DataFrame:
    """One row per destination with all evidence that the final classification needs."""
    packets = w.packets(spark, sf_dir)
    keys = ["dst_ip"]
    breakdown = evidence.protocol_breakdown(packets, keys).drop("packets")
    sizes = evidence.packet_size_stats(packets, keys).select("dst_ip", "packets", "avg_pkt_length", "pkt_length_std")
    dst_port = topk.top_counts(packets.filter("dst_port <> 0"), keys, "dst_port", 1).select("dst_ip", "dst_port")
    src_port = topk.top_counts(packets.filter("src_port <> 0"), keys, "src_port", 1).select("dst_ip", "src_port")
    dns = evidence.dns_stats(packets, keys).select("dst_ip", "dns_unique")
    signatures = evidence.payload_sig_counts(w.payloads(spark, sf_dir), keys).groupBy("dst_ip").agg(
        F.min_by("signature", F.struct(-F.col("count"), F.col("signature"))).alias("top_signature"),
        F.max("count").alias("top_signature_count"))
    joined = breakdown.join(sizes, "dst_ip")
    for part in (dst_port, src_port, dns, _ioc_tops(spark, sf_dir), signatures):
        joined = joined.join(part, "dst_ip", "left")
    return joined.withColumn("dns_unique", F.coalesce("dns_unique", F.lit(0)))


@query
def resolve_family_subtype(spark, sf_dir):
    rows = incident_evidence_summary(spark, sf_dir)
    resolved = classify.resolve_family_subtype(
        F.col("tcp_pct"), F.col("udp_pct"), F.col("icmp_pct"), F.col("other_pct"), flood.flag_columns(),
        F.col("avg_pkt_length"), F.col("dst_port"), F.col("src_port"), F.col("fragment_pct"), F.col("dns_unique"),
        F.col("top_hit"), F.col("top_hit_count"), F.col("top_signature"), F.col("top_signature_count"))
    return rows.select("dst_ip", resolved.alias("r")).select("dst_ip", "r.family", "r.subtype", "r.tool", "r.boost")


# --- web requests ----------------------------------------------------------

@query
def l7_window_stats(spark, sf_dir):
    return l7.l7_window_stats(w.http(spark, sf_dir))


@query
def l7_top_ips(spark, sf_dir):
    return l7.l7_top_items(w.http(spark, sf_dir), "ip", l7.TOP_IPS)


@query
def l7_top_paths(spark, sf_dir):
    return l7.l7_top_items(w.http(spark, sf_dir), "path", l7.TOP_PATHS)


@query
def l7_top_agents(spark, sf_dir):
    return l7.l7_top_items(w.http(spark, sf_dir), "ua", l7.TOP_AGENTS)


@query
def classify_l7_subtype(spark, sf_dir):
    stats = l7.with_subtype(l7.l7_window_stats(w.http(spark, sf_dir)))
    return stats.select("site_id", "tick", "total_requests", "attack_subtype")


@query
def l7_path_max(spark, sf_dir):
    stats = l7.l7_window_stats(w.http(spark, sf_dir))
    share = classify.top_share
    return stats.select("site_id", "tick", "top_path", "top_path_count",
                        F.round(share(F.col("top_path_count"), F.col("total_requests")), 6).alias("path_share"),
                        F.round(share(F.col("top_ip_count"), F.col("total_requests")), 6).alias("ip_share"))


def _http_spans(spark, sf_dir):
    """Spans of heavy error traffic per site, as stand-in incidents for the summaries."""
    stats = l7.l7_window_stats(w.http(spark, sf_dir))
    hot = stats.select("site_id", "tick", F.col("rps").alias("pps"), (F.col("error_rate") > 40).alias("hot"))
    return baseline.sustained(hot, "site_id", "hot").selectExpr(
        "site_id", "concat(site_id, '@', first_tick) AS incident_id", "first_tick AS started_tick",
        "last_tick AS ended_tick")


@query
def l7_baseline(spark, sf_dir):
    rows = l7.l7_baseline(l7.l7_window_stats(w.http(spark, sf_dir)))
    return rows.withColumn("baseline_rps", F.round("baseline_rps", 6))


@query
def l7_attack_summary(spark, sf_dir):
    requests = w.http(spark, sf_dir)
    return l7.l7_attack_totals(l7.l7_window_stats(requests), _http_spans(spark, sf_dir), requests)


@query
def l7_attack_top_paths(spark, sf_dir):
    ranked = l7.l7_top_items(w.http(spark, sf_dir), "path", l7.TOP_PATHS)
    return l7.l7_attack_listed_items(ranked, _http_spans(spark, sf_dir), "path", l7.TOP_PATHS)


@query
def l7_attack_whole_paths(spark, sf_dir):
    """Top paths of whole attacks from all requests; ``l7_attack_top_paths`` sums its windows' top lists, as its SQL does."""
    return l7.l7_attack_items(w.http(spark, sf_dir), _http_spans(spark, sf_dir), "path", l7.TOP_PATHS)


@query
def l7_attack_lists(spark, sf_dir):
    return l7.l7_attack_lists(w.http(spark, sf_dir), _http_spans(spark, sf_dir))


# --- reports ---------------------------------------------------------------

@query
def topk_per_group(spark, sf_dir):
    """The ten largest flows towards every destination."""
    flows = w.flows(spark, sf_dir).select("dst_ip", "octets", "flow_id", "flow_line", "src_ip")
    order = [F.col("octets").desc(), F.col("flow_id"), F.col("flow_line"), F.col("src_ip")]
    return topk.topk_per_group(flows, ["dst_ip"], order, 10)


@query
def sustained_floods(spark, sf_dir):
    return flood.sustained_floods(w.flows(spark, sf_dir), CUT)


@query
def dst_report(spark, sf_dir):
    hot = _hot_rows(spark, sf_dir)
    per_dst = measures.dst_measures(w.flows(spark, sf_dir))
    limits = baseline.calibrated_threshold(per_dst, "dst_ip", CUT).select("dst_ip", "avg_pps", "threshold")
    return flood.dst_report(per_dst, limits, hot.filter("hot").select("dst_ip", "tick"), w.labels(spark))


@query
def dst_report_totals(spark, sf_dir):
    hot = _hot_rows(spark, sf_dir).filter("hot").select("dst_ip", "tick")
    return flood.report_totals(measures.dst_measures(w.flows(spark, sf_dir)), hot)


@query
def ip_status(spark, sf_dir):
    rows = _hot_rows(spark, sf_dir)
    return rows.select("dst_ip", "tick", classify.ip_status(F.lit(False), F.col("pps"), F.col("threshold")).alias("status"))


@query
def baseline_summary(spark, sf_dir):
    return flood.baseline_summary(_dst_baseline(spark, sf_dir), "dst_ip")


# --- detectors -------------------------------------------------------------

def _dst_events(spark, sf_dir):
    per_dst = measures.dst_measures(w.flows(spark, sf_dir)).select("dst_ip", "tick", "pps", "bps")
    last = w.flows(spark, sf_dir).agg(F.max("tick").alias("t")).select("t").scalar()
    return detect.events_only(detect.detect_dst(per_dst, last))


@query
def detect_dst(spark, sf_dir):
    return _dst_events(spark, sf_dir).withColumn("avg_pps", F.round("avg_pps", 6)).drop("snap_tick")


@query
def dst_incidents(spark, sf_dir):
    return detect.incidents(_dst_events(spark, sf_dir)).drop("snap_tick")


def _node_rows(spark, sf_dir):
    flows = w.flows(spark, sf_dir)
    ratio = joins.blocklist_ratio(flows, ["node_id", "tick"], w.blocklist(spark, sf_dir)).select(
        "node_id", "tick", "blocklist_ratio")
    per_node = measures.node_measures(flows).select("node_id", "tick", "pps", "bps")
    return per_node.join(ratio, ["node_id", "tick"], "left")


def _node_events(spark, sf_dir):
    return detect.events_only(detect.detect_node(_node_rows(spark, sf_dir)))


@query
def detect_node(spark, sf_dir):
    return _node_events(spark, sf_dir).withColumn("avg_pps", F.round("avg_pps", 6)).drop("snap_tick")


@query
def detect_http(spark, sf_dir):
    return detect.events_only(detect.detect_http(l7.l7_window_stats(w.http(spark, sf_dir))))


@query
def detect_nonservice(spark, sf_dir):
    rates = baseline.sp_rates(_service_counters(spark, sf_dir))
    per_node = measures.node_measures(w.flows(spark, sf_dir)).select("node_id", "tick", "pps", "bps")
    limits = baseline.rolling_baseline(per_node, "node_id").select("node_id", "tick", "pps", "threshold")
    return detect.detect_nonservice(rates.join(limits, ["node_id", "tick"]), limit=1000)


# --- binary telemetry ------------------------------------------------------

FLOW_FIELDS = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packets", "octets", "tcp_flags", "sample_rate")


@query
def route_datagrams(spark, sf_dir):
    routed = datagrams.route_datagrams(encoded.mixed_datagrams(spark, sf_dir))
    return routed.groupBy("exporter_ip", "kind").agg(F.count(F.lit(1)).alias("datagrams"))


@query
def decode_netflow_v5(spark, sf_dir):
    rows = datagrams.decode_netflow_v5(encoded.v5_datagrams(spark, sf_dir))
    return rows.select("exporter_ip", "tick", *FLOW_FIELDS)


@query
def decode_sflow_v5(spark, sf_dir):
    rows = datagrams.decode_sflow_v5(encoded.sflow_datagrams(spark, sf_dir))
    return rows.select("exporter_ip", "tick", *FLOW_FIELDS)


def _templated(spark, sf_dir):
    """The sets of all templated datagrams and the templates defined in them; each is read several times, so written once."""
    sets = materialize(datagrams.template_sets(datagrams.route_datagrams(encoded.templated_datagrams(spark, sf_dir))), "sets")
    return sets, materialize(datagrams.extract_templates(sets), "templates")


@query
def extract_templates(spark, sf_dir):
    sets = datagrams.template_sets(datagrams.route_datagrams(encoded.templated_datagrams(spark, sf_dir)))
    fields = F.array_join(F.transform("fields", lambda f: F.concat_ws(":", f["id"], f["len"])), ",")
    return datagrams.extract_templates(sets).select("exporter_ip", "domain", "template_id", "seq", "is_options",
                                                    fields.alias("fields"))


@query
def decode_templated(spark, sf_dir):
    rows = datagrams.decode_templated(*_templated(spark, sf_dir))
    return rows.select("exporter_ip", "tick", *FLOW_FIELDS)


@query
def extract_sampling(spark, sf_dir):
    return datagrams.extract_sampling(*_templated(spark, sf_dir)).select("exporter_ip", "tick", "seq", "rate")


@query
def apply_sampling(spark, sf_dir):
    """Mixed datagrams of all formats, decoded and scaled."""
    rows = datagrams.decode_datagrams(materialize(encoded.mixed_datagrams(spark, sf_dir), "datagrams"))
    return rows.groupBy("exporter_ip", "tick", "sample_rate").agg(
        F.count(F.lit(1)).alias("flows"), F.sum("packets").alias("packets"), F.sum("octets").alias("octets"))


@query
def exporter_allowlist(spark, sf_dir):
    kept = datagrams.exporter_allowlist(encoded.v5_datagrams(spark, sf_dir), ["198.51.100.1", "198.51.100.2"])
    return datagrams.decode_netflow_v5(kept).groupBy("exporter_ip").agg(F.count(F.lit(1)).alias("flows"))


@query
def collector_quality(spark, sf_dir):
    """Datagrams whose order number ends in 9 are cut to their first three bytes."""
    cut = F.when(F.col("seq") % 10 == 9, F.expr("substring(payload, 1, 3)")).otherwise(F.col("payload"))
    sent = encoded.v5_datagrams(spark, sf_dir).withColumn("payload", cut)
    allowed = ["198.51.100.1", "198.51.100.2", "198.51.100.3"]
    flows = datagrams.decode_netflow_v5(datagrams.exporter_allowlist(sent, allowed))
    return datagrams.collector_quality(sent, flows, allowed, "192.0.2.3")


@query
def scan_pcap(spark, sf_dir):
    found = frames.scan_pcap(encoded.capture_files(spark, sf_dir))
    return found.groupBy("path", "link_type").agg(
        F.count(F.lit(1)).alias("frames"), F.sum(F.length("frame")).alias("bytes"), F.max("ts_us").alias("last_us"))


@query
def scan_large_pcap(spark, sf_dir):
    """The same captures as files, each read in ranges of 16 KB by several tasks."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/captures-{uuid.uuid4().hex}"
    captures.write_captures(encoded.capture_files(spark, sf_dir), folder)
    found = captures.read_large_pcap(spark, folder, part_bytes=1 << 14)
    return found.groupBy(F.substring_index("path", "/", -1).alias("path"), "link_type").agg(
        F.count(F.lit(1)).alias("frames"), F.sum(F.length("frame")).alias("bytes"), F.max("ts_us").alias("last_us"),
        F.max("frame_no").alias("last_no"), F.countDistinct("frame_no").alias("numbers"))


PACKET_FIELDS = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "pkt_len", "tcp_flags", "ttl", "is_fragment")


@query
def decode_frames(spark, sf_dir):
    rows = frames.decode_frames(encoded.frames(spark, sf_dir))
    return rows.select("flow_id", "flow_line", *PACKET_FIELDS)


@query
def gre_decap(spark, sf_dir):
    rows = frames.decode_frames(encoded.frames(spark, sf_dir), gre_strip=True)
    return rows.select("flow_id", "flow_line", *PACKET_FIELDS, "was_gre", "inner_dst_ip", "outer_len", "inner_len")


# --- incidents and state ---------------------------------------------------

def _report(spark, sf_dir) -> DataFrame:
    flows = w.flows(spark, sf_dir)
    found = flood.sustained_floods(flows, CUT).selectExpr(
        "concat(dst_ip, '@', first_tick) AS incident_id", "dst_ip", "first_tick AS started_tick",
        "last_tick AS ended_tick", "last_tick - first_tick AS duration", "peak_pps", "peak_bps", "threshold")
    found = materialize(found, "incidents")
    hits = joins.ioc_join(w.payloads(spark, sf_dir), w.iocs(spark), inline=True).filter("ioc_hit IS NOT NULL").select("dst_ip", "tick", "ioc_hit")
    signatures = evidence.payload_sig_counts(w.payloads(spark, sf_dir), ["dst_ip", "tick"])
    per_dst = measures.dst_measures(flows).select("dst_ip", "tick", "pps")
    curves = baseline.velocity_curve(per_dst, found, "dst_ip").drop("dst_ip")
    return flood.incident_report(w.packets(spark, sf_dir), found, hits, signatures, curves, w.blocklist(spark, sf_dir))


@query
def incident_report(spark, sf_dir):
    """The whole report, its lists as text; points of the curve are seconds and tenths of packets a second."""
    def listed(name, *fields):
        return F.array_join(F.transform(name, lambda entry: F.concat_ws(":", *[entry[f].cast("string") for f in fields])), ";")

    curve = F.transform("velocity_curve", lambda p: F.concat_ws(":", p["t"].cast("bigint").cast("string"),
                                                                F.round(p["pps"] * 10).cast("bigint").cast("string")))
    return _report(spark, sf_dir).select(
        "incident_id", "started_tick", "ended_tick", "duration", "peak_pps", "peak_bps", "threshold", "attack_family", "attack_subtype",
        "attack_tool", "confidence", "packets", "tcp_pct", "udp_pct", "icmp_pct", "other_pct", "fragment_pct", "src_ip_count", "src_entropy",
        "ttl_entropy", "avg_pkt_length", "pkt_length_std", "spoofing_detected", "botnet_detected",
        F.coalesce("dns_unique", F.lit(0)).alias("dns_unique"), F.array_join("distinct_hits", ";").alias("distinct_hits"),
        listed("top_src_ips", "src_ip", "count").alias("top_sources"), listed("top_dst_ports", "dst_port", "count").alias("top_ports"),
        F.array_join(curve, ";").alias("velocity_curve"))


@query
def incident_confidence(spark, sf_dir):
    """The score of every incident beside the evidence that it adds up."""
    return _report(spark, sf_dir).select(
        "incident_id", "duration", "peak_pps", "threshold", "src_ip_count", F.greatest("tcp_pct", "udp_pct", "icmp_pct").alias("dominant_pct"),
        "avg_pkt_length", "pkt_length_std", "boost", "spoofing_detected", "botnet_detected", "confidence")


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query
def write_incidents(spark, sf_dir):
    """Current state of every incident, read back from a table that batches of event records were merged into, one of them twice."""
    events = materialize(_dst_events(spark, sf_dir), "events")
    table = VersionedTable(spark, _folder(spark, "incidents"))
    for batch_id, upto in ((0, 630), (1, 660), (1, 660), (2, 100_000)):
        low = {0: -1, 1: 630, 2: 660}[batch_id]
        sinks.upsert_incidents(table, events.filter((F.col("tick") > low) & (F.col("tick") <= upto)), batch_id)
    return table.read().select("key", "started_tick", "event", "tick", "peak_pps", "peak_bps")


@query
def baseline_snapshot(spark, sf_dir):
    """Detection resumed at tick 450 from the state of the first half, saved and loaded again."""
    per_dst = measures.dst_measures(w.flows(spark, sf_dir)).select("dst_ip", "tick", "pps", "bps")
    path = _folder(spark, "baselines")
    sinks.save_baselines(detect.final_states(detect.detect_dst(per_dst.filter("tick < 450"))), path)
    saved = sinks.load_baselines(spark, path, F.lit(450))
    last = w.flows(spark, sf_dir).agg(F.max("tick").alias("t")).select("t").scalar()
    resumed = detect.detect_dst(per_dst.filter("tick >= 450"), last, saved=saved)
    return detect.events_only(resumed).withColumn("avg_pps", F.round("avg_pps", 6)).drop("snap_tick")


# --- live ------------------------------------------------------------------

def _to_table(spark, rows):
    """What a stream appends until its input ends."""
    folder = _folder(spark, "stream")
    running = (rows.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows")
               .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start())
    running.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


@query
def stream_l7(spark, sf_dir):
    """The trailing request statistics as a stream over the requests: all windows that the watermark has passed."""
    return _to_table(spark, live_measures.stream_l7(w.live_http(spark, sf_dir))).drop("ts")


@query
def stream_measures(spark, sf_dir):
    """The destination measures as a stream over the flows: all seconds that the watermark has passed."""
    found = _to_table(spark, live_measures.stream_measures(w.live_flows(spark, sf_dir), ["dst_ip"]))
    return found.select("dst_ip", "tick", "packets", "octets", "flow_count", "tcp_packets", "udp_packets", "icmp_packets", "other_packets",
                        "syn", "ack", "rst", "fin", "psh", "urg", "pps", "bps", "tcp_pct", "udp_pct", "icmp_pct", "fragment_pct", "avg_pkt_size")


# Seconds in which a live run reads its input, stops and goes on from its checkpoint.
LIVE_PARTS = (0, 610, 640)


@contextmanager
def _keyed_state(spark):
    """The state store that typed keyed state needs, while a live query runs."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, live_detect.STATE_STORE[provider])
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(provider)
        else:
            spark.conf.set(provider, before)


def _live(spark, rows, key, detector, sink):
    """Runs a live detector over per-second rows that arrive in parts; each part is one run that resumes the last one's state.

    A last row of a key of its own moves the watermark past the last second, as a clock does where some destination always sends.
    """
    folder = _folder(spark, "live")
    rows = materialize(rows.withColumn("ts", F.timestamp_seconds("tick")), "live-rows")
    last = rows.agg(F.max("tick").alias("t")).select("t").scalar()
    given = {key: F.lit(""), "ts": F.timestamp_seconds(last + 3.5), "tick": last + 3}
    clock = spark.range(1).select(*[given.get(f.name, F.lit(0)).cast(f.dataType).alias(f.name) for f in rows.schema])
    with _keyed_state(spark):
        for k, low in enumerate(LIVE_PARTS):
            part = rows.filter(F.col("tick") >= low)
            part = part.filter(F.col("tick") < LIVE_PARTS[k + 1]) if k + 1 < len(LIVE_PARTS) else part.unionByName(clock)
            part.write.parquet(f"{folder}/in/part={k}")
            stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in/part=*")
            running = (detector(stream).filter(F.col("key") != "").writeStream.outputMode("append").foreachBatch(sink(folder))
                       .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start())
            running.awaitTermination()
    return folder


def _live_events(spark, rows, key, detector, schema):
    folder = _live(spark, rows, key, detector, lambda folder: sinks.incident_sink(f"{folder}/out"))
    return spark.read.schema(schema).parquet(f"{folder}/out/batch=*")


def _live_dst_rows(spark, sf_dir):
    return measures.dst_measures(w.flows(spark, sf_dir)).select("dst_ip", "tick", "pps", "bps")


@query
def stream_detect_dst(spark, sf_dir):
    events = _live_events(spark, _live_dst_rows(spark, sf_dir), "dst_ip", live_detect.stream_detect_dst, schemas.DETECTION_EVENTS)
    return events.withColumn("avg_pps", F.round("avg_pps", 6)).drop("snap_tick")


@query
def stream_detect_node(spark, sf_dir):
    events = _live_events(spark, _node_rows(spark, sf_dir), "node_id", live_detect.stream_detect_node, schemas.DETECTION_EVENTS)
    return events.withColumn("avg_pps", F.round("avg_pps", 6)).drop("snap_tick")


@query
def stream_detect_http(spark, sf_dir):
    stats = l7.l7_window_stats(w.http(spark, sf_dir)).select("site_id", "tick", *live_detect.HTTP_INPUTS)
    return _live_events(spark, stats, "site_id", live_detect.stream_detect_http, schemas.HTTP_EVENTS)


@query
def absent_ticks(spark, sf_dir):
    """Incidents that end live because their destination falls silent: every second without traffic counts down.

    Export is lost for two of the attacked destinations in the middle of their floods.
    """
    rows = _live_dst_rows(spark, sf_dir).filter("NOT (tick BETWEEN 630 AND 655 AND dst_ip IN ('192.0.2.3', '192.0.2.200'))")
    events = _live_events(spark, rows, "dst_ip", live_detect.stream_detect_dst, schemas.DETECTION_EVENTS)
    return events.filter("event = 'resolve' AND snap_tick IS NULL").select("key", "started_tick", "tick", "peak_pps", "peak_bps")


@query
def stream_incidents(spark, sf_dir):
    """Current state of every incident, read back from the table that the live detector's batches are merged into."""
    folder = _live(spark, _live_dst_rows(spark, sf_dir), "dst_ip", live_detect.stream_detect_dst,
                   lambda folder: sinks.incident_table_sink(f"{folder}/incidents"))
    return VersionedTable(spark, f"{folder}/incidents").read().select("key", "started_tick", "event", "tick", "peak_pps", "peak_bps")


@query
def stream_asof_templates(spark, sf_dir):
    """Flows of mixed datagrams that arrive in parts, decoded by the templates and scaled by the rates of earlier ones and their own."""
    folder = _folder(spark, "templates")
    sent = materialize(encoded.mixed_datagrams(spark, sf_dir), "datagrams")
    with _keyed_state(spark):
        for k, low in enumerate(LIVE_PARTS):
            upto = LIVE_PARTS[k + 1] if k + 1 < len(LIVE_PARTS) else None
            part = sent.filter((F.col("tick") >= low) & (F.col("tick") < upto if upto else F.lit(True)))
            part.write.parquet(f"{folder}/in/part={k}")
            stream = spark.readStream.schema(sent.schema).parquet(f"{folder}/in/part=*")
            running = (live_templates.stream_resolved(stream).writeStream.outputMode("append").format("parquet").option("path", f"{folder}/resolved")
                       .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start())
            running.awaitTermination()
    flows = live_templates.decode_resolved(spark.read.schema(live_templates.RESOLVED).parquet(f"{folder}/resolved"))
    return flows.select("exporter_ip", "tick", *FLOW_FIELDS)

from pyspark.sql import functions as F

from trafficlens.functions import classify

FAMILY_ROWS = [
    # tcp, udp, icmp, other, syn, dns, fragments, family
    (10.0, 80.0, 10.0, 0.0, 0.0, False, 0.0, "udp_flood"),
    (70.0, 10.0, 5.0, 0.0, 0.8, False, 0.0, "syn_flood"),
    (10.0, 10.0, 50.0, 0.0, 0.0, False, 0.0, "icmp_flood"),
    (10.0, 80.0, 5.0, 0.0, 0.0, True, 0.0, "dns_flood"),
    (45.0, 45.0, 5.0, 0.0, 0.0, False, 0.0, "multi_vector"),
    (10.0, 10.0, 10.0, 0.0, 0.0, False, 65.0, "fragment_flood"),
    (5.0, 5.0, 5.0, 50.0, 0.0, False, 0.0, "protocol_flood"),
    (60.0, 10.0, 5.0, 0.0, 0.1, False, 0.0, "tcp_flood"),
    (60.0, 10.0, 5.0, 0.0, 0.49, False, 0.0, "syn_flood"),
    (33.0, 33.0, 33.0, 0.0, 0.0, False, 0.0, "icmp_flood"),
    (4.0, 4.5, 3.0, 0.0, 0.0, False, 0.0, "udp_flood"),
    (1.0, 1.0, 2.0, 3.0, 0.0, False, 0.0, "protocol_flood"),
    (0.0, 0.0, 0.0, 0.0, 0.0, False, 0.0, "unknown"),
]


def test_family_truth_table(spark):
    rows = spark.createDataFrame(FAMILY_ROWS, "tcp double, udp double, icmp double, other double, syn double,"
                                              " dns boolean, frag double, expected string")
    found = rows.withColumn("found", classify.classify_attack(
        F.col("tcp"), F.col("udp"), F.col("icmp"), F.col("syn"), F.col("dns"), F.col("other"), F.col("frag")))
    assert found.filter("found <> expected").collect() == []


SUBTYPE_ROWS = [
    # family, dst port, src port, mean size, fragments, flags, subtype
    ("udp_flood", 80, 123, 468.0, 0.0, (0, 0, 0, 0, 0, 0), "ntp_amplification"),
    ("udp_flood", 53, 1900, 468.0, 0.0, (0, 0, 0, 0, 0, 0), "ssdp_amplification"),
    ("udp_flood", 443, 0, 1200.0, 0.0, (0, 0, 0, 0, 0, 0), "quic_flood"),
    ("udp_flood", 443, 0, 1400.0, 0.0, (0, 0, 0, 0, 0, 0), "amplification_generic"),
    ("udp_flood", 7, 7, 60.0, 0.0, (0, 0, 0, 0, 0, 0), "small_packet_flood"),
    ("udp_flood", 7, 7, 0.0, 0.0, (0, 0, 0, 0, 0, 0), "volumetric"),
    ("udp_flood", 53, 53, 60.0, 31.0, (0, 0, 0, 0, 0, 0), "udp_fragment_flood"),
    ("syn_flood", 80, 0, 60.0, 0.0, (100, 0, 0, 0, 0, 0), "syn_flood"),
    ("syn_flood", 80, 0, 60.0, 0.0, (50, 50, 0, 0, 0, 0), "syn_ack_flood"),
    ("tcp_flood", 80, 0, 60.0, 0.0, (0, 100, 0, 0, 0, 0), "ack_flood"),
    ("tcp_flood", 80, 0, 60.0, 0.0, (0, 0, 0, 0, 0, 0), "tcp_generic"),
    ("tcp_flood", 80, 0, 60.0, 0.0, (0, 0, 100, 0, 0, 0), "rst_flood"),
    ("tcp_flood", 80, 0, 60.0, 0.0, (0, 0, 0, 30, 30, 30), "xmas_flood"),
    ("tcp_flood", 80, 0, 60.0, 0.0, (0, 0, 0, 0, 0, 100), "null_flood"),
    ("tcp_flood", 80, 0, 60.0, 0.0, (0, 0, 0, 80, 10, 0), "fin_flood"),
    ("tcp_flood", 80, 0, 60.0, 0.0, (20, 40, 0, 0, 40, 0), "psh_ack_flood"),
    ("multi_vector", 80, 123, 60.0, 0.0, (0, 0, 0, 0, 0, 0), "multi_ntp_amplification"),
    ("multi_vector", 80, 161, 60.0, 0.0, (0, 0, 0, 0, 0, 0), "multi_mixed"),
    ("multi_vector", 80, 0, 60.0, 0.0, (0, 0, 100, 0, 0, 0), "multi_rst_flood"),
    ("dns_flood", 53, 0, 600.0, 0.0, (0, 0, 0, 0, 0, 0), "dns_amplification"),
    ("dns_flood", 53, 0, 60.0, 0.0, (0, 0, 0, 0, 0, 0), "dns_query_flood"),
    ("icmp_flood", 0, 0, 1400.0, 0.0, (0, 0, 0, 0, 0, 0), "ping_of_death"),
    ("icmp_flood", 0, 0, 64.0, 0.0, (0, 0, 0, 0, 0, 0), "ping_flood"),
    ("protocol_flood", 0, 0, 64.0, 0.0, (0, 0, 0, 0, 0, 0), "gre_flood"),
    ("fragment_flood", 0, 0, 64.0, 0.0, (0, 0, 0, 0, 0, 0), "ip_fragment_flood"),
    ("unknown", 53, 11211, 64.0, 0.0, (0, 0, 0, 0, 0, 0), "memcached_amplification"),
    ("unknown", 80, 80, 64.0, 0.0, (0, 0, 0, 0, 0, 0), ""),
    ("other", 80, 80, 64.0, 0.0, (0, 0, 0, 0, 0, 0), ""),
]


def test_subtype_truth_table(spark):
    names = ("syn", "ack", "rst", "fin", "psh", "urg")
    rows = spark.createDataFrame([(f, d, s, a, g, *flags, e) for f, d, s, a, g, flags, e in SUBTYPE_ROWS],
                                 "family string, dport bigint, sport bigint, size double, frag double, "
                                 + ", ".join(f"{n} bigint" for n in names) + ", expected string")
    found = rows.withColumn("found", classify.classify_subtype(
        F.col("family"), F.col("dport"), {n: F.col(n) for n in names}, F.col("size"), F.col("sport"), F.col("frag")))
    assert [tuple(r) for r in found.filter("found <> expected OR found IS NULL").collect()] == []


def test_intelligence_names(spark):
    rows = spark.createDataFrame([
        ("Mirai:botnet", 40, "unknown", "", "botnet", "mirai_botnet", "Mirai", 30),
        ("NTP Monlist:unknown", 2, "unknown", "volumetric", "unknown", "ntp_amplification", None, 2),
        ("LOIC:tool", 3, "udp_flood", "dns_amplification", "udp_flood", "dns_amplification", "LOIC", 3),
        (None, None, "udp_flood", "volumetric", "udp_flood", "volumetric", None, 0),
        ("Other", 1, "unknown", "x", "unknown", "x", None, 1),
    ], "hit string, n bigint, family string, subtype string, f string, s string, t string, b bigint")
    found = rows.withColumn("e", classify.enrich_from_ioc(F.col("hit"), F.col("n"), F.col("family"), F.col("subtype")))
    for row in found.collect():
        assert (row.e.family, row.e.subtype, row.e.tool, row.e.boost) == (row.f, row.s, row.t, row.b)


L7_ROWS = [
    # total, rps, ips, error, h2, h3, 499, 4xx, rps per ip, path, path count, subtype
    (0, 0.0, 0, 0.0, 0.0, 0.0, 0, 0, 0.0, "", 0, "l7_flood"),
    (1000, 300.0, 5, 50.0, 50.0, 0.0, 300, 300, 60.0, "/", 10, "h2_rapid_reset"),
    (9000, 900.0, 4, 0.0, 50.0, 0.0, 0, 0, 225.0, "/", 10, "h2_settings_flood"),
    (1500, 150.0, 1, 50.0, 50.0, 0.0, 0, 750, 150.0, "/", 10, "h2_continuation_flood"),
    (4000, 400.0, 6, 0.0, 0.0, 40.0, 0, 0, 66.0, "/", 10, "quic_flood"),
    (60, 6.0, 2, 0.0, 0.0, 0.0, 0, 0, 3.0, "/", 10, "single_source_abuse"),
    (100, 10.0, 9, 60.0, 0.0, 0.0, 0, 60, 1.0, "/LOGIN", 60, "credential_stuffing"),
    (100, 10.0, 9, 0.0, 0.0, 0.0, 0, 0, 1.0, "/a", 80, "scraping"),
    (100, 10.0, 9, 30.0, 0.0, 0.0, 0, 0, 1.0, "/api/x", 40, "api_abuse"),
    (100, 10.0, 30, 70.0, 0.0, 0.0, 0, 0, 1.0, "/a", 40, "slow_rate"),
    (6000, 600.0, 30, 30.0, 0.0, 0.0, 0, 0, 1.0, "/a", 40, "volumetric_flood"),
    (100, 10.0, 9, 30.0, 0.0, 0.0, 0, 0, 1.0, "/a", 40, "l7_flood"),
]


def test_web_subtypes(spark):
    rows = spark.createDataFrame(L7_ROWS, "total bigint, rps double, ips bigint, err double, h2 double, h3 double, s499 bigint,"
                                          " s4 bigint, per double, path string, n bigint, expected string")
    names = ("total", "rps", "ips", "err", "h2", "h3", "s499", "s4", "per", "path", "n")
    found = rows.withColumn("found", classify.classify_l7_subtype(*[F.col(n) for n in names]))
    assert [tuple(r) for r in found.filter("found <> expected").collect()] == []

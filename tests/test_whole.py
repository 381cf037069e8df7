"""Results that limits inside an operator would cut."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check_oracles import compare, connect
from trafficlens.operators import detect, evidence, joins, l7
from trafficlens.plans import flood

SF = "/root/testdata/sf0.001"


def test_evidence_of_any_age(spark):
    packets = spark.createDataFrame([("d", t, 1) for t in (5, 700, 950, 1000, 1003, 1010)] + [("e", 990, 1)], "dst_ip string, tick long, n int")
    incidents = spark.createDataFrame([("d", "d@1000", 1000, 1005)], "dst_ip string, incident_id string, started_tick long, ended_tick long")

    def found(**limits):
        return sorted((r.phase, r.position, r.tick) for r in joins.incident_evidence(packets, incidents, ["tick"], **limits).collect())

    during = [("during", 1, 1000), ("during", 2, 1003)]
    assert found() == [("before", 1, 950), ("before", 2, 700), ("before", 3, 5)] + during
    assert found(before=2) == [("before", 1, 950), ("before", 2, 700)] + during
    assert found(look_back=60) == [("before", 1, 950)] + during
    assert found(look_back=0) == during


def test_curve_has_all_points(spark):
    events = spark.range(2500).selectExpr("'k' AS key", "0L AS started_tick", "id AS tick", "if(id = 0, 'open', 'update') AS event", "1.0D AS pps")
    assert len(detect.event_curve(events).collect()[0].velocity_curve) == 2500


def test_a_path_below_the_top_of_every_window_counts(spark):
    # 25 paths of two requests at each tick of their own, and one of a single request at every tick
    rows = [("s", 20 * k, f"/p{k:02}") for k in range(25) for _ in range(2)] + [("s", t, "/steady") for t in range(500)] + [("s", 95, "/z"), ("s", 205, "/z")]
    rows += [("s", t, f"/w{t}-{j}") for t in range(0, 500, 5) for j in range(30) for _ in range(20)]
    requests = spark.createDataFrame(rows, "site_id string, tick long, path string")
    incidents = spark.createDataFrame([("s", "i", 100, 200)], "site_id string, incident_id string, started_tick long, ended_tick long")
    found = l7.l7_attack_items(requests, incidents, "path", 1).collect()
    expected = sum(1 for t in range(500) for w in range(t, t + 10) if 100 <= w <= 200)
    assert [(r.path, r.window_summed, r.exact_count, r["rank"]) for r in found] == [("/steady", expected, 101, 1)]
    whole = {r.path: (r.window_summed, r.exact_count) for r in l7.l7_attack_items(requests, incidents, "path", None).collect()}
    assert whole["/z"] == (5, 0)
    listed = l7.l7_attack_listed_items(l7.l7_top_items(requests, "path", 20), incidents, "path", 20)
    assert "/steady" not in {r.path for r in listed.collect()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", ["incident_evidence", "incident_evidence_limited", "incident_evidence_any_age", "l7_attack_top_paths", "l7_attack_whole_paths"])
def test_query(spark, name):
    outcome = compare(spark, connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert outcome.startswith("ok"), outcome


def test_deep_sample_spreads_one_second_of_a_node(spark):
    rows = spark.range(20_000).selectExpr("CASE WHEN id % 50 = 0 THEN 'b' END AS other", "CASE WHEN id % 50 = 0 THEN 'b' ELSE 'a' END AS node_id",
                                          "CAST(3 AS bigint) AS tick", "(id * 7919) % 20000 AS ord", "id AS n")
    advisory = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(advisory)
    spark.conf.set(advisory, "false")  # several ranges for one second
    try:
        kept = evidence.deep_sample(rows, order=("ord",))
        assert kept.columns == rows.columns
        got = sorted(map(tuple, kept.select("node_id", "ord").collect()))
    finally:
        spark.conf.set(advisory, before)
    want = []
    for node in "ab":
        orders = sorted(r.ord for r in rows.filter(F.col("node_id") == node).select("ord").collect())
        want += [(node, o) for o in orders[9::10]]
    assert got == sorted(want)
    assert evidence.deep_sample(rows.limit(0), order=("ord",)).count() == 0


def test_report_takes_hits_and_signatures_of_the_incident_alone(spark):
    packets = spark.createDataFrame([("d", t, f"10.0.0.{k}", 1000 + k, 80, 6, 60, 2, 64, False, None) for t in (*range(10, 20), *range(110, 120)) for k in range(3)],
                                    "dst_ip string, tick bigint, src_ip string, src_port bigint, dst_port bigint, protocol bigint, pkt_len bigint, "
                                    "tcp_flags bigint, ttl bigint, is_fragment boolean, dns_qname string")
    incidents = spark.createDataFrame([(f"d@{s}", "d", s, s + 9, 9, 3.0, 3.0, 1.0) for s in (10, 110, 210)],
                                      "incident_id string, dst_ip string, started_tick bigint, ended_tick bigint, duration bigint, peak_pps double, peak_bps double, threshold double")
    hits = spark.createDataFrame([("d", 12, "Mirai:botnet"), ("d", 19, "Mirai:botnet"), ("d", 20, "Gafgyt:botnet"), ("d", 115, "Scanner:unknown"),
                                  ("e", 12, "Gafgyt:botnet")], "dst_ip string, tick bigint, ioc_hit string")
    signatures = spark.createDataFrame([("d", t, "memcached", 3) for t in (110, 111, 300)], "dst_ip string, tick bigint, signature string, count bigint")
    curves = spark.createDataFrame([], "incident_id string, velocity_curve array<double>")
    found = {r.incident_id: r for r in flood.incident_report(packets, incidents, hits, signatures, curves).collect()}
    assert [found[f"d@{s}"].distinct_hits for s in (10, 110, 210)] == [["Mirai:botnet"], ["Scanner:unknown"], None]
    assert [found[f"d@{s}"].botnet_detected for s in (10, 110)] == [True, False]
    assert found["d@10"].attack_tool != found["d@110"].attack_tool

"""Registered queries against their oracle SQL at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from check_oracles import compare, connect

SF = "/root/testdata/sf0.001"
FAST = ("dst_measures", "node_measures", "top_src_ips", "rolling_baseline", "hourly_baseline", "asof_join", "l7_window_stats",
        "source_confidence", "detect_dst", "detect_node", "detect_http", "sustained_floods", "incident_evidence", "deep_sample",
        "nonservice_sources", "gre_overhead", "enrich_from_ioc", "resolve_family_subtype", "dst_report", "incident_report", "write_incidents",
        "baseline_snapshot", "l7_baseline", "l7_attack_lists", "scan_large_pcap", "incident_confidence", "correlate_l3_l7", "velocity_curve", "absent_ticks", "stream_incidents", "stream_asof_templates")
NAMES = list(entry.queries()) if os.environ.get("ALL_QUERIES") else FAST

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    outcome = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert outcome.startswith(("ok", "rows")), outcome


def test_every_query_has_an_oracle():
    assert set(entry.QUERIES) == set(entry.ORACLES)


def test_entry(spark):
    rows = {(r.dst_ip, r.family) for r in entry.entry(spark).collect()}
    assert ("192.0.2.3", "syn_flood") in rows and ("192.0.2.7", "udp_flood") in rows
    assert "192.0.2.200" in {ip for ip, _ in rows}  # without any traffic before the flood

"""Ordered passes and interval joins against plain loops."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from trafficlens.operators import baseline, joins, l7, sweep

SPANS = "node_id string, incident_id string, started_tick long, ended_tick long"


def test_open_spans_of_a_key_with_ten_thousand(spark):
    rng = random.Random(5)
    spans = [("a", f"s{i}", s := rng.randrange(100_000), s + rng.randrange(-3, 900)) for i in range(10_000)]
    spans += [("b", "open", 500, None), (None, "none", 0, 10**6), ("c", "equal", 7, 7)]
    asked = [("a", f"h{i}", rng.randrange(101_000), None) for i in range(500)]
    asked += [("b", "early", 499, None), ("b", "late", 10**6, None), (None, "nobody", 5, None), ("c", "at", 7, None), ("c", "after", 8, None),
              ("d", "other", 9, None), ("a", "untimed", None, None)]
    found = {r.incident_id: r.open_spans for r in sweep.open_spans(
        spark.createDataFrame(asked, SPANS), spark.createDataFrame(spans, SPANS), "node_id").collect()}
    expected = {name: sum(k is not None and k == key and at is not None and a <= at and (b is None or at <= b) for k, _, a, b in spans)
                for key, name, at, _ in asked}
    assert found == expected and found["late"] == 1 and max(found.values()) > 20
    flags = joins.correlate_l3_l7(spark.createDataFrame(asked, SPANS), spark.createDataFrame(spans, SPANS))
    assert {r.incident_id: r.correlated_l3l4 for r in flags.collect()} == {name: n > 0 for name, n in expected.items()}
    assert flags.columns == ["node_id", "incident_id", "started_tick", "ended_tick", "correlated_l3l4"]


def test_open_spans_of_empty_tables(spark):
    none = spark.createDataFrame([], SPANS)
    one = spark.createDataFrame([("a", "h", 5, None)], SPANS)
    assert sweep.open_spans(none, one, "node_id").count() == 0
    assert [r.open_spans for r in sweep.open_spans(one, none, "node_id").collect()] == [0]


def test_no_join_is_on_the_key_alone(spark):
    spans = spark.createDataFrame([("a", "s", 1, 5)], SPANS)
    rows = spark.createDataFrame([("a", 3, 1.0)], "node_id string, tick long, pps double")
    for df in (sweep.within(rows, spans, "node_id"), sweep.open_spans(spans, spans, "node_id")):
        joined = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
        assert joined and all("_slot" in line for line in joined), joined


@pytest.mark.parametrize("width", [1, 7, 60, 100_000])
def test_within_any_slots(spark, width):
    rng = random.Random(width)
    spans = [(rng.choice("ab"), f"s{i}", s := rng.randrange(-50, 300), s + rng.randrange(-5, 150)) for i in range(60)] + [("a", "open", 5, None)]
    ticks = [(rng.choice("abc"), rng.randrange(-60, 400), i) for i in range(300)] + [("a", None, 999)]
    rows = spark.createDataFrame(ticks, "node_id string, tick long, n int")
    found = sorted((r.incident_id, r.n) for r in sweep.within(rows, spark.createDataFrame(spans, SPANS), "node_id", width=width).collect())
    assert found == sorted((i, n) for k, i, a, b in spans for key, t, n in ticks if key == k and t is not None and b is not None and a <= t <= b)


@pytest.mark.parametrize("limits", [{}, {"during": 7, "before": 4}, {"before": 40, "look_back": 25}, {"look_back": 0}, {"during": 1, "before": 0}])
def test_evidence_against_loops(spark, limits):
    rng = random.Random(len(limits))
    packets = [(rng.choice("ddde"), rng.randrange(200), i) for i in range(400)] + [("d", None, 1000), (None, 50, 1001)]
    spans = [(rng.choice("de"), f"s{i}", s := rng.randrange(-10, 210), s + rng.randrange(-2, 40)) for i in range(25)]
    spans += [("d", "open", 100, None), ("quiet", "nothing", 1, 5)]
    found = joins.incident_evidence(spark.createDataFrame(packets, "dst_ip string, tick long, n int"),
                                    spark.createDataFrame(spans, SPANS.replace("node_id", "dst_ip")), ["tick", "n"], block=16, **limits)
    expected = []
    for key, name, a, b in spans:
        mine = sorted((t, n) for k, t, n in packets if k == key and t is not None)
        inside = [p for p in mine if b is not None and a <= p[0] <= b][:limits.get("during")]
        prior = [p for p in reversed(mine) if p[0] < a and a - p[0] <= limits.get("look_back", 10**9)][:limits.get("before")]
        expected += [(name, "during", i, n) for i, (_, n) in enumerate(inside, 1)] + [(name, "before", i, n) for i, (_, n) in enumerate(prior, 1)]
    assert sorted((r.incident_id, r.phase, r.position, r.n) for r in found.collect()) == sorted(expected)


def test_places_of_a_hot_key(spark):
    rows = spark.range(5000).selectExpr("IF(id % 100 = 0, 'b', 'a') AS k", "(id * 7919) % 5000 AS ord")
    found = sweep.placed(rows, "k", ["ord"], "place").collect()
    for key in "ab":
        mine = sorted((r.ord, r.place) for r in found if r.k == key)
        assert [place for _, place in mine] == list(range(1, len(mine) + 1))


def test_percentiles_with_ties_and_null_rates(spark):
    rng = random.Random(2)
    values = [None if i % 17 == 3 else float(rng.randrange(5)) for i in range(200)]
    rows = spark.createDataFrame([("k", t, v, v) for t, v in enumerate(values)] + [("k", None, 9e9, 9e9), (None, 1, 5.0, 5.0)],
                                 "key string, tick long, pps double, bps double")
    got = {r.tick: r for r in baseline.rolling_baseline(rows, "key", window=30).filter("key = 'k'").collect()}
    assert len(got) == 200
    for t in range(10, 200, 10):
        known = sorted([v for v in values[:t + 1] if v is not None][-30:])
        assert (got[t].p95_pps, got[t].p99_pps) == tuple(known[min(len(known) * p // 100, len(known) - 1)] for p in (95, 99))
        assert got[t].avg_bps == pytest.approx(statistics.fmean(known)) and got[t].avg_pps == got[t].avg_bps
        assert t + 9 not in got or got[t + 9].p99_pps == got[t].p99_pps
    assert baseline.rolling_baseline(rows.limit(0), "key").count() == 0


def test_learned_request_rate(spark):
    schema = "site_id string, tick long, rps double, total_requests long, error_rate double, under_attack boolean"
    rows = [("s", 0, 10.0, 100, 0.0, False), ("s", 1, 20.0, 100, 0.0, False), ("s", 2, 900.0, 14, 0.0, False), ("s", 3, 30.0, 100, 60.0, False),
            ("s", 4, 30.0, 15, 59.9, False), ("s", 5, 200.0, 100, 0.0, False), ("s", 6, 199.9, 100, 0.0, True), ("s", 7, 199.0, 100, 0.0, False),
            ("s", 8, None, 100, 0.0, False), ("s", 9, 1.0, None, 0.0, False), ("t", 5, 7.0, 50, 1.0, False)]
    found = {(r.site_id, r.tick): (r.clean, r.samples, round(r.baseline_rps, 6)) for r in l7.l7_baseline(spark.createDataFrame(rows, schema)).collect()}
    assert [found["s", t] for t in range(10)] == [
        (True, 1, 10.0), (True, 2, 15.0), (False, 2, 15.0), (False, 2, 15.0), (True, 3, 20.0), (False, 3, 20.0), (False, 3, 20.0),
        (True, 4, 64.75), (False, 4, 64.75), (False, 4, 64.75)]
    assert found["t", 5] == (True, 1, 7.0)
    steady = spark.range(400).selectExpr("'s' AS site_id", "id AS tick", "IF(id < 300, 100D, 200D) AS rps", "50L AS total_requests", "0D AS error_rate")
    last = l7.l7_baseline(steady).orderBy(F.col("tick").desc()).first()
    assert last.samples == 400 and last.baseline_rps == pytest.approx(200 - 100 * 0.99**100)


def test_lists_of_whole_attacks(spark):
    schema = "site_id string, tick long, path string, ip string, ua string"
    rows = [("s", t, f"/p{t % 3}", "10.0.0.1", None) for t in range(80, 130)] + [("s", 100, "/.env?x=../", "10.0.0.2", ""), ("s", 95, "/wp-login.php", None, "curl/8"),
            ("s", 300, "/.env", "10.0.0.9", "late"), ("t", 100, "/other", "10.0.0.3", "x"), ("s", None, "/never", "10.0.0.4", "x"), ("s", 101, None, "10.0.0.2", "b")]
    requests = spark.createDataFrame(rows, schema)
    incidents = spark.createDataFrame([("s", "i", 100, 104), ("s", "j", 100, 100), ("s", "open", 100, None)], SPANS.replace("node_id", "site_id"))

    def counts(first, last, kind, item):
        mine = [r for r in rows if r[0] == "s" and r[1] is not None and item(r)]
        return (sum(first <= w <= last for r in mine for w in range(r[1], r[1] + 10)), sum(first <= r[1] <= last for r in mine))

    found = {(r.incident_id, r.kind, r["item"]): (r.window_summed, r.exact_count) for r in l7.l7_attack_lists(requests, incidents).collect()}
    for name, last in (("i", 104), ("j", 100)):
        assert found[name, "ip", "10.0.0.1"] == counts(100, last, "ip", lambda r: r[3] == "10.0.0.1")
        assert found[name, "path", "/p1"] == counts(100, last, "path", lambda r: r[2] == "/p1")
        assert found[name, "ua", "curl/8"] == counts(100, last, "ua", lambda r: r[4] == "curl/8")
        assert found[name, "threat", "path_traversal"] == found[name, "threat", "scanner_probe"] == counts(100, last, "", lambda r: r[2] == "/.env?x=../")
        assert found[name, "threat", "wordpress"][1] == 0 and found[name, "threat", "wordpress"][0] > 0
    assert {k[0] for k in found} == {"i", "j"} and not {k[2] for k in found} & {"/never", "/other", "late", "", None}
    few = l7.l7_attack_lists(requests, incidents, {"path": 1, "threat": 2}).collect()
    assert sorted((r.incident_id, r.kind, r["rank"]) for r in few) == sorted([(i, "path", 1) for i in "ij"] + [(i, "threat", n) for i in "ij" for n in (1, 2)])

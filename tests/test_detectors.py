import pytest
from pyspark.sql import functions as F

from trafficlens.operators import baseline, detect
from trafficlens.operators.detector_steps import (Baseline, BaselineRules, DstDetector, HttpDetector, NodeDetector, Row)


def fed(values, window=300):
    b = Baseline(BaselineRules(window=window))
    for tick, value in enumerate(values):
        b.learn(tick, float(value), 0.0)
    return b


def test_baseline_sequences():
    assert fed([1000] * 50, 50).ready and fed([1000] * 50, 50).threshold >= 5000
    assert fed([10000] * 50, 50).threshold >= 25000
    assert fed(range(0, 2000, 100), 10).s["avg_pps"] == pytest.approx(1450, abs=1)
    assert fed([500] * 50 + [5000] * 50, 50).threshold > fed([500] * 50, 50).threshold
    assert fed([50000] * 50 + [1000] * 400, 50).threshold < fed([50000] * 50, 50).threshold


def test_window_baseline_equals_stepwise(spark):
    import random

    rng = random.Random(3)
    series = {k: [(t, float(rng.randrange(1, 9000)), float(rng.randrange(1, 10**8)))
                  for t in sorted(rng.sample(range(2000), 700))] for k in ("a", "b")}
    rows = spark.createDataFrame([(k, *r) for k, rs in series.items() for r in rs],
                                 "key string, tick bigint, pps double, bps double")
    rules = BaselineRules(window=40, hour_window=70, hour_min=20, hour_seconds=300)
    got = {(r.key, r.tick): r for r in baseline.rolling_baseline(
        rows, "key", window=40, hour_seconds=300, hour_window=70, hour_min=20).collect()}
    for k, rs in series.items():
        b = Baseline(rules)
        for t, pps, bps in rs:
            b.learn(t, pps, bps)
            r = got[k, t]
            assert (r.threshold, r.p99_pps, r.ready, r.bps_threshold) == (
                b.threshold, b.s["p99_pps"], b.ready, b.s["bps_threshold"])
            assert r.avg_pps == pytest.approx(b.s["avg_pps"]) and r.avg_bps == pytest.approx(b.s["avg_bps"])


def run(machine, values, start=0):
    return [e for t, v in enumerate(values, start) for e in machine.step(Row(t, float(v), float(v) * 800))]


def test_node_confirms_three_ticks_and_holds_down():
    events = run(NodeDetector(), [100] * 320 + [20000] * 6 + [100] * 12)
    assert [(e[0], e[1]) for e in events if e[0] != "update"] == [("open", 322), ("resolve", 335)]
    assert events[0][5] == 20000.0


def test_node_two_tick_spike_is_ignored_and_not_learned():
    node = NodeDetector()
    assert run(node, [100] * 320 + [20000] * 2 + [100] * 20) == []
    assert node.base.threshold == 5000.0


def test_node_massive_flood_opens_at_once_even_in_grace():
    assert run(NodeDetector(), [100] * 5 + [60000])[0][:2] == ("open", 5)
    assert run(NodeDetector(), [100] * 5 + [20000] * 5) == []


def test_node_cooldown_and_blocklist():
    again = run(NodeDetector(), [100] * 320 + [20000] * 4 + [100] * 10 + [20000] * 20)
    assert [e[0] for e in again if e[0] != "update"] == ["open", "resolve"]
    node = NodeDetector()
    run(node, [100] * 320)
    assert [e[0] for t in range(320, 325) for e in node.step(Row(t, 4000.0, 0.0, 0.5))][:1] == ["open"]


def test_destination_learns_before_it_checks():
    dst = DstDetector(rules=BaselineRules(window=10))
    assert run(dst, [100] * 15 + [10000] * 2) == []
    assert run(dst, [10000] * 2, 17)[0][0] == "open"
    quiet = DstDetector(rules=BaselineRules(window=10))
    assert run(quiet, [100] * 15 + [3000] * 2) == []


def test_destination_counts_silent_ticks():
    dst = DstDetector(rules=BaselineRules(window=10))
    run(dst, [100] * 15 + [60000] * 4)
    assert dst.s["open"]
    assert [(e[0], e[1]) for e in dst.step(Row(40, 10.0, 0.0))] == [("resolve", 28)]
    open_one = DstDetector(rules=BaselineRules(window=10))
    run(open_one, [100] * 15 + [60000] * 4)
    assert open_one.finish(22) == [] and open_one.finish(60)[0][1] == 28


def test_destination_forgets_when_idle():
    dst = DstDetector(rules=BaselineRules(window=10))
    run(dst, [100] * 15)
    dst.step(Row(1000, 100.0, 0.0))
    assert not dst.base.ready and len(dst.base.s["pps"]) == 1


def window(**changes):
    stats = dict(rps=5.0, total_requests=50, unique_ips=20, error_rate=1.0, top_ip_count=3, top_path_count=10, status_5xx=0,
                 bot_request_pct=0.0, threat_total=0)
    return {**stats, **changes}


def test_web_detector_opens_and_ends():
    site = HttpDetector()
    assert all(not site.step(t, window()) for t in range(40))
    hot = window(rps=90.0, total_requests=900, error_rate=70.0)
    assert site.step(40, hot)[0][0] == "open"
    kinds = [site.step(t, hot)[0][0] for t in range(41, 58)] + [site.step(t, window())[0][0] for t in range(58, 61)]
    assert kinds == ["update"] * 19 + ["resolve"]
    assert site.s["samples"] == 1 and site.s["rps"] == 5.0
    assert HttpDetector().step(0, window(total_requests=14, rps=9000.0)) == []
    assert HttpDetector().step(0, window(unique_ips=2, rps=9000.0)) == []


def test_batch_run_and_restart_agree(spark):
    values = [100] * 320 + [60000] * 30 + [100] * 40
    rows = spark.createDataFrame([("d", t, float(v), float(v)) for t, v in enumerate(values)],
                                 "dst_ip string, tick bigint, pps double, bps double")
    whole = detect.events_only(detect.detect_dst(rows, 500)).collect()
    first = detect.detect_dst(rows.filter("tick < 335"))
    saved = detect.restorable(detect.final_states(first), F.lit(335))
    second = detect.detect_dst(rows.filter("tick >= 335"), 500, saved=saved)
    parts = detect.events_only(first).collect() + detect.events_only(second).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts)) and len(whole) > 3
    stale = detect.restorable(detect.final_states(first), F.lit(335 + 86_401))
    assert stale.count() == 0


def test_saved_state_needs_samples(spark):
    rows = spark.createDataFrame([("d", t, 1.0, 1.0) for t in range(49)], "dst_ip string, tick bigint, pps double, bps double")
    assert detect.restorable(detect.final_states(detect.detect_dst(rows)), F.lit(60)).count() == 0

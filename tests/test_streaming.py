from pyspark.sql import functions as F

from tests.test_decoders import FIELDS, data_record, frame_of, template, v9
from trafficlens import schemas
from trafficlens.operators import detect, measures
from trafficlens.sources import sinks, tables
from trafficlens.streaming import detect as live
from trafficlens.streaming import measures as live_measures
from trafficlens.streaming import templates as live_templates


def _flows(spark, values):
    """Two destinations, one with gaps; the last row only moves the watermark."""
    rows = [(t, f"d{k}", v) for k in (1, 2) for t, v in values if k == 1 or t % 3] + [(700, "end", 1)]
    return spark.createDataFrame(rows, "tick bigint, dst_ip string, packets bigint").select(
        F.timestamp_seconds("tick").alias("ts"), "tick", F.lit("n").alias("node_id"), F.lit("e").alias("exporter_ip"),
        F.lit("1.1.1.1").alias("src_ip"), "dst_ip", F.lit(1).cast("bigint").alias("src_port"),
        F.lit(80).cast("bigint").alias("dst_port"), F.lit(6).cast("bigint").alias("protocol"), "packets",
        (F.col("packets") * 60).alias("octets"), F.lit(2).cast("bigint").alias("tcp_flags"),
        F.lit(1).cast("bigint").alias("sample_rate"))


def _finish(writer, path, name):
    query = writer.option("checkpointLocation", f"{path}/cp-{name}").trigger(availableNow=True).start()
    query.awaitTermination(200)
    assert query.exception() is None


def test_stream_equals_batch(spark, tmp_path):
    values = [(t, 100) for t in range(320)] + [(t, 60000) for t in range(320, 350)] + [(t, 100) for t in range(350, 355)] \
        + [(t, 100) for t in range(420, 430)]
    flows = _flows(spark, values)
    root = str(tmp_path)
    for n, (low, high) in enumerate([(0, 330), (330, 600), (600, 900)]):
        flows.filter((F.col("tick") >= low) & (F.col("tick") < high)).coalesce(1).write.parquet(f"{root}/in/part={n}")
        live_flows = tables.read_flows(spark, f"{root}/in/part=*", streaming=True)
        per_dst = live_measures.stream_measures(live_flows, ["dst_ip"])
        _finish(per_dst.writeStream.outputMode("append").format("parquet").option("path", f"{root}/measures"), root, "m")
        rows = spark.readStream.schema(per_dst.schema).parquet(f"{root}/measures")
        events = live.stream_detect_dst(rows)
        _finish(events.writeStream.outputMode("append").foreachBatch(sinks.incident_sink(f"{root}/out")), root, "d")
    got = spark.read.schema(schemas.DETECTION_EVENTS).parquet(f"{root}/out/batch=*")
    batch = detect.events_only(detect.detect_dst(measures.dst_measures(flows)))
    names = schemas.DETECTION_EVENTS.names
    want = sorted(map(repr, batch.filter("key <> 'end'").select(*names).collect()))
    assert sorted(map(repr, got.select(*names).collect())) == want
    assert {r.event for r in batch.collect()} == {"open", "update", "resolve"}
    state = sinks.current_incidents(got).collect()
    assert {(r.key, r.event) for r in state} == {("d1", "resolve"), ("d2", "resolve")}


def test_live_keys_that_learn_nothing(spark, tmp_path):
    """Keys that are flooded from their first second on have no samples when a run ends; one of them calms down later."""
    root = str(tmp_path)
    rows = [(k, t, 60000.0 if k == "a" or t < 40 else 10.0, 5e6, 0.0) for k in ("a", "b") for t in range(70)] + [("", 75, 0.0, 0.0, 0.0)]
    rows = spark.createDataFrame(rows, "key string, tick bigint, pps double, bps double, blocklist_ratio double")
    rows = rows.withColumn("ts", F.timestamp_seconds("tick"))
    for detector, batch in ((live.stream_detect_node, detect.detect_node), (live.stream_detect_dst, detect.detect_dst)):
        name = detector.__name__
        for n, low in enumerate((0, 20, 50)):
            rows.filter((F.col("tick") >= low) & (F.col("tick") < (20, 50, 100)[n])).coalesce(1).write.parquet(f"{root}/{name}/in/part={n}")
            stream = detector(spark.readStream.schema(rows.schema).parquet(f"{root}/{name}/in/part=*"), key="key")
            _finish(stream.writeStream.outputMode("append").foreachBatch(sinks.incident_sink(f"{root}/{name}/out")), root, name)
        got = spark.read.schema(schemas.DETECTION_EVENTS).parquet(f"{root}/{name}/out/batch=*").filter("key <> ''")
        want = detect.events_only(batch(rows.filter("key <> ''"), key="key"))
        names = schemas.DETECTION_EVENTS.names
        assert {r.key for r in got.collect()} == {"a", "b"}
        assert sorted(map(repr, got.select(*names).collect())) == sorted(map(repr, want.select(*names).collect()))


def test_live_web_windows_and_detector(spark, tmp_path):
    rows = [(t, f"10.0.0.{i % 7}", "/login", 401) for t in range(60) for i in range(3 if t < 40 else 90)]
    df = spark.createDataFrame(rows, "tick bigint, ip string, path string, status bigint").select(
        F.timestamp_seconds("tick").alias("ts"), "tick", F.lit("s").alias("site_id"), "ip", F.lit("POST").alias("method"),
        "path", "status", F.lit(1).cast("bigint").alias("size"), F.lit("curl/8").alias("ua"),
        F.lit(None).cast("double").alias("resp_time_ms"), F.lit("1.1").alias("http_version"))
    root = str(tmp_path)
    df.coalesce(1).write.parquet(f"{root}/in")
    stats = live_measures.stream_l7(tables.read_http_requests(spark, f"{root}/in", streaming=True))
    _finish(stats.writeStream.outputMode("append").format("parquet").option("path", f"{root}/l7"), root, "l7")
    rows = spark.readStream.schema(stats.schema).parquet(f"{root}/l7")
    _finish(live.stream_detect_http(rows).writeStream.outputMode("append")
            .foreachBatch(sinks.incident_sink(f"{root}/out")), root, "h")
    from trafficlens.operators import l7

    want = {r.tick: r for r in l7.l7_window_stats(df).collect()}
    got = spark.read.schema(stats.schema).parquet(f"{root}/l7").drop("ts").collect()
    assert got and all(want[r.tick] == r for r in got)
    events = spark.read.schema(schemas.HTTP_EVENTS).parquet(f"{root}/out/batch=*").collect()
    assert [e.event for e in sorted(events, key=lambda e: e.tick)][:1] == ["open"]


def _decoded_live(spark, root, payloads, ticks=None):
    """Flows of datagrams that arrive one by one, each in a run of its own."""
    rows = frame_of(spark, payloads, ticks)
    for n in range(len(payloads)):
        rows.filter(F.col("seq") == n).coalesce(1).write.parquet(f"{root}/in/part={n}")
    resolved = live_templates.stream_resolved(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/part=*"))
    _finish(resolved.writeStream.outputMode("append").format("parquet").option("path", f"{root}/resolved"), root, "r")
    return live_templates.decode_resolved(spark.read.schema(live_templates.RESOLVED).parquet(f"{root}/resolved"))


def test_stream_decoding_remembers_templates(spark, tmp_path):
    data, definition = (256, data_record()), (0, template(256, FIELDS))
    found = _decoded_live(spark, str(tmp_path), [v9(data), v9(definition), v9(data), v9(data, definition), v9(definition, data)])
    assert sorted((r.seq, r.packets) for r in found.collect()) == [(2, 10), (3, 10), (4, 10)]


def test_templates_in_use_do_not_expire(spark, tmp_path):
    data, definition = (256, data_record()), (0, template(256, FIELDS))
    found = _decoded_live(spark, str(tmp_path), [v9(definition), v9(data), v9(data), v9(data)], [0, 3000, 6000, 9700])
    assert sorted((r.seq, r.tick) for r in found.collect()) == [(1, 3000), (2, 6000)]


def test_layouts_in_force_follow_the_rows():
    """The array form against the rule, row by row: definitions, use, and templates that were idle for too long."""
    import random

    import numpy as np
    import pandas as pd

    idle = live_templates.d.TEMPLATE_IDLE_SECONDS
    rng = random.Random(11)
    for _ in range(60):
        tick, rows = 0, []
        for seq in range(rng.randrange(1, 60)):
            tick += rng.choice((0, 1, idle // 2, idle, idle + 1))
            kind = rng.choice(("ipfix", "netflow_v9", "sflow"))
            step = rng.choice((0, 1, 1, 1))
            rows.append(("e", tick, seq, kind, rng.randrange(2), 256 + rng.randrange(2), 0, step, b"x",
                         np.array([rng.randrange(4), 0]) if step == 0 else None))
        known = {(0, 256): ([9, 0], 0)} if rng.random() < 0.5 else {}
        now, want = dict(known), []
        for _, tick, _, kind, domain, template_id, _, step, _, places in rows:
            name = (domain, template_id)
            if kind == "sflow":
                want.append(None)
                continue
            if name in now and tick - now[name][1] > idle:
                del now[name]
            if step == 0:
                now[name] = (places.tolist(), tick)
            elif name in now:
                now[name] = (now[name][0], tick)
            want.append(now[name][0] if name in now else None)
        frame = pd.DataFrame(rows, columns=["exporter_ip", "tick", "seq", "kind", "domain", "template_id", "set_no", "step", "body", "places"])
        pieces = [frame.iloc[::2], frame.iloc[1::2]]  # batches need not be in order
        arrived, bodies = live_templates._in_order(iter([p for p in pieces if len(p)]))
        layout, layouts, after = live_templates._in_force(arrived, known)
        assert [None if n < 0 else layouts[n] for n in layout.tolist()] == want
        assert after == now and len(bodies) == len(rows)


def test_bundles_hold_all_rows(tmp_path):
    """A bundle for each second of an exporter; its rows come out as they went in, but for those without a place in the order."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    places = np.arange(live_templates.d.LAYOUT_SIZE, dtype=np.int64)
    rows = [("a", 3, 9, "sflow", 0, 0, 0, 0, b"xyz", None), ("a", 2, 8, "ipfix", 7, 256, 1, 1, b"", None), ("a", 3, 7, "ipfix", 7, 256, 0, 0, None, places.tobytes()),
            ("a", 3, None, "sflow", 0, 0, 0, 0, b"lost", None), ("b", 4, None, "sflow", 0, 0, 0, 0, b"lost", None), ("b", 3, 1, "netflow_v9", 7, 300, 2, 1, b"1234", None)]
    names = ["exporter_ip", "tick", "seq", "kind", "domain", "template_id", "set_no", "step", "body", "places"]
    kinds = {"exporter_ip": pa.string(), "kind": pa.string(), "body": pa.binary(), "places": pa.binary()}
    batch = pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, zip(*rows))], names=names)
    bundles = pd.concat([b.to_pandas() for b in live_templates._bundles(iter([batch.slice(0, 2), batch.slice(2)]))])
    assert sorted(zip(bundles["exporter_ip"], bundles["tick"])) == [("a", 2), ("a", 3), ("b", 3), ("b", 4)]
    for exporter in "ab":
        with open(tmp_path / exporter, "w+b") as file:
            opened, = live_templates._opened(iter([f for _, f in bundles[bundles["exporter_ip"] == exporter].groupby("tick")]), file)
        got = [(r.tick, r.seq, r.kind, r.domain, r.template_id, r.set_no, r.step, bytes(r.body), None if r.places is None else r.places.tobytes())
               for r in opened.itertuples()]
        assert sorted(got, key=str) == sorted(((t, s, k, dom, tid, n, st, b or b"", p) for e, t, s, k, dom, tid, n, st, b, p in rows if e == exporter and s), key=str)


def test_announced_rates():
    places = [8, 1] + [-1, 0] * len(live_templates._NAMES)
    places[live_templates._RATE_AT:live_templates._RATE_AT + 2] = [4, 4]
    body = b"".join(bytes(4) + n.to_bytes(4, "big") for n in (5, 7, 0))
    assert live_templates._announced(body + b"\x00" * 7, places) == 7  # the last above zero, whole records only
    assert live_templates._announced(body, [8, 1] + [-1, 0] * len(live_templates._NAMES)) == 0


def test_saved_baselines_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("d", t, 5.0, 5.0) for t in range(60)], "dst_ip string, tick bigint, pps double, bps double")
    sinks.save_baselines(detect.final_states(detect.detect_dst(rows)), str(tmp_path / "b"))
    assert sinks.load_baselines(spark, str(tmp_path / "b"), F.lit(100)).count() == 1
    assert sinks.load_baselines(spark, str(tmp_path / "b"), F.lit(100_000)).count() == 0


def test_versions_switch_when_they_are_whole(spark, tmp_path):
    from trafficlens.sources.versioned import KEPT, VersionedTable

    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.read() is None
    for n in range(6):
        rows = spark.range(n + 1) if n == 0 else table.read().union(spark.range(1))
        assert table.write(rows) == n  # reads one version and writes the next
    assert table.versions() == [6 - KEPT, 4, 5] and table.read().count() == 6
    (tmp_path / "t" / "version=5" / "_SUCCESS").unlink()  # a writer that died
    assert table.read().count() == 5 and table.write(table.read()) == 5


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    from trafficlens.sources.versioned import VersionedTable

    def records(*rows):
        return spark.createDataFrame(rows, "key string, started_tick bigint, event string, tick bigint, peak_pps double")

    table = VersionedTable(spark, str(tmp_path / "t"))
    first, second = records(("a", 1, "open", 1, 5.0), ("b", 2, "open", 2, 6.0)), records(("a", 1, "update", 6, 7.0), ("a", 1, "resolve", 6, 8.0))
    for batch_id, rows in ((0, first), (1, second), (1, second), (0, first)):
        sinks.upsert_incidents(table, rows, batch_id)
    assert sorted(map(tuple, table.read().collect())) == [("a", 1, "resolve", 6, 8.0), ("b", 2, "open", 2, 6.0)]


def test_baselines_saved_from_those_loaded(spark, tmp_path):
    rows = spark.createDataFrame([("d", t, 5.0, 5.0) for t in range(120)], "dst_ip string, tick bigint, pps double, bps double")
    path = str(tmp_path / "b")
    for low in (0, 60):
        saved = sinks.load_baselines(spark, path, F.lit(low))
        part = rows.filter((F.col("tick") >= low) & (F.col("tick") < low + 60))
        sinks.save_baselines(detect.final_states(detect.detect_dst(part, saved=saved)), path)
    whole = detect.final_states(detect.detect_dst(rows)).collect()
    assert sinks.load_baselines(spark, path, F.lit(120)).collect() == whole

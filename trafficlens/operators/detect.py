"""Batch detectors: the keyed state machines run over ordered per-tick rows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens import schemas
from trafficlens.operators.detector_steps import (HTTP_INPUTS, BaselineRules, DstDetector, HttpDetector, HttpRules,
                                                  NodeDetector, Row)

# Restoring a saved baseline: at least this many samples, at most this old.
RESTORE_MIN_SAMPLES = 50
RESTORE_MAX_AGE = 86_400


def _with_state(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("state", T.StringType())])


def _ordered(rows: DataFrame) -> DataFrame:
    """All rows of a key in one partition and in tick order, to be read as a stream.

    A task holds one Arrow batch at a time, so neither the number of keys nor the
    length of a key's history is bounded by memory. A key has one row per second.
    """
    return rows.repartition("key").sortWithinPartitions("key", "tick")


def _walk(make: Callable, feed: Callable, columns: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Runs one machine per key over an ordered partition.

    ``make(state)`` builds a machine, ``feed(machine, row)`` returns its events.
    The row tuple starts with key, tick, horizon and saved state.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = machine = horizon = None

        def close() -> list[tuple]:
            if machine is None:
                return []
            events = [(key, *event, None) for event in machine.finish(horizon)] if horizon >= 0 else []
            blank = (None,) * (len(columns) - 4)
            return [*events, (key, "state", machine.s["last"], *blank, json.dumps(machine.s))]

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch[name].tolist() for name in batch.columns)):
                if row[0] != key:
                    out += close()
                    key, horizon = row[0], row[2]
                    machine = make(json.loads(row[3]) if row[3] else None)
                    if row[3]:
                        continue
                out += [(key, *event, None) for event in feed(machine, row)]
            yield pd.DataFrame(out, columns=columns).astype(object)
        yield pd.DataFrame(close(), columns=columns).astype(object)

    return run


def _run(rows: DataFrame, make: Callable, feed: Callable, schema: T.StructType) -> DataFrame:
    full = _with_state(schema)
    return _ordered(rows).mapInPandas(_walk(make, feed, full.names), full)


def _prepare(rows: DataFrame, key: str, values: list[Column], horizon: int | Column | None,
             saved: DataFrame | None) -> DataFrame:
    end = F.lit(horizon) if horizon is None or isinstance(horizon, int) else horizon
    prepared = rows.select(F.col(key).alias("key"), F.col("tick").cast("bigint").alias("tick"),
                           F.coalesce(end.cast("bigint"), F.lit(-1)).alias("horizon"), F.lit(None).cast("string").alias("state"), *values)
    if saved is None:
        return prepared
    start = rows.agg(F.min("tick").alias("t")).select("t").scalar()
    usable = saved.filter(start - F.col("tick") <= RESTORE_MAX_AGE)
    names = [name for name in prepared.columns if name not in ("key", "tick", "state")]
    kinds = {field.name: field.dataType for field in prepared.schema}
    seeds = usable.select("key", F.col("tick"), *[
        (F.coalesce(end.cast("bigint"), F.lit(-1)) if name == "horizon" else F.lit(None).cast(kinds[name])).alias(name) for name in names],
        "state")
    return prepared.unionByName(seeds)


def detect_node(measures: DataFrame, horizon: int | None = None, rules: BaselineRules = BaselineRules(),
                saved: DataFrame | None = None, key: str = "node_id", **options) -> DataFrame:
    """Events of every node: open, update, resolve, and one ``state`` row per key.

    ``measures``: key, tick, pps, bps and optionally blocklist_ratio.
    """
    ratio = F.coalesce("blocklist_ratio", F.lit(0.0)) if "blocklist_ratio" in measures.columns else F.lit(0.0)
    rows = _prepare(measures, key, [F.col("pps").cast("double"), F.col("bps").cast("double"), ratio.alias("extra")],
                    horizon, saved)

    def make(state):
        return NodeDetector(state, rules, **options)

    def feed(machine, row):
        return machine.step(Row(row[1], row[4], row[5], row[6]))

    return _run(rows, make, feed, schemas.DETECTION_EVENTS)


def detect_dst(measures: DataFrame, horizon: int | Column | None = None, rules: BaselineRules = BaselineRules(),
               saved: DataFrame | None = None, key: str = "dst_ip", **options) -> DataFrame:
    """Events of every destination. ``horizon`` is the last tick observed anywhere.

    ``measures``: key, tick, pps, bps; only ticks with traffic have a row.
    """
    rows = _prepare(measures, key, [F.col("pps").cast("double"), F.col("bps").cast("double")], horizon, saved)

    def make(state):
        return DstDetector(state, rules, **options)

    def feed(machine, row):
        return machine.step(Row(row[1], row[4], row[5]))

    return _run(rows, make, feed, schemas.DETECTION_EVENTS)


def detect_http(stats: DataFrame, rules: HttpRules = HttpRules(), key: str = "site_id") -> DataFrame:
    """Events of every site over its trailing-window statistics."""
    rows = _prepare(stats, key, [F.col(name).cast("double") for name in HTTP_INPUTS], None, None)

    def make(state):
        return HttpDetector(state, rules)

    def feed(machine, row):
        return machine.step(row[1], dict(zip(HTTP_INPUTS, row[4:])))

    return _run(rows, make, feed, schemas.HTTP_EVENTS)


def events_only(detections: DataFrame) -> DataFrame:
    return detections.filter(F.col("event") != "state").drop("state")


def final_states(detections: DataFrame) -> DataFrame:
    """key, tick, state: what a later run needs to go on."""
    return detections.filter(F.col("event") == "state").select("key", "tick", "state")


def restorable(states: DataFrame, now: Column) -> DataFrame:
    """Saved baselines with enough samples that are not too old."""
    samples = F.from_json("state", "struct<base:struct<pps:array<double>>>")["base"]["pps"]
    return states.filter((F.size(samples) >= RESTORE_MIN_SAMPLES) & (now - F.col("tick") <= RESTORE_MAX_AGE))


def incidents(events: DataFrame) -> DataFrame:
    """One row per incident from its events; ``ended_tick`` is null while it is open."""
    first = F.min_by(F.struct("pps", "bps", "threshold", "avg_pps"), "tick")
    grouped = events.groupBy("key", "started_tick").agg(
        F.max(F.when(F.col("event") == "resolve", F.col("tick"))).alias("ended_tick"),
        F.max("peak_pps").alias("peak_pps"), F.max("peak_bps").alias("peak_bps"),
        F.max_by("threshold", "tick").alias("threshold"), first.alias("first"),
        F.count(F.when(F.col("event") == "update", 1)).alias("updates"),
        F.max_by("snap_tick", "tick").alias("snap_tick"))
    return grouped.select(
        F.concat_ws("@", "key", "started_tick").alias("incident_id"), "key", "started_tick", "ended_tick",
        (F.col("ended_tick") - F.col("started_tick")).alias("duration"), "peak_pps", "peak_bps", "threshold",
        F.round("first.avg_pps", 1).alias("baseline_pps"), "updates", "snap_tick")


def event_curve(events: DataFrame) -> DataFrame:
    """All (t, pps) points recorded at the opening and at each update."""
    points = events.filter(F.col("event").isin("open", "update"))
    point = F.struct((F.col("tick") - F.col("started_tick")).cast("double").alias("t"), F.round("pps", 1).alias("pps"))
    return points.groupBy("key", "started_tick").agg(F.array_sort(F.collect_list(point)).alias("velocity_curve"))


def detect_nonservice(rates: DataFrame, key: str = "node_id", limit: float = 100, close_after: int = 5) -> DataFrame:
    """Incidents of too much traffic on non-service ports, one row each.

    Nothing here feeds back into the rule, so it is a plain window query: rows over
    the limit belong to one incident as long as fewer than ``close_after`` rows lie
    between them. ``rates``: key, tick, non_service_pps, pps, threshold.
    """
    by_key = Window.partitionBy(key).orderBy("tick")
    numbered = rates.withColumn("rn", F.row_number().over(by_key)) \
        .withColumn("close_tick", F.lead("tick", close_after).over(by_key))
    over = numbered.filter(F.col("non_service_pps") > limit)
    gap = F.col("rn") - F.lag("rn").over(by_key) - 1
    grouped = over.withColumn("incident", F.sum(F.when(gap >= close_after, 1).otherwise(0)).over(by_key))
    first = F.min_by(F.struct("pps", "threshold"), "tick")
    return grouped.groupBy(key, "incident").agg(
        F.min("tick").alias("started_tick"), F.max_by("close_tick", "tick").alias("ended_tick"),
        F.max("non_service_pps").alias("peak_non_service_pps"), first.alias("first")).select(
        key, "started_tick", "ended_tick", "peak_non_service_pps",
        F.when(F.col("first.pps") > F.col("first.threshold"), "both").otherwise("non_service").alias("zone"))

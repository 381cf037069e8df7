"""Live detectors: the batch state machines over typed keyed state.

They read the per-second measures that another query writes, whole batches at a time
(no part of a second may come in a later batch than the rest, or it counts as late). A key's
scalars are one value, its last samples a list and the samples of each hour of the day an entry of a map, of
which a batch reads and writes only the hours that it learns in. Event-time timers count down open
incidents of silent destinations and drop idle keys.

Keyed state of this kind needs ``spark.sql.streaming.stateStore.providerClass`` to be the RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trafficlens import schemas
from trafficlens.operators.detector_steps import (HTTP_INPUTS, IDLE_SECONDS, BaselineRules, DstDetector, HttpDetector,
                                                  HttpRules, NodeDetector, Row)

#: What a session needs for the keyed state.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass":
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
# The measures arrive in order, batch by batch.
LATENESS = "2 seconds"
# Event time runs ahead of the ticks: the first watermark is second 0, which must not make rows of that second late.
AHEAD = 1

_SCALARS = {"first": "bigint", "last_end": "bigint", "above": "bigint", "previous": "double", "learned": "bigint",
            "confirm": "bigint", "last": "bigint"}
_OPEN = {"started": "bigint", "peak_pps": "double", "peak_bps": "double", "below": "bigint", "updated": "bigint"}
_BASE = {"pending": "bigint", "avg_pps": "double", "avg_bps": "double", "p99_pps": "double", "threshold": "double",
         "bps_threshold": "double", "ready": "boolean"}
_SITE = {"rps": "double", "samples": "bigint", "last": "bigint"}
_SITE_OPEN = {"started": "bigint", "peak": "double", "calm": "bigint"}


# Workers have no session to parse a schema with.
_TYPES = {"bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
_SAMPLE = T.StructType([T.StructField("pps", T.DoubleType()), T.StructField("bps", T.DoubleType())])
_HOUR = T.StructType([T.StructField("hour", T.StringType())])
_OF_HOUR = T.StructType([T.StructField("samples", T.ArrayType(T.DoubleType()))])


def _schema(*parts: dict[str, str]) -> T.StructType:
    """One flat row; the names of each part are numbered, as parts share some."""
    return T.StructType([T.StructField(f"{name}_{k}", _TYPES[kind]) for k, part in enumerate(parts) for name, kind in part.items()])


def _flat(*parts: tuple[dict[str, str], dict | None]) -> tuple:
    return tuple(None if values is None else values.get(name) for names, values in parts for name in names)


def _nested(row: tuple, *parts: dict[str, str]) -> list[dict]:
    out, at = [], 0
    for names in parts:
        out.append(dict(zip(names, row[at:at + len(names)])))
        at += len(names)
    return out


class _Hours(dict):
    """Samples by hour of the day, fetched from the map state when they are first learned from."""

    def __init__(self, state):
        super().__init__()
        self._state = state

    def setdefault(self, hour: str, default=None):
        if hour not in self:
            self[hour] = list(self._state.getValue((hour,))[0]) if self._state.containsKey((hour,)) else default
        return self[hour]

    def store(self) -> None:
        for hour, samples in self.items():
            self._state.updateValue((hour,), (samples,))


class _Detector(StatefulProcessor):
    """Feeds the new rows of a key, in tick order, to its machine, and keeps the machine's state and one timer."""

    def __init__(self, make: Callable, feed: Callable, names: list[str], silent: bool):
        self.make, self.feed, self.names, self.silent = make, feed, names, silent

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        machine = self._load()
        events: list[tuple] = []
        # a key has one row per second of the batch
        for row in pd.concat(list(rows)).sort_values("tick").itertuples(index=False):
            events += self.feed(machine, row)
        self._keep(machine, timerValues)
        yield self._out(key, events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # The watermark is past the timer, so no row before it can follow.
        machine = self._load()
        events = machine.finish(machine.s["last"] + IDLE_SECONDS) if self.silent else []
        if events or machine.s["open"] is not None:
            self._keep(machine, timerValues)
        else:
            self._clear()
        yield self._out(key, events)

    def _keep(self, machine, timers) -> None:
        """Stores the state until the next row, the end of a countdown or the idle limit."""
        self._store(machine)
        waits = IDLE_SECONDS
        if self.silent and machine.s["open"] is not None:
            waits = machine.holddown - machine.s["open"]["below"]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.handle.registerTimer(max((machine.s["last"] + waits + 1 + AHEAD) * 1000, timers.getCurrentWatermarkInMs() + 1))

    def _out(self, key: tuple, events: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *event) for event in events], columns=self.names).astype(object)

    def close(self) -> None:
        pass


class _Flood(_Detector):
    """Node and destination detectors: scalars, the last samples and the samples by hour."""

    PARTS = (_SCALARS, _OPEN, _BASE)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scalars = handle.getValueState("scalars", _schema(*self.PARTS))
        self.recent = handle.getListState("recent", _SAMPLE)
        self.hours = handle.getMapState("hours", _HOUR, _OF_HOUR)

    def _load(self):
        if not self.scalars.exists():
            machine = self.make(None)
        else:
            state, incident, base = _nested(tuple(self.scalars.get()), *self.PARTS)
            recent = [tuple(r) for r in self.recent.get()] if base["ready"] is not None and self.recent.exists() else []
            state["open"] = incident if incident["started"] is not None else None
            state["base"] = None if base["ready"] is None else {
                **base, "pps": [p for p, _ in recent], "bps": [b for _, b in recent], "hours": _Hours(self.hours)}
            return self.make(state)
        if machine.s["base"] is not None:
            machine.s["base"]["hours"] = _Hours(self.hours)
        return machine

    def _store(self, machine) -> None:
        s, base = machine.s, machine.s["base"]
        self.scalars.update(_flat((_SCALARS, s), (_OPEN, s["open"]), (_BASE, base)))
        if base is None:
            self.recent.clear()
            self.hours.clear()
            return
        recent = list(zip(base["pps"], base["bps"]))
        if recent:
            self.recent.put(recent)
        else:  # nothing learned yet, as in a flood from the first second; a list state holds one sample at least
            self.recent.clear()
        if not isinstance(base["hours"], _Hours):  # learned anew in this batch
            self.hours.clear()
            fresh = _Hours(self.hours)
            fresh.update(base["hours"])
            base["hours"] = fresh
        base["hours"].store()

    def _clear(self) -> None:
        for state in (self.scalars, self.recent, self.hours):
            state.clear()


class _Site(_Detector):
    """Web detector: scalars only."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scalars = handle.getValueState("scalars", _schema(_SITE, _SITE_OPEN))

    def _load(self):
        if not self.scalars.exists():
            return self.make(None)
        state, incident = _nested(tuple(self.scalars.get()), _SITE, _SITE_OPEN)
        return self.make({**state, "open": incident if incident["started"] is not None else None})

    def _store(self, machine) -> None:
        self.scalars.update(_flat((_SITE, machine.s), (_SITE_OPEN, machine.s["open"])))

    def _clear(self) -> None:
        self.scalars.clear()


def _events(rows: DataFrame, processor: _Detector, schema: T.StructType) -> DataFrame:
    return rows.groupBy("key").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def _timed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {AHEAD} SECOND")).withWatermark("ts", LATENESS)


def _samples(measures: DataFrame, key: str) -> DataFrame:
    ratio = F.coalesce("blocklist_ratio", F.lit(0.0)) if "blocklist_ratio" in measures.columns else F.lit(0.0)
    return _timed(measures).select(
        "ts", F.col(key).alias("key"), "tick", F.col("pps").cast("double"), F.col("bps").cast("double"), ratio.alias("extra"))


def stream_detect_node(measures: DataFrame, rules: BaselineRules = BaselineRules(), key: str = "node_id",
                       **options) -> DataFrame:
    """Events of every node from a stream of per-second measures (ts, key, tick, pps, bps and optionally blocklist_ratio)."""
    processor = _Flood(lambda state: NodeDetector(state, rules, **options),
                       lambda machine, r: machine.step(Row(r.tick, r.pps, r.bps, r.extra)), schemas.DETECTION_EVENTS.names, False)
    return _events(_samples(measures, key), processor, schemas.DETECTION_EVENTS)


def stream_detect_dst(measures: DataFrame, rules: BaselineRules = BaselineRules(), key: str = "dst_ip",
                      **options) -> DataFrame:
    """Events of every destination; silence counts an open incident down."""
    processor = _Flood(lambda state: DstDetector(state, rules, **options),
                       lambda machine, r: machine.step(Row(r.tick, r.pps, r.bps)), schemas.DETECTION_EVENTS.names, True)
    return _events(_samples(measures, key), processor, schemas.DETECTION_EVENTS)


def stream_detect_http(stats: DataFrame, rules: HttpRules = HttpRules(), key: str = "site_id") -> DataFrame:
    rows = _timed(stats).select("ts", F.col(key).alias("key"), "tick", *[F.col(n).cast("double") for n in HTTP_INPUTS])

    def feed(machine: HttpDetector, row) -> list[tuple]:
        return machine.step(row.tick, {name: getattr(row, name) for name in HTTP_INPUTS})

    return _events(rows, _Site(lambda state: HttpDetector(state, rules), feed, schemas.HTTP_EVENTS.names, False), schemas.HTTP_EVENTS)

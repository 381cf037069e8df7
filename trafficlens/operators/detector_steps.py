"""Small keyed state machines shared by the batch and the streaming detectors.

Whether a sample is learned depends on the verdict on earlier samples, so these
rules cannot be window expressions. Each machine takes one row per tick of one key
and returns events. Its state is a plain dict that survives JSON.
"""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the detection rules.
FLOOR_PPS = 10_000.0
MASSIVE_FACTOR = 5
WARMUP_BPS = 1_000_000_000.0
GRACE_SECONDS = 90
COOLDOWN_SECONDS = 60
CONFIRM = 3
HOLDDOWN = 10
UPDATE_EVERY = 5
DST_WARMUP_BPS = 500_000_000.0
DST_WARMUP_CONFIRM_PPS = 50_000.0
DST_BPS_FACTOR = 10
IDLE_SECONDS = 600


@dataclass(frozen=True)
class BaselineRules:
    window: int = 300
    refresh: int = 10
    hour_window: int = 360
    hour_min: int = 60
    hour_seconds: int = 3600
    min_threshold: float = 5000.0
    factor: float = 3.0
    min_bps: float = 50_000_000.0


def rank99(values: list[float]) -> float:
    ordered = sorted(values)
    n = len(ordered)
    return ordered[min(n * 99 // 100, n - 1)]


class Baseline:
    """Adaptive threshold over the last learned samples of one key."""

    def __init__(self, rules: BaselineRules, state: dict | None = None):
        self.rules = rules
        self.s = state or {
            "pps": [], "bps": [], "hours": {}, "pending": 0, "avg_pps": 0.0, "avg_bps": 0.0, "p99_pps": 0.0,
            "threshold": rules.min_threshold, "bps_threshold": 0.0, "ready": False}

    @property
    def ready(self) -> bool:
        return self.s["ready"]

    @property
    def threshold(self) -> float:
        return self.s["threshold"]

    def learn(self, tick: int, pps: float, bps: float) -> None:
        s, rules = self.s, self.rules
        for name, value in (("pps", pps), ("bps", bps)):
            s[name].append(value)
            del s[name][:-rules.window]
        hour = str(tick // rules.hour_seconds % 24)
        of_hour = s["hours"].setdefault(hour, [])
        of_hour.append(pps)
        del of_hour[:-rules.hour_window]
        n = len(s["pps"])
        if n >= 2:
            s["avg_pps"] = sum(s["pps"]) / n
            s["pending"] += 1
            if s["pending"] >= rules.refresh:
                self._refresh(of_hour)
        if n >= rules.window:
            s["ready"] = True

    def _refresh(self, of_hour: list[float]) -> None:
        s, rules = self.s, self.rules
        s["pending"] = 0
        s["p99_pps"] = rank99(s["pps"])
        s["avg_bps"] = sum(s["bps"]) / len(s["bps"])
        if s["ready"]:
            s["bps_threshold"] = max(rank99(s["bps"]) * 3, rules.min_bps)
        level = s["p99_pps"]
        if len(of_hour) >= rules.hour_min:
            level = max(rank99(of_hour), level * 0.5)
        s["threshold"] = max(level * rules.factor, rules.min_threshold)


class _Incident:
    """Open incident of one key: peaks, hold-down and update pacing."""

    @staticmethod
    def open(tick: int, pps: float, bps: float) -> dict:
        return {"started": tick, "peak_pps": pps, "peak_bps": bps, "below": 0, "updated": tick}


@dataclass
class Row:
    tick: int
    pps: float
    bps: float
    extra: float = 0.0


class NodeDetector:
    """Flood detector of one node. ``extra`` is the share of blocklisted sources."""

    def __init__(self, state: dict | None = None, rules: BaselineRules = BaselineRules(), floor: float = FLOOR_PPS,
                 velocity: bool = False, grace: int = GRACE_SECONDS, cooldown: int = COOLDOWN_SECONDS,
                 holddown: int = HOLDDOWN):
        self.floor, self.velocity, self.grace = floor, velocity, grace
        self.cooldown, self.holddown = cooldown, holddown
        self.s = state or {"first": None, "last_end": None, "above": 0, "previous": 0.0, "open": None,
                           "last": None, "base": None}
        self.base = Baseline(rules, self.s["base"])
        self.s["base"] = self.base.s

    def _over(self, row: Row) -> bool:
        base, b = self.base, self.base.s
        limit = base.threshold * (0.7 if row.extra > 0.3 else 1.0)
        if row.pps > limit or (b["bps_threshold"] > 0 and row.bps > b["bps_threshold"]):
            return True
        if not base.ready:
            return row.pps >= self.floor or row.bps > WARMUP_BPS
        jump = row.pps - self.s["previous"]
        return self.velocity and jump > b["avg_pps"] * 5 and row.pps > b["avg_pps"] * 2

    def _confirmed(self, row: Row) -> bool:
        """Applies grace, cooldown and repetition; a massive flood passes at once."""
        s = self.s
        over = self._over(row)
        massive = row.pps >= self.floor * MASSIVE_FACTOR
        if over and not massive:
            starting = not self.base.ready and row.tick - s["first"] < self.grace
            resting = s["last_end"] is not None and row.tick - s["last_end"] < self.cooldown
            over = not (starting or resting)
        s["above"] = s["above"] + 1 if over else 0
        return over and (massive or s["above"] >= CONFIRM)

    def step(self, row: Row) -> list[tuple]:
        s, base = self.s, self.base
        if s["first"] is None:
            s["first"] = row.tick
        events = []
        quiet = s["open"] is None and s["above"] == 0 and row.pps <= base.threshold
        if quiet and (base.ready or row.pps < self.floor):
            base.learn(row.tick, row.pps, row.bps)
        if s["open"] is None:
            if self._confirmed(row):
                s["open"], s["above"] = _Incident.open(row.tick, row.pps, row.bps), 0
                events.append(_event("open", row, s["open"], base))
        else:
            events += _advance(s, row, base.threshold, base, self.holddown)
        s["previous"], s["last"] = row.pps, row.tick
        return events

    def finish(self, horizon: int) -> list[tuple]:
        return []


class DstDetector:
    """Flood detector of one destination; silent ticks count down an open incident."""

    def __init__(self, state: dict | None = None, rules: BaselineRules = BaselineRules(), floor: float = FLOOR_PPS,
                 holddown: int = HOLDDOWN):
        self.rules, self.floor, self.holddown = rules, floor, holddown
        self.s = state or {"base": None, "learned": None, "confirm": 0, "open": None, "last": None}
        self.base = Baseline(rules, self.s["base"]) if self.s["base"] else None

    def _forget_idle(self, tick: int) -> None:
        if self.base is not None and tick - self.s["learned"] > IDLE_SECONDS:
            self.base, self.s["base"] = None, None

    def _over(self, row: Row) -> bool:
        if not self.base.ready:
            return row.pps >= self.floor or row.bps >= DST_WARMUP_BPS
        if row.pps > self.base.threshold:
            return True
        usual = self.base.s["avg_bps"]
        return usual > 0 and row.bps > usual * DST_BPS_FACTOR

    def _silent(self, upto: int) -> list[tuple]:
        """Counts the ticks after the last row, ``upto`` included, as below the threshold."""
        s = self.s
        if s["open"] is None or s["last"] is None or upto <= s["last"]:
            return []
        needed = self.holddown - s["open"]["below"]
        silent = upto - s["last"]
        if silent < needed:
            s["open"]["below"] += silent
            s["last"] = upto
            return []
        end = Row(s["last"] + needed, 0.0, 0.0)
        return [_close(s, end, self.base, None)]

    def step(self, row: Row) -> list[tuple]:
        s = self.s
        events = self._silent(row.tick - 1)
        self._forget_idle(row.tick)
        if s["open"] is not None:
            threshold = self.base.threshold if self.base else self.floor
            events += _advance(s, row, threshold, self.base, self.holddown)
            s["last"] = row.tick
            return events
        if self.base is None or self.base.ready or row.pps < self.floor:
            if self.base is None:
                self.base = Baseline(self.rules)
                s["base"] = self.base.s
            self.base.learn(row.tick, row.pps, row.bps)
            s["learned"] = row.tick
        if not self._over(row):
            s["confirm"] = 0
        elif self.base.ready or row.pps >= DST_WARMUP_CONFIRM_PPS:
            s["confirm"] += 1
            if s["confirm"] >= CONFIRM:
                s["confirm"], s["open"] = 0, _Incident.open(row.tick, row.pps, row.bps)
                events.append(_event("open", row, s["open"], self.base))
        s["last"] = row.tick
        return events

    def finish(self, horizon: int) -> list[tuple]:
        return self._silent(horizon)


def _event(kind: str, row: Row, incident: dict, base: Baseline | None, snap: int | None = -1) -> tuple:
    return (kind, row.tick, incident["started"], row.pps, row.bps, incident["peak_pps"], incident["peak_bps"],
            base.threshold if base else 0.0, base.s["avg_pps"] if base else 0.0, row.tick if snap == -1 else snap)


def _close(s: dict, row: Row, base: Baseline | None, snap: int | None) -> tuple:
    event = _event("resolve", row, s["open"], base, snap)
    s["open"], s["last_end"] = None, row.tick
    return event


def _advance(s: dict, row: Row, threshold: float, base: Baseline | None, holddown: int) -> list[tuple]:
    """One present tick of an open incident."""
    incident = s["open"]
    incident["peak_pps"] = max(incident["peak_pps"], row.pps)
    incident["peak_bps"] = max(incident["peak_bps"], row.bps)
    incident["below"] = incident["below"] + 1 if row.pps < threshold else 0
    if incident["below"] >= holddown:
        return [_close(s, row, base, row.tick)]
    if row.tick - incident["updated"] >= UPDATE_EVERY:
        incident["updated"] = row.tick
        return [_event("update", row, incident, base)]
    return []


# Web flood sensitivity, as (factor on the baseline, minimum requests per second).
SENSITIVITY = {"low": (8.0, 250.0), "medium": (5.0, 150.0), "high": (3.0, 75.0)}


@dataclass(frozen=True)
class HttpRules:
    sensitivity: str = "medium"
    rps_limit: float | None = None
    error_rate: float = 50.0


# Columns of the window statistics that the web detector reads, in order.
HTTP_INPUTS = ("rps", "total_requests", "unique_ips", "error_rate", "top_ip_count", "top_path_count", "status_5xx",
               "bot_request_pct", "threat_total")


class HttpDetector:
    """Flood detector of one site over its window statistics."""

    MIN_REQUESTS = 15
    MIN_SECONDS = 15
    CALM_TICKS = 3

    def __init__(self, state: dict | None = None, rules: HttpRules = HttpRules()):
        self.rules = rules
        self.s = state or {"rps": 0.0, "samples": 0, "open": None, "last": None}

    def _learn(self, rps: float, error_rate: float) -> None:
        s = self.s
        if error_rate >= 60 or (s["samples"] >= 3 and rps >= s["rps"] * 10):
            return
        weight = 1 / (s["samples"] + 1) if s["samples"] < 300 else 0.01
        s["rps"] = (1 - weight) * s["rps"] + weight * rps
        s["samples"] += 1

    def limit(self) -> float:
        s = self.s
        factor, least = SENSITIVITY[self.rules.sensitivity]
        if self.rules.rps_limit:
            return self.rules.rps_limit
        if s["samples"] < 10:
            return 500.0
        if s["samples"] >= 30:
            return s["rps"] * factor if s["rps"] > 1 else 100.0
        return max(s["rps"] * factor, least) if s["rps"] > 5 else least

    def _signals(self, w: dict) -> int:
        n = w["total_requests"]
        return (2 * (w["rps"] > self.limit())
                + (w["top_ip_count"] > 20 and w["top_ip_count"] / n > 0.3)
                + (w["top_path_count"] > 30 and w["top_path_count"] / n > 0.6)
                + (w["error_rate"] > self.rules.error_rate and n > 20)
                + (w["status_5xx"] > max(n * 0.3, 15))
                + (w["bot_request_pct"] > 70 and n > 30)
                + (w["threat_total"] > max(n * 0.2, 10)))

    def _calm(self, w: dict, peak: float) -> bool:
        usual = self.s["rps"]
        fading = w["rps"] < peak * 0.1 or (usual > 5 and w["rps"] < usual * 2)
        return w["total_requests"] < 10 or w["rps"] < 50 or (fading and w["error_rate"] < 30)

    def step(self, tick: int, w: dict) -> list[tuple]:
        s, o = self.s, self.s["open"]
        s["last"] = tick
        enough = w["total_requests"] >= self.MIN_REQUESTS
        if o is None:
            if not enough:
                return []
            self._learn(w["rps"], w["error_rate"])
            signals = self._signals(w)
            if signals < 2 or w["unique_ips"] < 3:
                return []
            s["open"] = {"started": tick, "peak": w["rps"], "calm": 0}
            return [("open", tick, tick, w["rps"], w["rps"], round(s["rps"], 1), signals)]
        if enough:
            o["peak"] = max(o["peak"], w["rps"])
        if tick - o["started"] >= self.MIN_SECONDS:
            o["calm"] = o["calm"] + 1 if self._calm(w, o["peak"]) else 0
        event = ["update", tick, o["started"], w["rps"], o["peak"], round(s["rps"], 1), 0]
        if o["calm"] >= self.CALM_TICKS:
            event[0] = "resolve"
            s["open"], s["rps"], s["samples"] = None, max(w["rps"], 1.0), 1
        return [tuple(event)]

"""Rolling and time-of-day baselines, thresholds and sequence rules.

All functions take one row per (key, tick). A key has at most one row per second,
whatever its traffic, so the per-key windows below grow with time and not with load.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.operators.sweep import ordered_pass, within

# Fixed values of the detection rules.
RECALCULATE_EVERY = 10
WINDOW = 300
HOUR_WINDOW = 360
HOUR_MIN_SAMPLES = 60
MIN_THRESHOLD = 5000.0
# Rates from which a key without a baseline counts as flooded.
UNSEEN_PPS = 10_000.0
UNSEEN_BPS = 500_000_000.0
THRESHOLD_FACTOR = 3.0
BPS_FACTOR = 3.0
MIN_BPS_THRESHOLD = 50_000_000.0


def ranked_percentile(values: Column, percent: int) -> Column:
    """0-based element ``n * percent div 100`` of the sorted array."""
    n = F.size(values)
    index = F.least(F.floor(n * percent / 100).cast("int"), n - 1) + 1
    return F.when(n > 0, F.element_at(F.array_sort(values), index))


class _Ring:
    """The last ``size`` values, also kept in order, so that a percentile is one look-up."""

    __slots__ = ("ranked", "size", "values")

    def __init__(self, size: int):
        self.size, self.values, self.ranked = size, deque(), []

    def push(self, value: float | None) -> None:
        if value is None:
            return
        self.values.append(value)
        insort(self.ranked, value)
        if len(self.values) > self.size:
            del self.ranked[bisect_left(self.ranked, self.values.popleft())]

    def percentile(self, percent: int) -> float | None:
        n = len(self.ranked)
        return self.ranked[min(n * percent // 100, n - 1)] if n else None

    def mean(self) -> float | None:
        return sum(self.values) / len(self.values) if self.values else None


def rolling_baseline(samples: DataFrame, key: str, window: int = WINDOW, hour_seconds: int = 3600,
                     hour_window: int = HOUR_WINDOW, hour_min: int = HOUR_MIN_SAMPLES) -> DataFrame:
    """Mean, p95/p99, hour-of-day p99 and thresholds as of every sample.

    ``samples``: key, tick, pps, bps. Percentiles are refreshed at samples 11, 21, ... of a key and hold in between; the
    mean follows every sample. One ordered pass by key keeps the last values in rings that are always sorted: a sample is put
    in and the oldest taken out by bisection. Rows without a tick are no samples; a null rate counts as a sample and is not learned.
    """
    step = RECALCULATE_EVERY

    def fresh():
        pps_ring, bps_ring, hours = _Ring(window), _Ring(window), {}
        number, summary = 0, None

        def learn(tick, pps, bps):
            nonlocal number, summary
            number += 1
            pps_ring.push(pps)
            bps_ring.push(bps)
            # Samples of an hour, with those that carry no rate, and its last rates.
            hour = hours.setdefault(tick // hour_seconds % 24, [0, _Ring(hour_window)])
            hour[0] += 1
            hour[1].push(pps)
            if number > 1 and number % step == 1:
                ready = hour[0] >= hour_min
                summary = (pps_ring.percentile(95), pps_ring.percentile(99), bps_ring.mean(), bps_ring.percentile(99),
                           ready, hour[1].percentile(99) if ready else None, number > window)
            mean = pps_ring.mean() if number >= 2 else 0.0
            if summary is None:
                return number, mean, 0.0, 0.0, 0.0, 0.0, False, 0.0, number >= window, MIN_THRESHOLD, 0.0
            p95, p99, avg_bps, p99_bps, ready, hour_p99, full = summary
            level = max(hour_p99 or 0.0, (p99 or 0.0) * 0.5) if ready else p99 or 0.0
            limit = max((p99_bps or 0.0) * BPS_FACTOR, MIN_BPS_THRESHOLD) if full else 0.0
            return (number, mean, p95 or 0.0, p99 or 0.0, avg_bps or 0.0, p99_bps or 0.0, ready, hour_p99 or 0.0,
                    number >= window, max(level * THRESHOLD_FACTOR, MIN_THRESHOLD), limit)

        return learn

    rows = samples.filter(F.col("tick").isNotNull()).select(
        key, F.col("tick").cast("bigint").alias("tick"), F.col("pps").cast("double").alias("pps"), F.col("bps").cast("double").alias("bps"))
    return ordered_pass(rows, key, fresh, "sample_no bigint, avg_pps double, p95_pps double, p99_pps double, avg_bps double, p99_bps double, "
                        "hour_ready boolean, hour_p99 double, ready boolean, threshold double, bps_threshold double")


def calibrated_threshold(samples: DataFrame, key: str, cut: int, window: int = WINDOW) -> DataFrame:
    """Threshold per key from its last ``window`` samples before tick ``cut``."""
    newest_first = Window.partitionBy(key).orderBy(F.col("tick").desc())
    kept = (samples.filter(F.col("tick") < cut)
            .withColumn("age", F.row_number().over(newest_first)).filter(F.col("age") <= window))
    grouped = kept.groupBy(key).agg(F.collect_list("pps").alias("values"), F.avg("pps").alias("avg_pps"))
    p99 = ranked_percentile(F.col("values"), 99)
    return grouped.select(key, "avg_pps", p99.alias("p99_pps"),
                          F.greatest(p99 * THRESHOLD_FACTOR, F.lit(MIN_THRESHOLD)).alias("threshold"))


def with_calibrated_threshold(samples: DataFrame, key: str, cut: int, window: int = WINDOW) -> DataFrame:
    """The rows with ``avg_pps``, ``p99_pps`` and ``threshold`` of ``calibrated_threshold`` beside them.

    Window ranks over one partitioning by key replace the grouping and the join back,
    so the samples are computed and shuffled once. Keys without rows before ``cut`` have
    no average and no percentile; their threshold is UNSEEN_PPS.
    """
    early = F.col("tick") < cut
    everything = Window.partitionBy(key)
    aged = samples.withColumn("_age", F.row_number().over(
        Window.partitionBy(key).orderBy(early.desc(), F.col("tick").desc())))
    marked = aged.withColumn("_used", early & (F.col("_age") <= window))
    ranked = marked.withColumn("_rank", F.row_number().over(
        Window.partitionBy(key).orderBy(F.col("_used").desc(), "pps"))) \
        .withColumn("_n", F.count(F.when(F.col("_used"), 1)).over(everything))
    wanted = F.least(F.floor(F.col("_n") * 99 / 100), F.col("_n") - 1) + 1
    p99 = F.max(F.when(F.col("_used") & (F.col("_rank") == wanted), F.col("pps"))).over(everything)
    mean = F.avg(F.when(F.col("_used"), F.col("pps"))).over(everything)
    learned = F.greatest(F.col("p99_pps") * THRESHOLD_FACTOR, F.lit(MIN_THRESHOLD))
    return (ranked.withColumn("avg_pps", mean).withColumn("p99_pps", p99)
            .withColumn("threshold", F.when(F.col("_n") > 0, learned).otherwise(UNSEEN_PPS))
            .drop("_age", "_used", "_rank", "_n"))


def exceeds(threshold: Column, pps: Column, bps: Column, learned: Column) -> Column:
    """Whether a rate is above its threshold; a key that has not ``learned`` one is judged by fixed rates."""
    return F.when(learned, pps > threshold).otherwise((pps >= UNSEEN_PPS) | (bps >= UNSEEN_BPS))


def velocity(baseline: DataFrame, key: str) -> DataFrame:
    """Marks jumps: change above 5 means and level above 2 means, once ready."""
    previous = F.coalesce(F.lag("pps").over(Window.partitionBy(key).orderBy("tick")), F.lit(0.0))
    jump = F.col("pps") - previous
    return baseline.select(
        key, "tick", "pps", jump.alias("delta"), "avg_pps",
        (F.col("ready") & (jump > F.col("avg_pps") * 5) & (F.col("pps") > F.col("avg_pps") * 2)).alias("is_jump"))


def runs_of(rows: DataFrame, key: str, flag: str, run: str = "run_length") -> DataFrame:
    """Position of every row inside its run of equal ``flag`` values.

    Runs are over rows that exist: a missing tick neither breaks nor extends one.
    """
    by_key = Window.partitionBy(key).orderBy("tick")
    changed = F.coalesce((F.col(flag) != F.lag(flag).over(by_key)).cast("int"), F.lit(1))
    numbered = rows.withColumn("_run", F.sum(changed).over(by_key))
    inside = Window.partitionBy(key, "_run").orderBy("tick")
    return numbered.withColumn(run, F.row_number().over(inside).cast("bigint"))


def sustained(rows: DataFrame, key: str, flag: str, confirm: int = 3) -> DataFrame:
    """Runs of at least ``confirm`` consecutive rows with ``flag`` set."""
    hot = runs_of(rows, key, flag).filter(F.col(flag))
    return (hot.groupBy(key, "_run").agg(
        F.min("tick").alias("first_tick"), F.max("tick").alias("last_tick"),
        F.count(F.lit(1)).alias("length"), F.max("pps").alias("peak_pps"))
        .filter(F.col("length") >= confirm).drop("_run"))


def holddown(rows: DataFrame, key: str, flag: str, below: int = 10) -> DataFrame:
    """Rows at which a run of ``below`` consecutive clear rows is complete."""
    clear = runs_of(rows, key, flag).filter(~F.col(flag) & (F.col("run_length") == below))
    return clear.select(key, F.col("tick").alias("resolved_tick"))


def classification_lock(updates: DataFrame, key: str, votes: int = 3) -> DataFrame:
    """Family of every update; fixed once the same family won ``votes`` times in a row.

    ``updates``: key, tick, family.
    """
    marked = runs_of(updates, key, "family", "vote")
    by_key = Window.partitionBy(key).orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    locked = F.first(F.when(F.col("vote") == votes, F.col("family")), ignorenulls=True).over(by_key)
    return marked.select(key, "tick", "family", locked.alias("locked_family"),
                         F.coalesce(locked, F.col("family")).alias("effective_family"))


def velocity_points(rows: DataFrame, incidents: DataFrame, key: str, every: int = 5,
                    keep: int | None = None) -> DataFrame:
    """Samples of the traffic curve of each incident, at least ``every`` seconds apart.

    ``incidents``: key, incident_id, started_tick, ended_tick. A sample is the first
    row in its interval counted from the start; all stay, or the last ``keep``.
    """
    joined = within(rows, incidents, key)
    t = (F.col("tick") - F.col("started_tick")).alias("t")
    points = joined.select("incident_id", key, t, "pps").withColumn("slot", F.floor(F.col("t") / every))
    firsts = points.groupBy("incident_id", key, "slot").agg(
        F.min("t").alias("t"), F.min_by("pps", "t").alias("pps"))
    if keep is not None:
        newest = Window.partitionBy("incident_id", key).orderBy(F.col("slot").desc())
        firsts = firsts.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= keep)
    return (firsts.select("incident_id", key, F.col("t").cast("double").alias("t"), F.round("pps", 1).alias("pps")))


def velocity_curve(rows: DataFrame, incidents: DataFrame, key: str, every: int = 5) -> DataFrame:
    """One ordered array of (t, pps) per incident."""
    return (velocity_points(rows, incidents, key, every).groupBy("incident_id", key)
            .agg(F.array_sort(F.collect_list(F.struct("t", "pps"))).alias("velocity_curve")))


def counter_rates(counters: DataFrame, key: str = "node_id") -> DataFrame:
    """Rates and protocol shares from cumulative interface counters.

    The shares of an interval without protocol packets repeat the previous ones.
    """
    by_key = Window.partitionBy(key).orderBy("tick")
    names = ("rx_packets", "rx_bytes", "tcp_in", "udp_in", "icmp_in")
    deltas = counters.select(
        key, "tick", (F.col("tick") - F.lag("tick").over(by_key)).alias("dt"),
        *[(F.col(name) - F.lag(name).over(by_key)).alias(name) for name in names])
    deltas = deltas.filter(F.col("dt") > 0)
    known = F.col("tcp_in") + F.col("udp_in") + F.col("icmp_in")
    so_far = by_key.rowsBetween(Window.unboundedPreceding, 0)

    def share(name: str) -> Column:
        fresh = F.when(known > 0, F.round(F.col(name) / known * 100, 1))
        return F.coalesce(F.last(fresh, ignorenulls=True).over(so_far), F.lit(0.0))

    return deltas.select(
        key, "tick", (F.col("rx_packets") / F.col("dt")).alias("pps"),
        (F.col("rx_bytes") * 8 / F.col("dt")).alias("bps"),
        share("tcp_in").alias("tcp_pct"), share("udp_in").alias("udp_pct"), share("icmp_in").alias("icmp_pct"))


def sp_rates(counters: DataFrame, key: str = "node_id", every: int = 5) -> DataFrame:
    """Service, non-service and blocked rates from cumulative counters read every ``every`` ticks.

    ``counters``: key, tick, service_packets, service_bytes, non_service_packets,
    non_service_bytes, blocked_packets. The last reading of an interval counts.
    """
    slot = F.floor(F.col("tick") / every).cast("bigint")
    names = ("service_packets", "service_bytes", "non_service_packets", "non_service_bytes", "blocked_packets")
    reads = counters.groupBy(key, slot.alias("slot")).agg(
        F.max("tick").alias("tick"), *[F.max_by(name, "tick").alias(name) for name in names])
    by_key = Window.partitionBy(key).orderBy("slot")
    dt = F.col("tick") - F.lag("tick").over(by_key)

    def rate(name: str, factor: int) -> Column:
        change = (F.col(name) - F.lag(name).over(by_key)) * factor
        return F.greatest(F.lit(0), F.round(change / dt)).cast("bigint")

    return reads.select(
        key, "tick", dt.alias("dt"),
        rate("service_packets", 1).alias("service_pps"), rate("service_bytes", 8).alias("service_bps"),
        rate("non_service_packets", 1).alias("non_service_pps"),
        rate("non_service_bytes", 8).alias("non_service_bps"),
        rate("blocked_packets", 1).alias("blocked_pps")).filter(F.col("dt") >= 1).drop("dt")

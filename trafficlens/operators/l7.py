"""Web request statistics over a trailing window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.functions.classify import classify_l7_subtype
from trafficlens.functions.http import THREAT_PATTERNS, is_bot_agent, status_group, threat_flags
from trafficlens.operators.sweep import ordered_pass, within
from trafficlens.operators.topk import topk_per_group

WINDOW = 10
TOP_IPS, TOP_PATHS, TOP_AGENTS = 50, 20, 20
# Items of a whole attack that a list keeps; there are ten threats.
ATTACK_LISTS = {"path": TOP_PATHS, "ip": TOP_IPS, "ua": TOP_AGENTS, "threat": 10}
# Fixed values of the learned request rate.
MIN_REQUESTS, CLEAN_ERROR_RATE, MEAN_SAMPLES, SMOOTHING = 15, 60, 300, 0.01


def request_flags(requests: DataFrame) -> DataFrame:
    return requests.withColumn("threats", threat_flags(F.col("path"))) \
        .withColumn("is_bot", (F.coalesce("ua", F.lit("")) != "") & is_bot_agent(F.col("ua"))) \
        .withColumn("status_group", status_group(F.col("status")))


def _count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def _spread(df: DataFrame, window: int) -> DataFrame:
    """One row per trailing window that a per-tick row belongs to."""
    return df.withColumnRenamed("tick", "_at").withColumn("tick", F.explode(
        F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda i: F.col("_at") + i)))


def additive_counts() -> list[Column]:
    """Statistics of flagged requests that add up over ticks, addresses and paths."""
    versions = [_count_if(F.col("http_version") == v).alias(f"v_{name}") for v, name in
                (("1.0", "1_0"), ("1.1", "1_1"), ("2", "2"), ("3", "3"))]
    return [
        F.count(F.lit(1)).alias("n"),
        *[_count_if(F.col("status_group") == g).alias(f"status_{g}") for g in ("1xx", "2xx", "3xx", "4xx", "5xx")],
        _count_if(F.col("status") == 499).alias("status_499"),
        _count_if(F.col("is_bot")).alias("bots"),
        _count_if(F.coalesce("http_version", F.lit("")) != "").alias("versioned"), *versions,
        *[_count_if(F.array_contains("threats", name)).alias(f"threat_{name}") for name in THREAT_PATTERNS],
        F.sum("resp_time_ms").alias("resp_sum"), F.count("resp_time_ms").alias("resp_n")]


def window_totals(requests: DataFrame, window: int = WINDOW) -> DataFrame:
    """Additive statistics of the window (tick - window, tick] for every site.

    Requests are folded to one row per (site, tick) before they are repeated for
    the windows they fall into, so the repetition touches ticks and not requests.
    """
    per_tick = request_flags(requests).groupBy("site_id", "tick").agg(*additive_counts())
    sums = [name for name in per_tick.columns if name not in ("site_id", "tick")]
    return _spread(per_tick, window).groupBy("site_id", "tick").agg(
        *[F.sum(name).alias(name) for name in sums], F.min("_at").alias("oldest"))


def window_items(requests: DataFrame, item: str, window: int = WINDOW) -> DataFrame:
    """Request counts per (site, window, item).

    Counted per tick first, then kept with all ticks of one (site, item) in one
    place, so that repeating them for ten windows needs no further shuffle.
    """
    per_tick = requests.groupBy("site_id", item, "tick").agg(F.count(F.lit(1)).alias("count"))
    together = per_tick.repartition("site_id", item)
    return _spread(together, window).groupBy("site_id", item, "tick").agg(F.sum("count").alias("count"))


def _pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole * 100, 1)).otherwise(0.0)


def l7_window_stats(requests: DataFrame, window: int = WINDOW) -> DataFrame:
    """Request statistics of every trailing window, one row per (site, tick)."""
    totals = window_totals(requests, window)
    keys = ["site_id", "tick"]
    ips = window_items(requests, "ip", window).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("unique_ips"), F.max("count").alias("top_ip_count"),
        F.max_by("ip", F.struct("count", "ip")).alias("top_ip"))
    paths = window_items(requests, "path", window).groupBy(*keys).agg(
        F.max("count").alias("top_path_count"),
        F.min_by("path", F.struct(-F.col("count"), F.col("path"))).alias("top_path"))
    return stat_columns(totals.join(ips, keys).join(paths, keys), keys, window)


def stat_columns(joined: DataFrame, keys: Sequence[str], window: int = WINDOW) -> DataFrame:
    """The statistics of a window from its sums, its oldest tick and its top items."""
    n = F.col("n")
    elapsed = F.when(n > 1, F.greatest(F.lit(1.0), (F.col("tick") - F.col("oldest")).cast("double"))) \
        .otherwise(float(window))
    rps = n / elapsed
    threats = [f"threat_{name}" for name in THREAT_PATTERNS]
    return joined.select(
        *keys, n.alias("total_requests"), F.round(rps, 1).alias("rps"), F.round(elapsed, 1).alias("window_seconds"),
        "unique_ips", _pct(F.col("status_4xx") + F.col("status_5xx"), n).alias("error_rate"),
        *[f"status_{g}" for g in ("1xx", "2xx", "3xx", "4xx", "5xx", "499")],
        _pct(F.col("bots"), n).alias("bot_request_pct"),
        *threats, sum((F.col(t) for t in threats[1:]), F.col(threats[0])).alias("threat_total"),
        *[_pct(F.col(f"v_{v}"), F.col("versioned")).alias(f"http_{v}_pct") for v in ("1_0", "1_1")],
        _pct(F.col("v_2"), F.col("versioned")).alias("h2_pct"),
        _pct(F.col("v_3"), F.col("versioned")).alias("h3_pct"),
        F.when(F.col("resp_n") > 0, F.round(F.col("resp_sum") / F.col("resp_n"), 1)).alias("avg_response_ms"),
        F.round(rps / F.greatest(F.col("unique_ips"), F.lit(1)), 1).alias("rps_per_ip"),
        "top_ip_count", "top_path", "top_path_count")


def with_subtype(stats: DataFrame) -> DataFrame:
    return stats.withColumn("attack_subtype", classify_l7_subtype(
        *[F.col(name) for name in ("total_requests", "rps", "unique_ips", "error_rate", "h2_pct", "h3_pct",
                                   "status_499", "status_4xx", "rps_per_ip", "top_path", "top_path_count")]))


def l7_top_items(requests: DataFrame, item: str, k: int, window: int = WINDOW) -> DataFrame:
    """The k most frequent values of ``item`` per (site, window)."""
    if item == "ua":
        requests = requests.filter(F.coalesce("ua", F.lit("")) != "")
    counted = window_items(requests, item, window)
    return topk_per_group(counted, ["site_id", "tick"], [F.col("count").desc(), F.col(item).asc()], k)


def l7_baseline(stats: DataFrame, key: str = "site_id", min_requests: int = MIN_REQUESTS) -> DataFrame:
    """The learned request rate of every site as of each of its windows.

    ``stats``: site_id, tick, rps, total_requests, error_rate and, where known, under_attack. A window is ``clean`` if it has enough
    requests, fewer than 60 % errors, a rate under ten times the learned one (from the third sample on), and no open attack. Clean
    windows are learned: as a mean up to 300 samples, then smoothed by 0.01. Nulls in any of these are not clean. What is
    clean depends on what was learned before, so this is one ordered pass by site and no window expression.
    """
    attacked = F.col("under_attack") if "under_attack" in stats.columns else F.lit(False)
    rows = stats.filter(F.col("tick").isNotNull()).select(
        key, F.col("tick").cast("bigint").alias("tick"), F.col("rps").cast("double").alias("rps"),
        (F.col("total_requests") >= min_requests).alias("_enough"), (F.col("error_rate") < CLEAN_ERROR_RATE).alias("_calm"),
        (~attacked).alias("_free"))

    def fresh():
        samples, usual = 0, 0.0

        def learn(tick, rps, enough, calm, free):
            nonlocal samples, usual
            clean = bool(enough and calm and free and rps is not None and (samples < 3 or rps < usual * 10))
            if clean:
                weight = 1 / (samples + 1) if samples < MEAN_SAMPLES else SMOOTHING
                usual = (1 - weight) * usual + weight * rps
                samples += 1
            return clean, samples, usual

        return learn

    return ordered_pass(rows, key, fresh, "clean boolean, samples bigint, baseline_rps double").drop("_enough", "_calm", "_free")


def incident_windows(stats: DataFrame, incidents: DataFrame) -> DataFrame:
    """Window rows inside each HTTP incident. ``incidents``: site_id, incident_id, started_tick, ended_tick."""
    spans = incidents.select("site_id", "incident_id", "started_tick", "ended_tick")
    return within(stats, spans, "site_id")


def l7_attack_items(requests: DataFrame, incidents: DataFrame, item: str, k: int | None, window: int = WINDOW) -> DataFrame:
    """Top items of a whole attack, from all its requests: summed over overlapping windows, and exact.

    ``window_summed`` counts a request once for each window of the incident that it falls into,
    ``exact_count`` counts it once if it came during the incident. Cut to ``k`` once per incident.
    """
    if item == "ua":
        requests = requests.filter(F.coalesce("ua", F.lit("")) != "")
    summed = _attack_counts(requests, incidents, [item], window)
    return topk_per_group(summed, ["incident_id"], [F.col("window_summed").desc(), F.col(item).asc()], k)


def _attack_counts(requests: DataFrame, incidents: DataFrame, items: Sequence[str], window: int) -> DataFrame:
    per_tick = requests.groupBy("site_id", *items, "tick").agg(F.count(F.lit(1)).alias("count"))
    spans = incidents.select("site_id", "incident_id", "started_tick", "ended_tick")
    first, last = F.greatest("tick", "started_tick"), F.least(F.col("tick") + window - 1, F.col("ended_tick"))
    inside = within(per_tick, spans, "site_id", F.col("started_tick") - (window - 1))
    return inside.groupBy("incident_id", *items).agg(
        F.sum(F.col("count") * (last - first + 1)).alias("window_summed"),
        F.sum(F.when(F.col("tick") >= F.col("started_tick"), F.col("count")).otherwise(0)).alias("exact_count"))


def l7_attack_lists(requests: DataFrame, incidents: DataFrame, limits: Mapping[str, int] = MappingProxyType(ATTACK_LISTS),
                    window: int = WINDOW) -> DataFrame:
    """The busiest paths, addresses and agents of a whole attack and its threats: incident_id, kind, item, window_summed, exact_count, rank.

    Counted from all requests as in :func:`l7_attack_items`, in one grouping for all kinds; ``limits`` names the kinds
    and how many of each stay. A request counts for each threat in its path. Items that are null or empty are not listed.
    """
    plain = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("item")) for kind in ("path", "ip", "ua")])
    threats = F.transform("threats", lambda name: F.struct(F.lit("threat").alias("kind"), name.alias("item")))
    flagged = requests.withColumn("threats", threat_flags(F.coalesce("path", F.lit(""))))
    items = flagged.select("site_id", "tick", F.inline(F.concat(plain, threats))).filter(
        (F.coalesce("item", F.lit("")) != "") & F.col("kind").isin(*limits))
    summed = _attack_counts(items, incidents, ["kind", "item"], window)
    ranked = topk_per_group(summed, ["incident_id", "kind"], [F.col("window_summed").desc(), F.col("item").asc()], max(limits.values()))
    allowed = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    return ranked.filter(F.col("rank") <= F.element_at(allowed, F.col("kind")))


def l7_attack_listed_items(ranked: DataFrame, incidents: DataFrame, item: str, k: int) -> DataFrame:
    """Top items of a whole attack as the sum of its windows' top lists; see :func:`l7_attack_items` for whole counts."""
    inside = incident_windows(ranked.drop("rank"), incidents)
    summed = inside.groupBy("incident_id", item).agg(F.sum("count").alias("window_summed"))
    return topk_per_group(summed, ["incident_id"], [F.col("window_summed").desc(), F.col(item).asc()], k)


def l7_attack_totals(stats: DataFrame, incidents: DataFrame, requests: DataFrame) -> DataFrame:
    """Whole-attack totals: summed over overlapping windows, and exact from the requests.

    ``window_summed_requests`` counts a request once per window it falls into;
    ``exact_requests`` counts it once.
    """
    inside = incident_windows(stats, incidents)
    versions = {"h1_0": "http_1_0_pct", "h1_1": "http_1_1_pct", "h2": "h2_pct", "h3": "h3_pct"}
    sums = inside.groupBy("incident_id").agg(
        F.sum("total_requests").alias("window_summed_requests"),
        *[F.sum(f"status_{g}").alias(f"status_{g}") for g in ("2xx", "3xx", "4xx", "5xx")],
        F.sum("threat_total").alias("threat_hits"),
        *[F.sum(F.round(F.col(pct) / 100 * F.col("total_requests")).cast("bigint")).alias(f"_{name}")
          for name, pct in versions.items()])
    whole = sum((F.col(f"_{name}") for name in list(versions)[1:]), F.col("_h1_0"))
    sums = sums.select("*", *[_pct(F.col(f"_{name}"), whole).alias(f"{name}_pct") for name in versions]) \
        .drop(*[f"_{name}" for name in versions])
    per_tick = requests.groupBy("site_id", "tick").agg(F.count(F.lit(1)).alias("n"))
    exact = incident_windows(per_tick, incidents).groupBy("incident_id").agg(F.sum("n").alias("exact_requests"))
    return sums.join(exact, "incident_id", "left").withColumn("exact_requests", F.coalesce("exact_requests", F.lit(0)))

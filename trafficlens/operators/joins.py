"""Joins that Spark has no single operator for."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.functions.network import address_hex, prefix_key
from trafficlens.operators.sweep import open_spans, placed
from trafficlens.session import materialize, scalar
from trafficlens.sources.wire import Cells, decoded


# --- addresses in networks -------------------------------------------------

def parse_networks(entries: DataFrame, column: str = "entry") -> DataFrame:
    """``a.b.c.d/n`` or plain addresses as network, prefix_len; unreadable entries drop out."""
    address = F.substring_index(column, "/", 1)
    bits = F.length(address_hex(address)) * 4
    given = F.when(F.col(column).contains("/"), F.substring_index(column, "/", -1).try_cast("bigint")) \
        .otherwise(bits.cast("bigint"))
    return (entries.select("*", address.alias("network"), given.alias("prefix_len"), bits.alias("_bits"))
            .filter(F.col("prefix_len").between(0, F.col("_bits"))).drop("_bits"))


def cidr_join(df: DataFrame, ip: str, networks: DataFrame, how: str = "inner") -> DataFrame:
    """Rows whose address lies in a network.

    The range test is an equality join on (prefix length, prefix): an address is
    expanded to one row per prefix length that occurs in ``networks`` (at most 161
    in all), after reducing to distinct addresses. ``inner`` adds the network's
    columns once per matching network, however often it is listed; ``left_semi`` / ``left_anti`` filter.
    """
    keyed = networks.distinct().withColumn("_hex", address_hex(F.col("network")))
    keyed = keyed.withColumn("_key", prefix_key(F.col("_hex"), F.col("prefix_len"))) \
        .withColumn("_len", F.col("prefix_len").cast("bigint")).drop("_hex")
    lengths = scalar(networks, F.collect_set(F.col("prefix_len").cast("bigint")))
    addresses = df.select(F.col(ip).alias("_ip")).distinct().withColumn("_hex", address_hex(F.col("_ip")))
    expanded = (addresses.filter(F.col("_hex").isNotNull())
                .withColumn("_lengths", lengths).withColumn("_len", F.explode("_lengths")).drop("_lengths")
                .filter(F.col("_len") <= F.length("_hex") * 4)
                .withColumn("_key", prefix_key(F.col("_hex"), F.col("_len"))))
    matched = expanded.join(keyed, ["_len", "_key"])
    if how in ("left_semi", "left_anti"):
        hits = matched.select(F.col("_ip").alias(ip)).distinct()
        return df.join(hits, ip, how)
    hits = matched.select(F.col("_ip").alias(ip), *networks.columns)
    return df.join(hits, ip, how)


def subnet_filter(df: DataFrame, ip: str, networks: DataFrame) -> DataFrame:
    """Keep rows of the monitored networks; with none configured, keep all."""
    configured = scalar(networks, F.count(F.lit(1)))
    inside = (cidr_join(df.select(ip).distinct(), ip, networks, "left_semi")
              .withColumn("_inside", F.lit(True)))
    return df.join(inside, ip, "left").filter((configured == 0) | F.col("_inside")).drop("_inside")


def safelist_anti(df: DataFrame, ip: str, entries: DataFrame) -> DataFrame:
    """Drop safelisted addresses, whether listed singly or by network."""
    return cidr_join(df, ip, parse_networks(entries), "left_anti")


# --- small lookups ---------------------------------------------------------

def blocklist_join(df: DataFrame, blocklist: DataFrame, ip: str = "src_ip") -> DataFrame:
    listed = blocklist.select(F.col("indicator").alias(ip), F.lit(True).alias("threat_intel")).distinct()
    return df.join(listed, ip, "left").withColumn("threat_intel", F.coalesce("threat_intel", F.lit(False)))


def blocklist_ratio(sources: DataFrame, keys: Sequence[str], blocklist: DataFrame) -> DataFrame:
    """Share of the distinct sources of a group that are on the blocklist."""
    marked = blocklist_join(sources.select(*keys, "src_ip").distinct(), blocklist)
    return marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sources"), F.count(F.when(F.col("threat_intel"), 1)).alias("matched"),
        (F.count(F.when(F.col("threat_intel"), 1)) / F.count(F.lit(1))).alias("blocklist_ratio"))


def label_join(df: DataFrame, labels: DataFrame, ip: str) -> DataFrame:
    """Adds the label of an address, the first in order where it has several."""
    named = labels.groupBy(F.col("ip").alias(ip)).agg(F.min("label").alias("label"))
    return df.join(named, ip, "left").withColumn("label", F.coalesce("label", F.lit("")))


# --- payload patterns ------------------------------------------------------

GRAM = 8
FILTER_BITS = 22
FILTER_WORDS = 2**FILTER_BITS // 64
# Payload positions that are looked at together.
PIECE = 1 << 18


def ioc_join(payloads: DataFrame, patterns: DataFrame, payload: str = "payload",
             inline: bool = False) -> DataFrame:
    """Adds ``ioc_hit`` = ``name:family`` of the first pattern (by ``ord``, then name) the payload contains.

    An equality join on the leading bytes of each pattern, verified afterwards; only payload bytes
    that start a pattern meet. A list that the caller knows to be short can be ``inline``: it
    travels as one array value and is tested where the payload is, with the same result.
    """
    clean = patterns.filter(F.col("pattern").isNotNull() & (F.col("pattern") != ""))
    if inline:
        listed = scalar(clean, F.array_sort(F.collect_list(
            F.struct("ord", F.concat_ws(":", "attack_name", "attack_family").alias("hit"),
                     F.encode("pattern", "UTF-8").alias("bytes")))))
        data = F.col(payload).cast("binary")
        found = F.filter("_listed", lambda p: F.contains(data, p["bytes"]))
        return (payloads.withColumn("_listed", listed)
                .withColumn("ioc_hit", F.get(found, F.lit(0))["hit"]).drop("_listed"))
    return _ioc_join_by_prefix(payloads, clean, payload)


def _cell(gram: np.ndarray) -> np.ndarray:
    """Bit of the filter that stands for a gram, by a multiplicative hash."""
    return ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)).view(np.int64)


def _leading_grams(batch: pa.RecordBatch) -> tuple[np.ndarray, dict]:
    """The first bytes of every pattern, up to ``GRAM``, as one number."""
    cells = Cells.of(batch.column(batch.schema.get_field_index("bytes")))
    width = np.minimum(cells.size, GRAM)
    gram = np.zeros(len(cells), np.uint64)
    for k in range(GRAM):
        gram = np.where(k < width, (gram << np.uint64(8)) | cells.byte(k).astype(np.uint64), gram)
    return np.arange(len(cells)), {"width": width, "gram": gram.view(np.int64), "cell": _cell(gram)}


def _grams_found(words: np.ndarray, widths: list[int]):
    """Decoder of the distinct grams of each payload that pass the filter, by ``words`` of 64 bits."""
    def decode(batch: pa.RecordBatch) -> tuple[np.ndarray, dict]:
        cells = Cells.of(batch.column(batch.schema.get_field_index("_data")))
        listed = np.unpackbits(words.view(np.uint8), bitorder="little")
        end = cells.start + cells.size
        found = [np.zeros((3, 0), np.int64)]
        for low in range(int(cells.start[0]), int(end[-1]), PIECE) if len(cells) else ():
            # the padding of ``Cells`` lets every position have eight bytes
            part = cells.data[low:min(low + PIECE, int(end[-1])) + GRAM].astype(np.uint64)
            for step in (1, 2, 4):
                part = (part[:-step] << np.uint64(8 * step)) | part[step:]
            for width in widths:
                gram = part[:-1] >> np.uint64(64 - 8 * width)
                at = np.flatnonzero(listed.take(_cell(gram)))
                row = np.searchsorted(cells.start, low + at, "right") - 1
                inside = low + at + width <= end[row]
                row, number = row[inside], gram[at[inside]].view(np.int64)
                order = np.lexsort((number, row))
                row, number = row[order], number[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1])
                found.append(np.stack([row[new], np.full(new.sum(), width), number[new]]))
        row, width, gram = np.concatenate(found, axis=1)
        order = np.argsort(row, kind="stable")
        return row[order], {"width": width[order], "gram": gram[order]}

    return decode


def _ioc_join_by_prefix(payloads: DataFrame, patterns: DataFrame, payload: str) -> DataFrame:
    listed = patterns.select("ord", F.encode("pattern", "UTF-8").alias("bytes"),
                             F.concat_ws(":", "attack_name", "attack_family").alias("hit"))
    keyed = decoded(listed, _leading_grams, ["ord", "bytes", "hit"], "width bigint, gram bigint, cell bigint")

    # A bit per gram hash, of fixed size, drops most payload positions where they are.
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("cell") % 64).cast("int"))
    words, widths = np.zeros(FILTER_WORDS, np.int64), set()
    for row in keyed.groupBy(F.expr("cell div 64").alias("id")).agg(F.bit_or(bit).alias("bits"), F.collect_set("width").alias("widths")).collect():
        words[row.id] = row.bits
        widths.update(row.widths)

    data = F.col(payload).cast("binary")
    tagged = payloads.withColumn("_id", F.sha2(data, 256))
    texts = tagged.select("_id", data.alias("_data")).filter(F.length("_data") > 0)
    grams = decoded(texts, _grams_found(words, sorted(widths)), ["_id"], "width bigint, gram bigint")
    candidates = materialize(grams.distinct().join(keyed.drop("cell"), ["width", "gram"])
                             .select("_id", "ord", "bytes", "hit").distinct(), "candidates")
    chosen = texts.join(candidates.select("_id").distinct(), "_id", "left_semi").dropDuplicates(["_id"])
    met = (candidates.join(chosen, "_id").filter(F.contains("_data", "bytes"))
           .groupBy("_id").agg(F.min_by("hit", F.struct("ord", "hit")).alias("ioc_hit")))
    return tagged.join(met, "_id", "left").drop("_id")


# --- as-of -----------------------------------------------------------------

def _active_slots(lefts: DataFrame, rights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per (keys, slot) with rows on either side: their first and last tick and the newest right value; right rows alone are put in order."""
    span = [F.min("_tick").alias("_first"), F.max("_tick").alias("_final")]
    given = rights.groupBy(*keys, "_slot").agg(*span, F.max_by("_value", "_pos").alias("_newest"))
    asked = lefts.groupBy(*keys, "_slot").agg(*span, F.lit(None).cast(rights.schema["_value"].dataType).alias("_newest"))
    return asked.unionByName(given).groupBy(*keys, "_slot").agg(
        F.min("_first").alias("_first"), F.max("_final").alias("_final"), F.first("_newest", ignorenulls=True).alias("_newest"))


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
              tick: str = "tick", slot: int = 60, idle_limit: int | None = None) -> DataFrame:
    """Adds ``value``: the latest earlier right row of the same keys, null if there is none.

    ``order`` columns exist on both sides and give the arrival order; on a tie the
    right row comes first. A key may hold most of the left rows, so these are never
    sorted: the right side becomes validity ranges per (keys, slot of ``slot``
    ticks), with the value in force at the start of a slot carried into it, and the
    left rows meet them by an equality join on (keys, slot). A hot key is spread
    over its slots, and what is left of it can be split by adaptive skew handling.

    ``idle_limit`` ends the validity of a right row once the key was silent (no row
    on either side) for longer; it must not be below ``slot``.
    """
    if idle_limit is not None and idle_limit < slot:
        raise ValueError("idle_limit must be at least one slot")
    lefts = left.withColumn("_slot", F.floor(F.col(tick) / slot).cast("bigint"))
    rights = right.select(*keys, F.floor(F.col(tick) / slot).cast("bigint").alias("_slot"),
                          F.col(tick).alias("_tick"), F.struct(*order).alias("_pos"),
                          F.struct(F.col(value).alias("v")).alias("_value"))
    slots = _active_slots(lefts.withColumnRenamed(tick, "_tick"), rights, keys)
    by_key = Window.partitionBy(*keys).orderBy("_slot")
    if idle_limit is None:
        slots = slots.withColumn("_epoch", F.lit(0))
    else:
        silent = F.coalesce((F.col("_first") - F.lag("_final").over(by_key) > idle_limit).cast("int"), F.lit(0))
        slots = slots.withColumn("_silent", silent).withColumn("_epoch", F.sum("_silent").over(by_key))
    earlier = Window.partitionBy(*keys, "_epoch").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select(*keys, "_slot", F.lit(None).cast(rights.schema["_pos"].dataType).alias("_pos"),
                           F.last("_newest", ignorenulls=True).over(earlier).alias("_value"))
    by_slot = Window.partitionBy(*keys, "_slot").orderBy(F.col("_pos").asc_nulls_first())
    ranges = (carried.filter(F.col("_value").isNotNull()).unionByName(rights.drop("_tick"))
              .withColumn("_repeat", F.coalesce(F.col("_value") == F.lag("_value").over(by_slot), F.lit(False)))
              .filter(~F.col("_repeat"))
              .select(*keys, "_slot", F.col("_pos").alias("_since"),
                      F.lead("_pos").over(by_slot).alias("_until"), F.col("_value")["v"].alias(value)))
    place = F.struct(*[F.col(f"l.{name}") for name in order])
    same = [F.col(f"l.{name}") == F.col(f"r.{name}") for name in (*keys, "_slot")]
    in_force = ((F.col("r._since").isNull() | (F.col("r._since") <= place))
                & (F.col("r._until").isNull() | (place < F.col("r._until"))))
    joined = lefts.alias("l").join(ranges.alias("r"), [*same, in_force], "left")
    return joined.select(*[F.col(f"l.{name}") for name in left.columns], F.col(f"r.{value}"))


def asof_in_order(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                  tick: str = "tick", slot: int = 60, heard: DataFrame | None = None) -> DataFrame:
    """``asof_join`` for values that change very often, so that a slot would hold a range for every few left rows.

    Both sides stand in one order inside each (keys, slot), behind the value carried into the slot, and every left row takes
    the last value before it: n log n steps, however many values a slot has. ``heard`` has rows of at least the
    keys and ticks of the left side; it is the left side unless given, and only its keys and ticks are read.
    """
    at = F.floor(F.col(tick) / slot).cast("bigint")
    rights = right.select(*keys, at.alias("_slot"), F.col(tick).alias("_tick"), F.struct(*order).alias("_pos"),
                          F.struct(F.col(value).alias("v")).alias("_value")).dropna(subset=[*keys, "_slot"])
    asked = (left if heard is None else heard).select(*keys, at.alias("_slot"), F.col(tick).alias("_tick")).dropna(subset=[*keys, "_slot"])
    slots = _active_slots(asked, rights, keys)
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select(*keys, "_slot", F.lit(None).cast(rights.schema["_pos"].dataType).alias("_pos"), F.lit(0).alias("_turn"),
                           F.last("_newest", ignorenulls=True).over(earlier).alias("_value")).filter(F.col("_value").isNotNull())
    given = carried.unionByName(rights.select(*keys, "_slot", "_pos", F.lit(1).alias("_turn"), "_value"))

    def of_given(name: str) -> Column:
        found = F.col(name) if name in keys else F.col("_pos")[name] if name in order else F.lit(None).cast(left.schema[name].dataType)
        return found.alias(name)

    added = ["_slot", "_turn", "_value"]
    lefts = left.select(*left.columns, at.alias("_slot"), F.lit(2).alias("_turn"), F.lit(None).cast(rights.schema["_value"].dataType).alias("_value"))
    line = lefts.unionByName(given.select(*map(of_given, left.columns), *added))
    so_far = Window.partitionBy("_slot", *keys).orderBy(*order, "_turn").rowsBetween(Window.unboundedPreceding, 0)
    met = line.withColumn("_value", F.last("_value", ignorenulls=True).over(so_far)).filter(F.col("_turn") == 2)
    return met.select(*left.columns, F.col("_value")["v"].alias(value))


# --- merging sources -------------------------------------------------------

def merge_flow_over_packets(flow_rows: DataFrame, packet_rows: DataFrame,
                            keys: Sequence[str] = ("dst_ip", "tick")) -> DataFrame:
    """Per key the flow row replaces the packet row; rows known to one side stay."""
    names = [name for name in flow_rows.columns if name not in keys]
    left = flow_rows.select(*keys, F.struct(*names).alias("_flow"))
    right = packet_rows.select(*keys, F.struct(*names).alias("_packet"))
    merged = left.join(right, list(keys), "full_outer")
    chosen = F.coalesce("_flow", "_packet")
    return merged.select(*keys, *[chosen[name].alias(name) for name in names],
                         F.when(F.col("_flow").isNotNull(), "flow").otherwise("packet").alias("source"))


def merge_node_sources(counter_rows: DataFrame, flow_rows: DataFrame) -> DataFrame:
    """Counter rates, overruled by flow rates when those are higher.

    Packets and bandwidth move together; protocol shares come from the flows as
    soon as there are any.
    """
    f = flow_rows.select("node_id", "tick", *[F.col(n).alias(f"_{n}") for n in
                                              ("pps", "bps", "tcp_pct", "udp_pct", "icmp_pct", "flow_count")])
    joined = counter_rows.join(f, ["node_id", "tick"], "left")
    higher = F.coalesce(F.col("_pps") > F.col("pps"), F.lit(False))
    seen = F.coalesce(F.col("_flow_count") > 0, F.lit(False))

    def pick(rule: Column, name: str) -> Column:
        return F.when(rule, F.col(f"_{name}")).otherwise(F.col(name)).alias(name)

    return joined.select("node_id", "tick", pick(higher, "pps"), pick(higher, "bps"),
                         *[pick(seen, name) for name in ("tcp_pct", "udp_pct", "icmp_pct")])


# --- intervals -------------------------------------------------------------

def incident_evidence(packets: DataFrame, incidents: DataFrame, order: Sequence[str],
                      during: int | None = None, before: int | None = None, look_back: int | None = None,
                      block: int = 1000) -> DataFrame:
    """Packets of every incident and those before it: all, or the first ``during`` and the last ``before`` ones.

    ``incidents``: dst_ip, incident_id, started_tick, ended_tick; ``order`` breaks ties inside a tick. ``look_back`` limits the
    earlier packets to so many ticks before the start. The packets of attacked destinations are numbered once. An incident is then
    one range of numbers, found from the counts by tick, and meets its packets in blocks of ``block`` numbers: nothing is joined on the
    destination alone, and nothing is ranked by incident. An incident without an end has earlier packets only.
    """
    # read three times below, and costly where incidents come from a detector
    spans = materialize(incidents.select("dst_ip", "incident_id", "started_tick", "ended_tick").distinct(), "incident-spans")
    attacked = packets.filter(F.col("tick").isNotNull()).join(spans.select("dst_ip").distinct(), "dst_ip", "left_semi").select(*packets.columns)
    numbered = placed(attacked, "dst_ip", ["tick", *(name for name in order if name != "tick")])
    counts = numbered.groupBy("dst_ip", F.col("tick").alias("_at")).agg(F.max("_place").alias("_upto"))
    marks = {"_start": ("started_tick", 0, 0), "_end": ("ended_tick", 0, 2), "_floor": ("started_tick", look_back or 0, 0)}
    line = counts.select("dst_ip", "_at", F.lit(1).alias("_turn"), "_upto").unionByName(spans.select("*", F.explode(F.array(*[
        F.struct(F.lit(name).alias("_mark"), (F.col(tick) - earlier).alias("_at"), F.lit(turn).alias("_turn"))
        for name, (tick, earlier, turn) in marks.items()])).alias("_m")).select("*", "_m.*").drop("_m"), allowMissingColumns=True)
    so_far = Window.partitionBy("dst_ip").orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    ranges = (line.withColumn("_seen", F.coalesce(F.max("_upto").over(so_far), F.lit(0))).filter(F.col("_mark").isNotNull())
              .groupBy("dst_ip", "incident_id", "started_tick", "ended_tick").agg(
                  *[F.max(F.when(F.col("_mark") == name, F.col("_seen"))).alias(name) for name in marks]))
    earlier = F.col("_start") - (F.lit(0) if look_back is None else F.col("_floor"))
    inside = F.greatest(F.col("_end") - F.col("_start"), F.lit(0))
    first = F.col("_start") - (earlier if before is None else F.least(earlier, F.lit(before))) + 1
    last = F.col("_start") + (inside if during is None else F.least(inside, F.lit(during)))
    ranges = ranges.withColumn("_from", first).withColumn("_to", last).filter(F.col("_from") <= F.col("_to")).withColumn(
        "_block", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor(F.col("_to") / block))))
    met = (numbered.withColumn("_block", F.floor(F.col("_place") / block)).join(ranges, ["dst_ip", "_block"])
           .filter(F.col("_place").between(F.col("_from"), F.col("_to"))))
    later = F.col("_place") > F.col("_start")
    return met.select(
        *packets.columns, "incident_id", "started_tick", "ended_tick",
        F.when(later, F.col("_place") - F.col("_start")).otherwise(F.col("_start") - F.col("_place") + 1).alias("position"),
        F.when(later, "during").otherwise("before").alias("phase"))


def correlate_l3_l7(http_incidents: DataFrame, node_incidents: DataFrame) -> DataFrame:
    """Flags HTTP incidents that open while a packet flood is open on the same node.

    Both sides are incident lists: node_id, incident_id, started_tick, ended_tick; a flood without an end is open.
    """
    counted = open_spans(http_incidents, node_incidents, "node_id", count="_open_floods")
    return counted.withColumn("correlated_l3l4", F.col("_open_floods") > 0).drop("_open_floods")


def nonservice_connections(connections: DataFrame, ports: DataFrame) -> DataFrame:
    """Connections whose destination port is not a service port. ``ports``: port."""
    listed = ports.select(F.col("port").alias("dport")).distinct()
    return connections.join(listed, "dport", "left_anti")

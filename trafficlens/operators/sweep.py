"""Ordered passes and interval joins that never pair all rows of a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trafficlens.session import materialize


def ordered_pass(rows: DataFrame, key: str, fresh: Callable[[], Callable[..., tuple]], fields: str) -> DataFrame:
    """The rows with the columns ``fields`` that a step function finds, key by key in tick order.

    The first column of ``rows`` is ``key``. ``fresh()`` gives the step of a new key; a step takes the other columns of a row and
    returns the values of ``fields``. A task holds one Arrow batch and the state of one key, whatever the length of a history.
    """
    added = T.StructType.fromDDL(fields)
    schema = T.StructType([*rows.schema.fields, *added.fields])
    arrow = to_arrow_schema(schema)
    kinds = [arrow.field(f.name).type for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, step = object(), None
        for batch in batches:
            found = []
            for name, *values in zip(*(column.to_pylist() for column in batch.columns)):
                if name != current:
                    current, step = name, fresh()
                found.append(step(*values))
            new = zip(*found) if found else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, t) for v, t in zip(new, kinds))], schema=arrow)

    return rows.repartition(key).sortWithinPartitions(key, "tick").mapInArrow(run, schema)


def placed(rows: DataFrame, key: str, order: Sequence[str], place: str = "_place") -> DataFrame:
    """The rows with their 1-based position in their key, by ``order``.

    Rows are dealt into ranges of (key, order); the rows of a key in all earlier ranges, counted range by range,
    are the offset of its positions in a range. So a task orders one range at the most, however many
    rows a key has. Rows equal in all of these columns are interchangeable.
    """
    ranged = rows.repartitionByRange(key, *order).withColumn("_range", F.spark_partition_id())
    # Ranges are sampled: written once, so that counts and positions speak of the same ones.
    ranged = materialize(ranged, "row-ranges")
    counts = ranged.groupBy(key, "_range").agg(F.count(F.lit(1)).alias("_count"))
    earlier = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(key).alias("_key"), F.col("_range").alias("_part"),
                            F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(key, "_range").orderBy(*order)
    found = ranged.withColumn("_n", F.row_number().over(inside)).join(
        offsets, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_part")))
    return found.select(*rows.columns, (F.col("_n") + F.col("_offset")).alias(place))


def within(rows: DataFrame, spans: DataFrame, key: str, first: str | Column = "started_tick", last: str | Column = "ended_tick",
           width: int = 60) -> DataFrame:
    """Rows beside each span of their key that holds their tick, both ends included.

    A span stands in every slot of ``width`` ticks that it touches, so a row meets the spans of its own slot and not all
    of its key. Spans without an end, or that end before they start, hold nothing.
    """
    first, last = (F.col(c) if isinstance(c, str) else c for c in (first, last))
    slotted = spans.withColumn("_first", first).withColumn("_last", last).filter(F.col("_first") <= F.col("_last"))
    slotted = slotted.withColumn("_slot", F.explode(F.sequence(F.floor(F.col("_first") / width), F.floor(F.col("_last") / width))))
    met = rows.withColumn("_slot", F.floor(F.col("tick") / width)).join(slotted, [key, "_slot"])
    return met.filter(F.col("tick").between(F.col("_first"), F.col("_last"))).drop("_slot", "_first", "_last")


def open_spans(points: DataFrame, spans: DataFrame, key: str, tick: str = "started_tick", first: str = "started_tick",
               last: str = "ended_tick", count: str = "open_spans", width: int = 3600) -> DataFrame:
    """The points with the number of spans of their key that are open at their tick, both ends included.

    One sweep: starts, points and ends stand in one order of (key, tick), and the number of open spans is a running sum.
    It runs inside slots of ``width`` ticks; what is open at the end of a slot is carried into the next as one number, so neither
    a key with many spans nor one with many points is ordered in one task. A span without an end stays open.
    """
    known = spans.filter(F.col(key).isNotNull() & (F.col(last).isNull() | (F.col(first) <= F.col(last)))).select(
        F.col(key).alias("_key"), F.col(first).alias("_first"), F.col(last).alias("_last"))
    kind = T.StructType(points.schema.fields)
    absent = F.lit(None).cast(kind)

    def turn(at: str, number: int, step: int) -> DataFrame:
        return known.filter(F.col(at).isNotNull()).select(
            "_key", F.col(at).alias("_at"), F.lit(number).alias("_turn"), F.lit(step).alias("_step"), absent.alias("_row"))

    asked = points.select(F.col(key).alias("_key"), F.col(tick).alias("_at"), F.lit(1).alias("_turn"), F.lit(0).alias("_step"),
                          F.struct(*points.columns).alias("_row"))
    line = turn("_first", 0, 1).unionByName(asked).unionByName(turn("_last", 2, -1)).withColumn("_slot", F.floor(F.col("_at") / width))
    slots = line.groupBy("_key", "_slot").agg(F.sum("_step").alias("_change"))
    before = Window.partitionBy("_key").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select("_key", "_slot", F.coalesce(F.sum("_change").over(before), F.lit(0)).alias("_carried"))
    inside = Window.partitionBy("_key", "_slot").orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    run = line.withColumn("_open", F.sum("_step").over(inside)).filter(F.col("_turn") == 1)
    return run.join(carried, ["_key", "_slot"], "left").select(
        "_row.*", (F.col("_open") + F.coalesce("_carried", F.lit(0))).alias(count))

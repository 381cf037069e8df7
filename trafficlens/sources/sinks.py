"""Incident and baseline tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.operators.detect import restorable
from trafficlens.sources.versioned import VersionedTable


def write_incidents(events: DataFrame, path: str) -> None:
    """Append open, update and resolve records."""
    events.write.mode("append").parquet(path)


def incident_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps all records; a repeated batch replaces its own folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")
    return write


def current_incidents(events: DataFrame) -> DataFrame:
    """Latest record of every incident; a resolve outranks an update of the same tick."""
    names = [name for name in events.columns if name not in ("key", "started_tick")]
    rank = F.struct(F.col("tick"), (F.col("event") == "resolve").cast("int"))
    latest = events.groupBy("key", "started_tick").agg(F.max_by(F.struct(*names), rank).alias("r"))
    return latest.select("key", "started_tick", "r.*")


def upsert_incidents(table: VersionedTable, events: DataFrame, batch_id: int) -> None:
    """The state of every incident after a batch of records, as the version of that batch.

    It is made from the newest version of an earlier batch, so a batch that comes twice gives the same version.
    """
    earlier = table.read(before=batch_id)
    table.write(current_incidents(events if earlier is None else earlier.unionByName(events)), batch_id)


def incident_table_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the state of every incident; read it with ``VersionedTable``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_incidents(VersionedTable(batch.sparkSession, path), batch, batch_id)
    return write


def save_baselines(states: DataFrame, path: str) -> None:
    """Saves detector states as a new version; ``states`` may come from the one saved before."""
    VersionedTable(states.sparkSession, path).write(states)


def load_baselines(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """Saved detector states that are complete and fresh enough to start from."""
    saved = VersionedTable(spark, path).read()
    if saved is None:
        saved = spark.createDataFrame([], "key string, tick bigint, state string")
    return restorable(saved.select("key", "tick", "state"), now)

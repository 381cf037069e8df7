"""Shared helpers: reading tables, cutting lineage, walking texts in bounded slices, hashing."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that Python handles at a time; longer single texts come alone.
SLICE_CHARS = 1_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and read it from there.

    The folder is the one of ``spark.checkpoint.dir``. Only a local master, where all
    tasks share one machine, may do without the setting.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
        if not folder:
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def free_names(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each with as many underscores in front as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return tuple(out)


#: Rows of a lookup table that every executor may hold.
LOOKUP_ROWS = 100_000


def looked_up(table: DataFrame) -> DataFrame:
    """A stored table of a few narrow columns as the side of a join: sent to every task if its rows are counted and few, shuffled else."""
    return F.broadcast(table) if table.count() <= LOOKUP_ROWS else table


#: Rows of a few numbers that a partition is worth.
NARROW_ROWS = 100_000


def compacted(df: DataFrame) -> DataFrame:
    """``checkpointed`` rows of a few numbers, read in as many partitions as they need: a loop over them then shuffles fewer files."""
    stored = checkpointed(df)
    return stored.coalesce(max(1, -(-stored.count() // NARROW_ROWS)))


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their ``text`` column as strings (null: empty), each of about ``limit`` characters."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        start = 0
        sizes = np.diff(np.asarray(_offsets(batch.column(at))))
        ends = np.cumsum(sizes)
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            part = batch.slice(start, stop - start)
            yield part, [x or "" for x in part.column(at).to_pylist()]
            start = stop


def _offsets(column: pa.Array) -> np.ndarray:
    wide = column.type in (pa.large_string(), pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    return offsets[column.offset : column.offset + len(column) + 1]


def splitmix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value of each 64-bit value."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: An odd base of polynomial hashes modulo 2**64, and its inverse.
BASE = 0x5851F42D4C957F2D
BASE_INVERSE = pow(BASE, -1, 1 << 64)


class Powers:
    """Powers of the base and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def grown(self, size: int) -> "Powers":
        if len(self.up) < size:
            size = max(size, 2 * len(self.up))
            for name, base in (("up", BASE), ("down", BASE_INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self


POWERS = Powers()


def prefix_hashes(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash of 64-bit symbols: n + 1 values for n symbols."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * POWERS.grown(len(symbols) + 1).up[: len(symbols)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans, equal for equal contents wherever they stand."""
    plain = (prefix[ends] - prefix[starts]) * POWERS.grown(len(prefix)).down[starts]
    return splitmix(plain ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))

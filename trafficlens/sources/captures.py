"""Large capture files, read by several tasks.

A capture file has no marks between its records. Each byte range finds its first record by a chain of plausible
record headers and walks on from there; then the ranges of a file are checked against each other in order. The first range is
certain, and a range is right where the one before it ends on its first record. Only a range that began in a
wrong place is walked again, from the right one. So the frames are those of one reader from the start of the file, whatever the packets hold.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens import schemas
from trafficlens.sources.frames import FILE_HEADER, MAGIC, RECORD_HEADER

#: Bytes of a range, and bytes that a reader holds at a time.
PART_BYTES = 64 << 20
WINDOW_BYTES = 4 << 20
#: Bytes that are worth a task, and the most tasks of a step.
LEAST_TASK_BYTES = 1 << 20
MOST_TASKS = 20_000
#: Headers in a row that must look like headers, the largest packet of one, and seconds that it may lie off the first one.
CHAIN = 6
LARGEST_FRAME = 1 << 18
NEAR_SECONDS = 400 * 86_400
#: Where a file ends whose last record is cut off: beyond all ranges.
CUT_OFF = 1 << 62
_FRAMES_IN_BATCH = 4096


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and name in it of a path as Spark writes it, which is not percent-encoded."""
    if path.startswith("file:") or "://" not in path:
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(quote(path, safe=":/@"))


class Capture:
    """An open capture file; ``order`` is None where it is no capture."""

    def __init__(self, path: str, length: int):
        self.path, self.length = path, length
        system, name = _file_system(path)
        self.file = system.open_input_file(name)
        self.at, self.data = 0, b""
        head = self.bytes(0, FILE_HEADER)
        known = MAGIC.get(head[:4]) if len(head) == FILE_HEADER else None
        self.order, self.nanoseconds = known or (None, 1)
        if known:
            self.record = struct.Struct(self.order + "IIII")
            self.link_type = struct.unpack_from(self.order + "I", head, 20)[0]
            self.first_second = self.record.unpack(self.bytes(FILE_HEADER, RECORD_HEADER))[0] if length >= FILE_HEADER + RECORD_HEADER else 0

    def bytes(self, position: int, size: int) -> bytes:
        """Bytes of the file, from a window that moves forward; fewer at the end."""
        if position < self.at or position + size > self.at + len(self.data):
            self.at, self.data = position, self.file.read_at(max(0, min(max(size, WINDOW_BYTES), self.length - position)), position)
        return self.data[position - self.at:position - self.at + size]

    def header(self, position: int) -> tuple[int, int, int, int] | None:
        head = self.bytes(position, RECORD_HEADER)
        return self.record.unpack(head) if len(head) == RECORD_HEADER else None

    def plausible(self, position: int) -> bool:
        """Whether a chain of records, or the last records of the file, may begin here."""
        for _ in range(CHAIN):
            if position == self.length:
                return True
            head = self.header(position)
            if head is None:
                return False
            seconds, fraction, kept, original = head
            if (kept > original or not original or original > LARGEST_FRAME or fraction * self.nanoseconds >= 10**9
                    or abs(seconds - self.first_second) > NEAR_SECONDS):
                return False
            position += RECORD_HEADER + kept
        return position <= self.length

    def guess(self, begin: int, end: int) -> int:
        """The first place of a range where records may begin, or -1: not found within the largest packet."""
        last = min(end, self.length - RECORD_HEADER + 1, begin + RECORD_HEADER + LARGEST_FRAME)
        return next((at for at in range(begin, last) if self.plausible(at)), -1)

    def frames(self, start: int, end: int) -> Iterator[tuple[int, tuple | None]]:
        """Place and header of each record that begins in ``start`` to ``end``, and at last the place of the next one without a header."""
        while start < end:
            head = self.header(start)
            if head is None or start + RECORD_HEADER + head[2] > self.length:
                start = CUT_OFF
                break
            yield start, head
            start += RECORD_HEADER + head[2]
        yield start, None

    def walk(self, start: int, end: int) -> tuple[int, int]:
        """Place behind the records that begin before ``end``, and how many these are."""
        count = -1
        for place, _ in self.frames(start, end):
            count += 1
        return place, count


WALKED = "path string, length long, part long, begin long, end long, first long, next long, count long"


def _walk_guesses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for path, length, part, begin, end in batch.itertuples(index=False, name=None):
            capture = Capture(path, length)
            if capture.order is None:
                continue
            first = FILE_HEADER if part == 0 else capture.guess(begin, end)
            after, count = capture.walk(first, end) if first >= 0 else (-1, 0)
            out.append((path, length, part, begin, end, first, after, count))
        yield pd.DataFrame(out, columns=[field.split()[0] for field in WALKED.split(", ")])


def _settle(ranges: pd.DataFrame) -> pd.DataFrame:
    """Ranges of one file with their right first record, and the number of frames before each; ranges without frames go."""
    out, expected, number = [], FILE_HEADER, 0
    capture = None
    for path, length, part, begin, end, first, after, count in ranges.sort_values("part").itertuples(index=False, name=None):
        if expected >= end:
            continue
        if first != expected:
            capture = capture or Capture(path, length)
            first = expected
            after, count = capture.walk(first, end)
        out.append((path, length, part, first, end, number, count))
        expected, number = after, number + count
    return pd.DataFrame(out, columns=["path", "length", "part", "first", "end", "number", "count"])


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []
    for batch in batches:
        for path, length, first, end, number in batch.itertuples(index=False, name=None):
            capture = Capture(path, length)
            for place, head in capture.frames(first, end) if capture.order else ():
                if head is None:
                    break
                seconds, fraction, kept, original = head
                time = seconds * 1_000_000 + fraction * capture.nanoseconds // 1000
                rows.append((path, number, time, capture.link_type, original, bytes(capture.bytes(place + RECORD_HEADER, kept))))
                number += 1
                if len(rows) >= _FRAMES_IN_BATCH:
                    yield pd.DataFrame(rows, columns=schemas.FRAMES.names)
                    rows = []
    yield pd.DataFrame(rows, columns=schemas.FRAMES.names)


def write_captures(files: DataFrame, folder: str) -> int:
    """Writes rows of path, content as files of a shared folder and counts them; a task that runs again writes the same files."""
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                system, base = _file_system(folder)
                system.create_dir(base, recursive=True)
                with system.open_output_stream(f"{base}/{name}") as out:
                    out.write(bytes(content))
            yield batch[["path"]]

    return files.select("path", "content").mapInPandas(write, "path string").count()


def _tasks(files: DataFrame, part_bytes: int) -> int:
    """Tasks for the bytes of the files: their rows are too small for adaptive execution to see the work behind them."""
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return max(1, min(-(-total // max(part_bytes, LEAST_TASK_BYTES)), MOST_TASKS))


def settled_ranges(files: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """path, length, part, first, end, number, count: byte ranges of captures with their first record. ``files``: path, length.

    The headers of a range are walked by one task. The check by file reads one row for each range; a file of one range needs
    neither, and has no count.
    """
    files = files.select("path", "length")
    alone = files.filter((F.col("length") > FILE_HEADER) & (F.col("length") <= part_bytes)).selectExpr(
        "path", "length", "0L AS part", f"{FILE_HEADER}L AS first", "length AS end", "0L AS number", "CAST(NULL AS bigint) AS count")
    files = files.filter(F.col("length") > part_bytes)
    parts = files.filter(F.col("length") >= FILE_HEADER).select(
        "path", "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / part_bytes))).alias("part"))
    ranges = parts.select("path", "length", "part", (F.col("part") * part_bytes).alias("begin"),
                          F.least((F.col("part") + 1) * part_bytes, "length").alias("end"))
    walked = ranges.repartition(_tasks(files, part_bytes), "path", "part").mapInPandas(_walk_guesses, WALKED)
    settled = walked.groupBy("path").applyInPandas(_settle, "path string, length long, part long, first long, end long, number long, count long")
    return settled.unionByName(alone)


def read_large_pcap(spark: SparkSession, path: str, part_bytes: int = PART_BYTES, glob: str = "*.pcap") -> DataFrame:
    """Frames of the capture files below ``path``, as ``frames.read_pcap`` gives them, with several tasks for a large file.

    Files are listed by Spark and opened by Arrow, so the path must be one that both know (local and shared folders, hdfs, s3, gs).
    They are read twice: once for the places of their records. A file may exceed the 2 GB that a row can hold.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length")
    found = settled_ranges(files, part_bytes).filter("count IS NULL OR count > 0").select("path", "length", "first", "end", "number")
    return found.repartition(_tasks(files, part_bytes), "path", "first").mapInPandas(_read, schemas.FRAMES)

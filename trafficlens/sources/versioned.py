"""A table that is replaced version by version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Versions that stay, so that what still reads an older one can finish.
KEPT = 3


class VersionedTable:
    """Folders of a path, one for each version; the newest that was written to its end is the table.

    Spark's mark of a finished write switches the version, so a reader never sees half of one, and a plan may
    read the current version and write the next. Writing a version again replaces it, so a repeated batch changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._path = hadoop
        self._files = hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _folder(self, version: int) -> str:
        return f"{self.path}/version={version}"

    def versions(self) -> list[int]:
        """The finished versions, oldest first."""
        if not self._files.exists(self._path(self.path)):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(self.path))]
        found = sorted(int(name.removeprefix("version=")) for name in names if name.startswith("version="))
        return [v for v in found if self._files.exists(self._path(f"{self._folder(v)}/_SUCCESS"))]

    def read(self, before: int | None = None) -> DataFrame | None:
        """The newest version, or the newest one older than ``before``; None if there is none."""
        found = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.parquet(self._folder(found[-1])) if found else None

    def write(self, rows: DataFrame, version: int | None = None) -> int:
        """Writes the rows as a version, the next one if none is named, and drops what lies ``KEPT`` versions back."""
        if version is None:
            version = max(self.versions(), default=-1) + 1
        rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(self._folder(version))
        for old in [v for v in self.versions() if v < version][:-KEPT + 1 or None]:
            self._files.delete(self._path(self._folder(old)), True)
        return version

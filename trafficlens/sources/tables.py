"""Readers for telemetry tables and small lookup tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens import schemas


def _read(spark: SparkSession, path: str, schema: T.StructType, streaming: bool) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).parquet(path)


def read_flows(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    return _read(spark, path, schemas.FLOWS, streaming)


def read_datagrams(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    return _read(spark, path, schemas.DATAGRAMS, streaming)


def read_packets(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    return _read(spark, path, schemas.PACKETS, streaming)


def read_http_requests(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    return _read(spark, path, schemas.HTTP_REQUESTS, streaming)


def read_counters(spark: SparkSession, path: str, fmt: str = "parquet", streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    reader = reader.schema(schemas.COUNTERS).format(fmt)
    return (reader.option("header", "true") if fmt == "csv" else reader).load(path)


def parse_connections(lines: DataFrame, line: str = "line") -> DataFrame:
    """Source address and destination port of connection-tracking lines."""
    source = F.regexp_extract(line, r"src=(\d+\.\d+\.\d+\.\d+)", 1)
    port = F.regexp_extract(line, r"dport=(\d+)", 1)
    others = [name for name in lines.columns if name != line]
    return (lines.select(*others, source.alias("src_ip"), port.try_cast("bigint").alias("dport"))
            .filter((F.col("src_ip") != "") & F.col("dport").isNotNull()))


def read_connections(spark: SparkSession, path: str) -> DataFrame:
    return parse_connections(spark.read.text(path).withColumnRenamed("value", "line"))


def expand_ports(config: DataFrame, column: str = "port_value") -> DataFrame:
    """One row per port of a list such as ``80,443,8000-8100``; unreadable parts drop out."""
    part = F.trim("part")
    low = F.when(part.contains("-"), F.trim(F.substring_index(part, "-", 1))).otherwise(part).try_cast("bigint")
    high = F.when(part.contains("-"), F.trim(F.substring_index(part, "-", -1))).otherwise(part).try_cast("bigint")
    others = [name for name in config.columns if name != column]
    parts = config.select(*others, F.explode(F.split(column, ",")).alias("part"))
    return (parts.select(*others, low.alias("low"), high.alias("high"))
            .filter(F.col("low").between(0, 65535) & F.col("high").between(F.col("low"), 65535))
            .select(*others, F.explode(F.sequence("low", "high")).alias("port")))


def read_dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A lookup table kept as JSON lines: labels, subnets, safelist, ports, patterns or blocklist."""
    return spark.read.schema(schema).json(path)


# Schemas of the lookup tables.
LABELS = "ip string, label string"
SUBNETS = "network string, prefix_len bigint"
SAFELIST = "entry string"
SERVICE_PORTS = "protocol string, port_value string"
IOC_PATTERNS = "ord bigint, pattern string, attack_name string, attack_family string"
BLOCKLIST = "indicator string"

"""Web access logs: combined/CLF lines and JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.functions.http import http_version

# Fixed value: combined/CLF line; groups are ip, time, method, uri, protocol, status, size, agent.
COMBINED = (r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s+(HTTP/\S+)"\s+(\d{3})\s+(\S+)'
            r'(?:\s+"[^"]*"\s+"([^"]*)")?')

# Accepted JSON keys per field; the first one with a value is used.
JSON_KEYS = {
    "ip": ("remote_addr", "client_ip", "host", "remoteAddress", "remote_ip", "clientip"),
    "method": ("method", "request_method", "httpMethod"),
    "path": ("uri", "path", "request_uri", "url", "pathname"),
    "status": ("status", "status_code", "statusCode", "response_code"),
    "size": ("body_bytes_sent", "bytes", "content_length", "responseSize"),
    "ua": ("http_user_agent", "user_agent", "userAgent", "user-agent"),
    "resp_time": ("request_time", "response_time", "duration", "latency"),
    "protocol": ("server_protocol", "protocol", "httpVersion", "http_version"),
}


def _first_of(json: Column, field: str, zero_is_empty: bool = False) -> Column:
    values = []
    for key in JSON_KEYS[field]:
        value = json.getItem(key)
        filled = value != ""
        if zero_is_empty:
            filled = filled & (F.coalesce(value.try_cast("double"), F.lit(1.0)) != 0)
        values.append(F.when(filled, value))
    return F.coalesce(*values)


def parse_access_lines(lines: DataFrame, line: str = "line", match_full_uri: bool = False) -> DataFrame:
    """Request columns for every readable line; the other columns stay.

    A CLF line loses the query part of its path unless ``match_full_uri`` is set; a
    JSON line keeps it. Unreadable lines, and JSON lines without address or status,
    are left out.
    """
    text = F.col(line)
    is_json = text.startswith("{")
    keys = sorted({key for names in JSON_KEYS.values() for key in names})
    schema = "struct<" + ",".join(f"`{key}`:string" for key in keys) + ">"
    json = F.from_json(text, schema)

    def clf(group: int) -> Column:
        return F.regexp_extract(text, COMBINED, group)

    uri = clf(4)
    clf_path = uri if match_full_uri else F.substring_index(uri, "?", 1)
    elapsed = _first_of(json, "resp_time", True).try_cast("double")
    milliseconds = F.when(elapsed < 100, elapsed * 1000).otherwise(elapsed)
    fields = {
        "ip": F.when(is_json, _first_of(json, "ip")).otherwise(clf(1)),
        "method": F.when(is_json, F.coalesce(_first_of(json, "method"), F.lit("GET"))).otherwise(clf(3)),
        "path": F.when(is_json, F.coalesce(_first_of(json, "path"), F.lit("/"))).otherwise(clf_path),
        "status": F.when(is_json, _first_of(json, "status", True).try_cast("bigint"))
        .otherwise(clf(6).try_cast("bigint")),
        "size": F.when(is_json, F.coalesce(_first_of(json, "size", True).try_cast("bigint"), F.lit(0)))
        .otherwise(F.coalesce(clf(7).try_cast("bigint"), F.lit(0))),
        "ua": F.when(is_json, F.coalesce(_first_of(json, "ua"), F.lit(""))).otherwise(clf(8)),
        "resp_time_ms": F.when(is_json, milliseconds),
        "http_version": http_version(F.when(is_json, _first_of(json, "protocol")).otherwise(clf(5))),
    }
    readable = (F.coalesce(F.col("ip"), F.lit("")) != "") & (F.coalesce("status", F.lit(0)) != 0)
    others = [name for name in lines.columns if name != line and name not in fields]
    return lines.select(*others, *[column.alias(name) for name, column in fields.items()]).filter(readable)


def read_access_log(spark: SparkSession, path: str, match_full_uri: bool = False) -> DataFrame:
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    return parse_access_lines(lines, match_full_uri=match_full_uri)

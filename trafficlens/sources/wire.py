"""Fields of many binary values at once: positions and values are arrays, one entry for each row.

Decoders run once over an Arrow batch. Lists of unknown length are walked in step: each
round reads the next item of every row that still has one, to the end of its data.
"""

from __future__ import annotations

import socket
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trafficlens.functions.network import GRE, TCP, UDP

# Ether types, VLAN tags, IPv6 extension headers, flags that lengthen a tunnel header.
ETHER_IPV4, ETHER_IPV6 = 0x0800, 0x86DD
VLAN_TAGS = (0x8100, 0x88A8)
EXTENSION_HEADERS = (0, 43, 44, 60)
GRE_OPTIONS = (0x8000, 0x2000, 0x1000)
_PADDING = 64


class Cells:
    """Bytes of rows, each a span of one buffer. Reading past the end gives zeros or a neighbour's bytes; check ``size``."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        self.data, self.start, self.size = data, start, size

    @classmethod
    def of(cls, column: pa.Array) -> "Cells":
        wide = column.type in (pa.large_binary(), pa.large_string())
        offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        buffer = column.buffers()[2]
        data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
        size = np.where(np.asarray(column.is_null()), 0, np.diff(offsets))
        return cls(np.concatenate([data, np.zeros(_PADDING, np.uint8)]), offsets[:-1], size)

    def rows(self, chosen: np.ndarray) -> "Cells":
        return Cells(self.data, self.start[chosen], self.size[chosen])

    def part(self, at: np.ndarray, size: np.ndarray) -> "Cells":
        """The same rows, cut to ``size`` bytes from ``at`` on."""
        return Cells(self.data, self.start + at, size)

    def __len__(self) -> int:
        return len(self.start)

    def byte(self, at: np.ndarray | int) -> np.ndarray:
        return self.data[np.clip(self.start + at, 0, len(self.data) - 1)].astype(np.int64)

    def number(self, at: np.ndarray | int, width: np.ndarray | int) -> np.ndarray:
        """Unsigned big-endian numbers of up to 8 bytes; those beyond 63 bits are the largest number there is."""
        width = np.broadcast_to(width, self.start.shape)
        value = np.zeros(len(self), np.uint64)
        for k in range(int(width.max(initial=0))):
            there = k < width
            value = np.where(there, (value << np.uint64(8)) | self.byte(at + k).astype(np.uint64), value)
        return np.minimum(value, np.uint64(2**63 - 1)).astype(np.int64)

    def u16(self, at: np.ndarray | int) -> np.ndarray:
        return self.number(at, 2)

    def u32(self, at: np.ndarray | int) -> np.ndarray:
        return self.number(at, 4)

    def pieces(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a : a + n] for a, n in zip(self.start.tolist(), self.size.tolist())]

    def addresses(self, at: np.ndarray, v6: np.ndarray) -> list[str]:
        """Text of the IPv4 or IPv6 addresses at the positions; equal ones are written once."""
        out = np.empty(len(self), object)
        for family, width, chosen in ((socket.AF_INET, 4, ~v6), (socket.AF_INET6, 16, v6)):
            rows = np.flatnonzero(chosen)
            if len(rows):
                index = np.clip((self.start + at)[rows, None] + np.arange(width), 0, len(self.data) - 1)
                raw, inverse = np.unique(self.data[index].view(np.uint32 if width == 4 else f"V{width}").ravel(), return_inverse=True)
                octets = raw.view(np.uint8).reshape(-1, width).tolist()
                texts = np.array([f"{a}.{b}.{c}.{d}" for a, b, c, d in octets] if width == 4 else [socket.inet_ntop(family, bytes(x)) for x in octets], object)
                out[rows] = texts[inverse]
        return out.tolist()


def walk(first: np.ndarray, most: np.ndarray, end: np.ndarray, header: int, size_of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items of length-prefixed lists: row, number in its row and position of each, row by row.

    ``size_of(rows, positions)`` is the whole size of the items there; a list ends after ``most`` items, where
    fewer than ``header`` bytes are left before ``end``, or where a size is not positive.
    """
    rows = np.flatnonzero((most > 0) & (first + header <= end))
    position, found, number = first[rows], [], 0
    while len(rows):
        size = size_of(rows, position)
        good = size > 0
        rows, position, size = rows[good], position[good], size[good]
        found.append((rows, np.full(len(rows), number), position))
        number += 1
        position = position + size
        on = (most[rows] > number) & (position + header <= end[rows])
        rows, position = rows[on], position[on]
    row, number_, at = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    order = np.argsort(row, kind="stable")
    return row[order], number_[order], at[order]


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and number in its row of ``counts`` items of each row."""
    counts = np.maximum(counts, 0)
    return np.repeat(np.arange(len(counts)), counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def transport(frame: Cells, protocol: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Ports, flags and the payload's position (-1: none) for TCP and UDP."""
    tcp = (protocol == TCP) & (at + 14 <= frame.size)
    ports = tcp | ((protocol == UDP) & (at + 4 <= frame.size))
    data_at = np.where(tcp, at + (frame.byte(at + 12) >> 4) * 4, np.where(protocol == UDP, at + 8, -1))
    return {"src_port": np.where(ports, frame.u16(at), 0), "dst_port": np.where(ports, frame.u16(at + 2), 0),
            "tcp_flags": np.where(tcp, frame.byte(at + 13), 0), "data_at": data_at}


def link_header(frame: Cells, cooked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ether type and position of what a frame carries, behind all VLAN tags; a cut-off tag leaves type -1."""
    kind, at = frame.u16(np.where(cooked, 14, 12)), np.where(cooked, 16, 14)
    while (tagged := np.isin(kind, VLAN_TAGS) & ~cooked).any():
        kind = np.where(tagged, np.where(at + 4 <= frame.size, frame.u16(at + 2), -1), kind)
        at = at + np.where(tagged, 4, 0)
    return kind, at


def ip_header(frame: Cells, at: np.ndarray, kind: np.ndarray) -> dict[str, np.ndarray]:
    """Fields of the IP headers at ``at``; ``whole`` marks complete ones."""
    first = frame.byte(at)
    length = (first & 15) * 4
    v6 = kind == ETHER_IPV6
    whole4 = (kind == ETHER_IPV4) & (at + 20 <= frame.size) & (first >> 4 == 4) & (length >= 20) & (at + length <= frame.size)
    whole6 = v6 & (at + 40 <= frame.size) & (first >> 4 == 6)
    fragment = frame.u16(at + 6)
    return {"whole": whole4 | whole6, "v6": v6, "protocol": np.where(v6, frame.byte(at + 6), frame.byte(at + 9)),
            "pkt_len": np.where(v6, frame.u16(at + 4) + 40, frame.u16(at + 2)), "ttl": np.where(v6, frame.byte(at + 7), frame.byte(at + 8)),
            "is_fragment": ~v6 & (((fragment & 0x2000) != 0) | ((fragment & 0x1FFF) != 0)),
            "src_at": at + np.where(v6, 8, 12), "dst_at": at + np.where(v6, 24, 16), "next": at + np.where(v6, 40, length)}


def tunnelled(frame: Cells, ip: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that carry IP in a GRE header, and position and ether type of what is inside."""
    at = ip["next"]
    flags, kind = frame.u16(at), frame.u16(at + 2)
    start = at + 4 + sum(np.where(flags & bit, 4, 0) for bit in GRE_OPTIONS)
    inside = ip["whole"] & (ip["protocol"] == GRE) & (at + 4 <= frame.size) & np.isin(kind, (ETHER_IPV4, ETHER_IPV6)) & (start < frame.size)
    return inside, start, kind


def transport_start(frame: Cells, ip: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Protocol and position behind all IPv6 extension headers."""
    protocol, at = ip["protocol"], ip["next"]
    while (more := ip["v6"] & np.isin(protocol, EXTENSION_HEADERS) & (at + 2 <= frame.size)).any():
        protocol, at = np.where(more, frame.byte(at), protocol), np.where(more, at + (frame.byte(at + 1) + 1) * 8, at)
    return protocol, at


def dns_name(message: bytes) -> str | None:
    """Query name of a DNS request, with the final dot; None for answers and other data."""
    if len(message) < 13 or message[2] >= 128 or not int.from_bytes(message[4:6], "big"):
        return None
    at, name = 12, ""
    while at < len(message) and 1 <= message[at] <= 63 and at + 1 + message[at] <= len(message):
        name += message[at + 1 : at + 1 + message[at]].decode("latin-1") + "."
        at += 1 + message[at]
    return name or "."


def batches_of(decode: Callable[[pa.RecordBatch], tuple[np.ndarray, dict]], kept: list[str], schema: pa.Schema) -> Callable:
    """A function for mapInArrow: ``decode`` gives, for a batch, the input row of each output row, and new columns.

    ``kept`` columns of the input row come along.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, columns = decode(batch)
            taken = pa.array(rows, pa.int64())
            values = [batch.column(batch.schema.get_field_index(f.name)).take(taken) if f.name in kept else pa.array(columns[f.name], f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(values, schema=schema)

    return run


def decoded(rows: DataFrame, decode: Callable[[pa.RecordBatch], tuple[np.ndarray, dict]], kept: list[str], added: str) -> DataFrame:
    """``decode`` over the batches of ``rows``; the ``kept`` columns of the input row come along."""
    schema = T.StructType([*rows.select(*kept).schema.fields, *T.StructType.fromDDL(added).fields])
    return rows.mapInArrow(batches_of(decode, kept, to_arrow_schema(schema)), schema)

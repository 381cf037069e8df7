"""Fields of binary columns as column expressions; offsets are 0-based bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trafficlens.functions.binding import bind
from trafficlens.functions.network import inet4


def _offset(position: Column | int) -> Column:
    return (F.lit(position) if isinstance(position, int) else position).cast("int")


def piece(data: Column, start: Column | int, length: Column | int) -> Column:
    return F.substring(data, _offset(start) + 1, _offset(length))


def number(data: Column, start: Column | int, length: Column | int) -> Column:
    """Unsigned big-endian number of up to 7 bytes (8 while it fits a bigint); null past the end."""
    return F.conv(F.hex(piece(data, start, length)), 16, 10).try_cast("bigint")


def u8(data: Column, start: Column | int) -> Column:
    return number(data, start, 1)


def u16(data: Column, start: Column | int) -> Column:
    return number(data, start, 2)


def u32(data: Column, start: Column | int) -> Column:
    return number(data, start, 4)


def ip4(data: Column, start: Column | int) -> Column:
    return inet4(u32(data, start))


def ip6(data: Column, start: Column | int) -> Column:
    """Compressed text form: the first longest run of at least two zero groups becomes ``::``."""
    def groups(digits: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lower(
            F.regexp_replace(F.substring(digits, i * 4 + 1, F.lit(4)), "^0{1,3}", "")))
        return F.concat(F.lit(":"), F.array_join(parts, ":"), F.lit(":"))

    def compressed(text: Column) -> Column:
        column = None
        for run in range(8, 1, -1):
            zeros = ":0" * run + ":"
            at = F.instr(text, zeros)
            short = F.concat(F.substring(text, F.lit(1), at - 1), F.lit("::"),
                             F.substring(text, at + len(zeros), F.length(text)))
            column = F.when(at > 0, short) if column is None else column.when(at > 0, short)
        return column.otherwise(text)

    def trimmed(text: Column) -> Column:
        head = F.when(text.startswith(":") & ~text.startswith("::"), F.substring(text, F.lit(2), F.length(text))) \
            .otherwise(text)
        return F.when(head.endswith(":") & ~head.endswith("::"), F.substring(head, F.lit(1), F.length(head) - 1)) \
            .otherwise(head)

    def with_ipv4_tail(text: Column) -> Column:
        tail = inet4(u32(data, _offset(start) + 12))
        return (F.when(text.rlike("^::ffff:[0-9a-f]+:[0-9a-f]+$"), F.concat(F.lit("::ffff:"), tail))
                .when(text.rlike("^::[0-9a-f]+:[0-9a-f]+$"), F.concat(F.lit("::"), tail)).otherwise(text))

    raw = piece(data, start, 16)
    text = bind(bind(bind(F.hex(raw), groups), compressed), trimmed)
    return F.when(F.length(raw) == 16, bind(text, with_ipv4_tail))


def walk(first: Column, most: Column, end: Column, size_of, item, schema: str) -> Column:
    """Items of a length-prefixed list, at most ``most`` of them.

    Starting at byte ``first``, ``item(position)`` describes the item and
    ``size_of(position)`` is its whole size; the walk ends where fewer bytes than a
    header are left (``end`` is the last position a header may start at) or where a
    size is not positive. ``schema`` is the type of an item.
    """
    start = F.struct(first.cast("bigint").alias("pos"), F.array().cast(f"array<{schema}>").alias("items"))

    def step(acc: Column, _: Column) -> Column:
        size = size_of(acc["pos"])
        fits = (acc["pos"] <= end) & (size > 0)
        return F.when(fits, F.struct((acc["pos"] + size).alias("pos"),
                                     F.concat(acc["items"], F.array(item(acc["pos"]))).alias("items"))).otherwise(acc)

    counted = F.greatest(F.coalesce(most, F.lit(0)), F.lit(0)).cast("int")
    rounds = F.when(counted > 0, F.sequence(F.lit(1), counted)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, start, step)["items"]

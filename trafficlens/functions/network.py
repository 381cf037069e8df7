"""Column expressions on protocols, TCP flags, sizes and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trafficlens.functions.binding import bind

# IP protocol numbers and TCP flag bits.
TCP, UDP, ICMP, ICMPV6, GRE = 6, 17, 1, 58, 47
TCP_FLAGS = {"syn": 0x02, "ack": 0x10, "rst": 0x04, "fin": 0x01, "psh": 0x08, "urg": 0x20}

# Packet size histogram, upper bound and label.
SIZE_BUCKETS = ((64, "0-64"), (128, "65-128"), (256, "129-256"), (512, "257-512"),
                (1024, "513-1024"), (1500, "1025-1500"))
LARGEST_BUCKET = "1500+"


def proto_class(protocol: Column) -> Column:
    """tcp, udp, icmp (both versions) or other."""
    return (F.when(protocol == TCP, "tcp").when(protocol == UDP, "udp")
            .when(protocol.isin(ICMP, ICMPV6), "icmp").otherwise("other"))


def has_flag(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(F.lit(TCP_FLAGS[name])) != 0


def tcp_flag_bits(flags: Column) -> Column:
    """The six flag booleans as one struct."""
    return F.struct(*[has_flag(flags, name).alias(name) for name in TCP_FLAGS])


def is_fragment(flags_and_offset: Column) -> Column:
    """More-fragments bit or a non-zero offset in the IPv4 flags word."""
    return flags_and_offset.bitwiseAND(F.lit(0x3FFF)) != 0


def size_bucket(length: Column) -> Column:
    (first, label), *rest = SIZE_BUCKETS
    column = F.when(length <= first, label)
    for bound, label in rest:
        column = column.when(length <= bound, label)
    return column.otherwise(LARGEST_BUCKET)


def percentage(part: Column, whole: Column, digits: int = 1) -> Column:
    """Rounded percentage, 0 for an empty whole."""
    return F.when(whole > 0, F.round(part / whole * 100, digits)).otherwise(F.lit(0.0))


# --- addresses -------------------------------------------------------------

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
_TAIL_IPV4 = rf"^(.*:)({_OCTET}(?:\.{_OCTET}){{3}})$"
_IPV6 = r"^[0-9A-Fa-f:]*$"


def _ipv4_hex(address: Column) -> Column:
    octets = F.transform(F.split(address, r"\."), lambda part: F.lpad(F.hex(part.try_cast("bigint")), 2, "0"))
    return F.array_join(octets, "")


def _ipv6_groups(halves: Column) -> Column:
    """The eight groups around the ``::`` gap, or null when they do not add up."""
    def groups(half: Column) -> Column:
        return F.filter(F.split(half, ":", -1), lambda part: half != "")

    def fill(sides: Column) -> Column:
        gap = F.lit(8) - F.size(sides["left"]) - F.size(sides["right"])
        filler = F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0)))
        fits = F.when(F.size(halves) == 2, gap >= 1).otherwise((F.size(halves) == 1) & (gap == 0))
        return F.when(fits, F.concat(sides["left"], filler, sides["right"]))

    return bind(F.struct(groups(F.get(halves, F.lit(0))).alias("left"),
                          groups(F.coalesce(F.get(halves, F.lit(1)), F.lit(""))).alias("right")), fill)


def _ipv6_hex(address: Column) -> Column:
    """32 hex digits of an IPv6 text address, null when it is not one."""
    def plain(text: Column) -> Column:
        tail = _ipv4_hex(F.regexp_extract(text, _TAIL_IPV4, 2))
        joined = F.concat(F.regexp_extract(text, _TAIL_IPV4, 1), F.substring(tail, 1, 4), F.lit(":"),
                          F.substring(tail, 5, 4))
        return F.when(text.rlike(_TAIL_IPV4), joined).when(text.rlike(_IPV6), text)

    def digits(parts: Column) -> Column:
        padded = F.array_join(F.transform(parts, lambda part: F.lpad(part, 4, "0")), "")
        return F.when(F.forall(parts, lambda part: F.length(part).between(1, 4)), F.upper(padded))

    return bind(bind(F.split(bind(address, plain), "::", -1), _ipv6_groups), digits)


def address_hex(address: Column) -> Column:
    """8 (IPv4) or 32 (IPv6) upper-case hex digits; null for anything else."""
    return (F.when(address.rlike(_IPV4), _ipv4_hex(address))
            .when(address.contains(":"), _ipv6_hex(address)))


def prefix_key(hex_address: Column, prefix_len: Column) -> Column:
    """Text that two addresses share exactly when their first ``prefix_len`` bits agree.

    Whole hex digits are compared as they are; a prefix that ends inside a digit
    keeps that digit with the host bits cleared.
    """
    whole = F.floor(prefix_len / 4).cast("int")
    rest = (prefix_len % 4).cast("int")
    digit = F.instr(F.lit("0123456789ABCDEF"), F.substring(hex_address, whole + 1, F.lit(1))) - 1
    step = F.pow(F.lit(2.0), 4 - rest).cast("int")
    masked = F.when(rest == 0, F.lit("")).otherwise(F.hex((digit - digit % step).cast("bigint")))
    return F.concat_ws("/", F.concat(F.substring(hex_address, F.lit(1), whole), masked),
                       F.length(hex_address).cast("string"))


def inet4(u32: Column) -> Column:
    """Dotted form of an unsigned 32-bit number."""
    value = u32.cast("bigint")
    parts = [F.shiftright(value, shift).bitwiseAND(F.lit(255)).cast("string")
             for shift in (24, 16, 8, 0)]
    return F.concat_ws(".", *parts)

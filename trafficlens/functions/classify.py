"""Attack family and subtype as pure column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from trafficlens.functions.binding import bind
from trafficlens.functions.http import AUTH_PATHS

# Well-known reflector ports.
AMPLIFICATION_PORTS = {
    53: "dns_amplification", 123: "ntp_amplification", 1900: "ssdp_amplification",
    11211: "memcached_amplification", 389: "cldap_amplification", 19: "chargen_amplification",
    161: "snmp_amplification", 3702: "wsd_amplification", 5353: "mdns_amplification",
    1194: "openvpn_amplification", 3283: "apple_remote_amplification",
}
# The reflector ports considered inside a mixed attack.
MIXED_AMPLIFICATION_PORTS = (53, 123, 1900)

# Words in a threat-intelligence name, the subtype and the tool they stand for.
TOOL_WORDS = (
    ("mirai", "mirai_botnet", "Mirai"),
    ("gafgyt", "gafgyt_botnet", "Gafgyt"),
    ("bashlite", "gafgyt_botnet", "Bashlite"),
    ("mozi", "mozi_botnet", "Mozi"),
    ("xorddos", "xorddos_botnet", "XorDDoS"),
    ("muhstik", "muhstik_botnet", "Muhstik"),
    ("tsunami", "tsunami_botnet", "Tsunami/Kaiten"),
    ("kaiten", "tsunami_botnet", "Kaiten"),
    ("hajime", "hajime_botnet", "Hajime"),
    ("meris", "meris_botnet", "Meris"),
    ("mantis", "mantis_botnet", "Mantis"),
    ("fodcha", "fodcha_botnet", "Fodcha"),
    ("loic", "loic", "LOIC"),
    ("hoic", "hoic", "HOIC"),
    ("mhddos", "mhddos", "MHDDoS"),
    ("slowloris", "slowloris", "Slowloris"),
    ("goldeneye", "goldeneye", "GoldenEye"),
    ("hulk", "hulk", "HULK"),
    ("xerxes", "xerxes", "Xerxes"),
    ("hping", "hping", "hping"),
    ("rudy", "rudy", "R.U.D.Y."),
    ("ntp monlist", "ntp_amplification", None),
    ("ssdp", "ssdp_amplification", None),
    ("memcached", "memcached_amplification", None),
    ("cldap", "cldap_amplification", None),
    ("chargen", "chargen_amplification", None),
    ("dns amplification", "dns_amplification", None),
    ("stresser", "booter_service", None),
    ("booter", "booter_service", None),
)
# Subtypes vague enough to be replaced by a threat-intelligence name.
VAGUE_SUBTYPES = ("", "volumetric", "syn_flood", "ping_flood", "tcp_generic")

# Botnet family words.
BOTNET_WORDS = ("mirai", "gafgyt", "bashlite", "mozi", "xorddos", "muhstik", "tsunami",
                "kaiten", "hajime", "meris", "mantis", "fodcha", "botnet")

# Payload signature name and the subtype it proves.
SIGNATURE_SUBTYPES = {
    "ntp_monlist": "ntp_amplification", "memcached": "memcached_amplification",
    "cldap": "cldap_amplification", "chargen": "chargen_amplification",
}
SIGNATURE_MIN_PACKETS = 5

_FLAGS = ("syn", "ack", "rst", "fin", "psh", "urg")


def _zero() -> Column:
    return F.lit(0.0)


def syn_ratio(flags: Mapping[str, Column]) -> Column:
    total = sum((flags[name] for name in _FLAGS[1:]), flags["syn"])
    return F.when(total > 0, flags["syn"] / total).otherwise(_zero())


def classify_attack(tcp: Column, udp: Column, icmp: Column, syn: Column | None = None,
                    dns: Column | None = None, other: Column | None = None,
                    fragments: Column | None = None) -> Column:
    """Attack family from protocol percentages (0-100) and the SYN share (0-1)."""
    syn = _zero() if syn is None else syn
    dns = F.lit(False) if dns is None else dns
    other = _zero() if other is None else other
    fragments = _zero() if fragments is None else fragments
    strong = sum(((pct > 35).cast("int") for pct in (udp, icmp)), (tcp > 35).cast("int"))
    peak = F.greatest(tcp, udp, icmp)
    return (
        F.when(fragments > 60, "fragment_flood")
        .when(dns & (udp > 50), "dns_flood")
        .when(udp > 45, "udp_flood")
        .when((tcp > 45) & (syn > 0.5), "syn_flood")
        .when(icmp > 30, "icmp_flood")
        .when(strong >= 2, "multi_vector")
        .when(other > 30, "protocol_flood")
        .when((udp == peak) & (udp > 5), "udp_flood")
        .when((tcp == peak) & (tcp > 5), F.when(syn >= 0.3, "syn_flood").otherwise("tcp_flood"))
        .when(icmp > 5, "icmp_flood")
        .when((tcp > 0) & (tcp >= F.greatest(peak, other)), "tcp_flood")
        .when((udp > 0) & (udp >= F.greatest(peak, other)), "udp_flood")
        .when((icmp > 0) & (icmp >= F.greatest(peak, other)), "icmp_flood")
        .when(other > 0, "protocol_flood")
        .otherwise("unknown")
    )


def classify_tcp_subtype(flags: Mapping[str, Column]) -> Column:
    """Subtype from the six flag counts; '' when no flag was seen."""
    total = sum((flags[name] for name in _FLAGS[1:]), flags["syn"])
    share = {name: flags[name] / F.when(total > 0, total) for name in _FLAGS}
    scarce = F.lit(True)
    for name in ("syn", "ack", "rst", "fin", "psh"):
        scarce = scarce & (share[name] < 0.05)
    return (
        F.when(total <= 0, "")
        .when((share["fin"] > 0.15) & (share["psh"] > 0.15) & (share["urg"] > 0.15), "xmas_flood")
        .when(scarce, "null_flood")
        .when((share["syn"] > 0.3) & (share["ack"] > 0.3), "syn_ack_flood")
        .when(share["rst"] > 0.3, "rst_flood")
        .when(share["fin"] > 0.3, "fin_flood")
        .when((share["ack"] > 0.45) & (share["syn"] < 0.15), "ack_flood")
        .when((share["psh"] > 0.25) & (share["ack"] > 0.2), "psh_ack_flood")
        .otherwise("tcp_generic")
    )


def _reflector(src_port: Column, dst_port: Column, ports=None) -> Column:
    """Reflector name; the source port is looked up before the destination port."""
    names = {port: AMPLIFICATION_PORTS[port] for port in (ports or AMPLIFICATION_PORTS)}

    def lookup(port: Column) -> Column:
        table = F.create_map(*[item for pair in names.items()
                               for item in (F.lit(pair[0]).cast("bigint"), F.lit(pair[1]))])
        return F.try_element_at(table, port.cast("bigint"))

    return F.coalesce(lookup(src_port), lookup(dst_port), F.lit(""))


def classify_subtype(family: Column, dst_port: Column, flags: Mapping[str, Column], avg_size: Column,
                     src_port: Column | None = None, fragments: Column | None = None) -> Column:
    """Attack subtype from the family, top ports, flags and mean packet size."""
    src_port = F.lit(0).cast("bigint") if src_port is None else F.coalesce(src_port, F.lit(0).cast("bigint"))
    dst_port = F.coalesce(dst_port, F.lit(0).cast("bigint"))
    fragments = _zero() if fragments is None else fragments
    total = sum((flags[name] for name in _FLAGS[1:]), flags["syn"])
    syn_and_ack = (total > 0) & (flags["syn"] > 0.3 * total) & (flags["ack"] > 0.3 * total)
    seen = F.struct(
        F.coalesce(family, F.lit("")).alias("family"), classify_tcp_subtype(flags).alias("tcp"),
        _reflector(src_port, dst_port).alias("reflector"),
        _reflector(src_port, dst_port, MIXED_AMPLIFICATION_PORTS).alias("mixed"),
        syn_and_ack.alias("syn_and_ack"), dst_port.alias("dst_port"), src_port.alias("src_port"),
        avg_size.alias("size"), fragments.alias("fragments"))
    return bind(seen, _subtype_of)


def _subtype_of(seen: Column) -> Column:
    family, tcp_sub, reflector, mixed = seen["family"], seen["tcp"], seen["reflector"], seen["mixed"]
    dst_port, size = seen["dst_port"], seen["size"]
    udp = (
        F.when(seen["fragments"] > 30, "udp_fragment_flood")
        .when((dst_port == 443) & (size > 0) & (size < 1300), "quic_flood")
        .when(reflector != "", reflector)
        .when((size > 0) & (size < 100), "small_packet_flood")
        .when(size > 1200, "amplification_generic")
        .otherwise("volumetric")
    )
    return (
        F.when(family.isin("", "unknown"), F.when(tcp_sub != "", tcp_sub).otherwise(reflector))
        .when(family == "udp_flood", udp)
        .when(family == "syn_flood", F.when(seen["syn_and_ack"], "syn_ack_flood").otherwise("syn_flood"))
        .when(family == "tcp_flood", F.when(tcp_sub != "", tcp_sub).otherwise("tcp_generic"))
        .when(family == "multi_vector",
              F.concat(F.lit("multi_"), F.when(tcp_sub != "", tcp_sub).when(mixed != "", mixed)
                       .otherwise("mixed")))
        .when(family == "dns_flood",
              F.when(((dst_port == 53) | (seen["src_port"] == 53)) & (size > 512), "dns_amplification")
              .otherwise("dns_query_flood"))
        .when(family == "icmp_flood", F.when(size > 1000, "ping_of_death").otherwise("ping_flood"))
        .when(family == "protocol_flood", F.when(tcp_sub != "", tcp_sub).otherwise("gre_flood"))
        .when(family == "fragment_flood", "ip_fragment_flood")
        .otherwise("")
    )


def enrich_from_ioc(top_hit: Column, top_count: Column, family: Column, subtype: Column) -> Column:
    """Struct (family, subtype, tool, boost) after the most frequent ``name:family`` hit."""
    name = F.lower(F.trim(F.substring_index(top_hit, ":", 1)))
    hinted = F.when(top_hit.contains(":"),
                    F.trim(F.substring(top_hit, F.instr(top_hit, ":") + 1, F.length(top_hit)))).otherwise("")
    words = F.array(*[F.struct(F.lit(word).alias("word"), F.lit(sub).alias("subtype"),
                               F.lit(tool).cast("string").alias("tool")) for word, sub, tool in TOOL_WORDS])
    first_match = F.get(F.filter(words, lambda entry: name.contains(entry["word"])), F.lit(0))
    seen = F.struct(top_hit.alias("hit"), hinted.alias("hinted"), first_match.alias("match"),
                    F.coalesce(family, F.lit("")).alias("family"), F.coalesce(subtype, F.lit("")).alias("subtype"),
                    top_count.cast("bigint").alias("count"))

    def enriched(s: Column) -> Column:
        hit = s["hit"].isNotNull()
        return F.struct(
            F.when(hit & ~s["hinted"].isin("", "unknown") & s["family"].isin("unknown", ""), s["hinted"])
            .otherwise(s["family"]).alias("family"),
            F.when(hit & s["match"].isNotNull() & s["subtype"].isin(*VAGUE_SUBTYPES), s["match"]["subtype"])
            .otherwise(s["subtype"]).alias("subtype"),
            F.when(hit, s["match"]["tool"]).alias("tool"),
            F.when(hit, F.least(s["count"], F.lit(30).cast("bigint"))).otherwise(F.lit(0).cast("bigint")).alias("boost"))

    return bind(seen, enriched)


def is_botnet_name(hit: Column) -> Column:
    return F.lower(hit).rlike("|".join(BOTNET_WORDS))


def resolve_family_subtype(tcp: Column, udp: Column, icmp: Column, other: Column,
                           flags: Mapping[str, Column], avg_size: Column, dst_port: Column,
                           src_port: Column, fragments: Column, dns_names: Column,
                           top_hit: Column, top_hit_count: Column,
                           top_signature: Column, top_signature_count: Column) -> Column:
    """Final struct (family, subtype, tool, boost) of a closed incident."""
    first = classify_attack(tcp, udp, icmp, syn_ratio(flags), dns_names >= 10, other, fragments)

    def by_evidence(family: Column) -> Column:
        return F.struct(
            family.alias("family"),
            classify_subtype(family, dst_port, flags, avg_size, src_port, fragments).alias("subtype"),
            classify_tcp_subtype(flags).alias("tcp"))

    def by_flags(s: Column) -> Column:
        applies = s["family"].isin("unknown", "tcp_flood") & (tcp > 40) & (s["tcp"] != "")
        return F.struct(
            F.when(applies, "tcp_flood").otherwise(s["family"]).alias("family"),
            F.when(applies, s["tcp"]).otherwise(s["subtype"]).alias("subtype"))

    def by_intelligence(s: Column) -> Column:
        return enrich_from_ioc(top_hit, top_hit_count, s["family"], s["subtype"])

    def by_signature(s: Column) -> Column:
        proven = F.lit(None).cast("string")
        for name, named in SIGNATURE_SUBTYPES.items():
            proven = F.when(top_signature == name, named).otherwise(proven)
        sure = (F.coalesce(top_signature_count, F.lit(0)) >= SIGNATURE_MIN_PACKETS) & proven.isNotNull()
        return F.struct(
            F.when(sure & s["family"].isin("udp_flood", "unknown", "multi_vector"), "udp_flood")
            .otherwise(s["family"]).alias("family"),
            F.when(sure, proven).otherwise(s["subtype"]).alias("subtype"),
            s["tool"].alias("tool"), s["boost"].alias("boost"))

    return bind(bind(bind(bind(first, by_evidence), by_flags), by_intelligence), by_signature)


def classify_l7_subtype(total: Column, rps: Column, unique_ips: Column, error_rate: Column,
                        h2_pct: Column, h3_pct: Column, status_499: Column, status_4xx: Column,
                        rps_per_ip: Column, top_path: Column, top_path_count: Column) -> Column:
    """Subtype of an HTTP flood from one window of request statistics."""
    whole = F.greatest(total, F.lit(1))
    path = F.lower(F.coalesce(top_path, F.lit("")))
    path_share = F.coalesce(top_path_count, F.lit(0)) / whole
    on_login = F.lit(False)
    for login in AUTH_PATHS:
        on_login = on_login | path.contains(login)
    h2 = h2_pct > 30
    return (
        F.when(total <= 0, "l7_flood")
        .when(h2 & (rps > 200) & (status_499 / whole * 100 > 20) & (rps_per_ip > 50), "h2_rapid_reset")
        .when(h2 & (rps_per_ip > 200) & (unique_ips < 20) & (rps > 500), "h2_settings_flood")
        .when(h2 & (rps_per_ip > 100) & (unique_ips < 30) & (status_4xx / whole * 100 > 40),
              "h2_continuation_flood")
        .when((h3_pct > 30) & (rps > 300) & (unique_ips > 5), "quic_flood")
        .when((unique_ips <= 2) & (total > 50), "single_source_abuse")
        .when((path_share > 0.5) & (error_rate > 40) & on_login, "credential_stuffing")
        .when((path_share > 0.7) & (error_rate < 20), "scraping")
        .when(path.contains("/api/") | path.contains("/graphql"), "api_abuse")
        .when((rps < 50) & (unique_ips > 20) & (error_rate > 60), "slow_rate")
        .when((rps > 500) & (unique_ips > 10), "volumetric_flood")
        .otherwise("l7_flood")
    )


def ip_status(attacking: Column, pps: Column, threshold: Column) -> Column:
    return (F.when(attacking, "attack")
            .when((threshold > 0) & (pps > threshold * 0.7), "elevated").otherwise("normal"))


def top_share(count: Column, total: Column) -> Column:
    return F.coalesce(count, F.lit(0)) / F.greatest(total, F.lit(1))

"""Independent SQL for the registered queries, written for DuckDB.

Each statement starts from the given tables. Shared views are inlined as CTEs.
"""

from __future__ import annotations

# Fixed values, stated here once more so that the operators are not compared with themselves: threat-intelligence words, request signatures, agents.
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
BOTNET_WORDS = ("mirai", "gafgyt", "bashlite", "mozi", "xorddos", "muhstik", "tsunami",
                "kaiten", "hajime", "meris", "mantis", "fodcha", "botnet")
THREAT_PATTERNS = {
    "sqli": r"(?:union\s+select|'?\s*or\s+['\d]|select\s+.*from\s|insert\s+into|"
            r"drop\s+table|update\s+\w+\s+set|;\s*(?:drop|delete|alter)\s)",
    "xss": r"(?:<script|javascript:|on(?:error|load|click|mouseover)\s*=|"
           r"eval\s*\(|document\.(?:cookie|write)|alert\s*\()",
    "path_traversal": r"(?:\.\./|\.\.\\|%2e%2e[%/])",
    "rfi_lfi": r"(?:(?:file|php|zip|data|expect|glob|phar)://|/etc/(?:passwd|shadow)|/proc/self/)",
    "wordpress": r"(?:/wp-(?:admin|login|content|includes|config|cron)|/xmlrpc\.php|/wp-json/wp/)",
    "scanner_probe": r"(?:/\.env|/\.git/|/config\.php|/phpinfo|/server-status|/actuator|"
                     r"/containers/json|/debug/vars|/solr/admin|/_cat/indices|/elmah\.axd|"
                     r"/telescope/requests|/\.well-known/security\.txt)",
    "shell_shock": r"\(\)\s*\{",
    "log4j": r"\$\{(?:jndi|lower|upper|env):",
    "api_abuse": r"(?:/graphql|/api/v\d+/(?:admin|users|tokens|keys)|/oauth/token|"
                 r"/\.well-known/openid)",
    "cve_exploit": r"(?:/cgi-bin/|/shell|/cmd\.php|/c99\.php|/r57\.php|"
                   r"/eval-stdin\.php|/vendor/phpunit)",
}
BOT_AGENTS = (
    r"(?:python-requests|python-urllib|Go-http-client|java/|curl/|"
    r"wget/|libwww-perl|PHP/|Scrapy|nikto|sqlmap|nmap|masscan|"
    r"zgrab|httpx|nuclei|dirsearch|gobuster|ffuf|wfuzz|"
    r"bot|spider|crawl|scan|attack|exploit|hack)"
)

ORACLES: dict[str, str] = {}

SYN = "l_suppkey % 20 = 3 AND l_orderkey % 900 BETWEEN 600 AND 679"
NTP = "l_suppkey % 20 = 7 AND l_orderkey % 900 BETWEEN 720 AND 779"
NEW = "l_suppkey % 20 = 9 AND l_orderkey % 900 BETWEEN 620 AND 699"

# name -> (views it needs, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_flows": ((), f"""
SELECT l_orderkey % 900 AS tick, 'node' || (l_suppkey % 4) AS node_id, '198.51.100.' || (l_suppkey % 4) AS exporter_ip,
  '10.' || (l_suppkey % 4) || '.' || cast(floor(l_partkey / 250) AS bigint) || '.' || (l_partkey % 250) AS src_ip,
  CASE WHEN {NEW} THEN '192.0.2.200' ELSE '192.0.2.' || (l_suppkey % 20) END AS dst_ip,
  cast(CASE WHEN {NTP} THEN 123 ELSE 1024 + l_partkey % 5000 END AS bigint) AS src_port,
  cast(CASE l_suppkey % 6 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 53 WHEN 3 THEN 22 WHEN 4 THEN 3389 ELSE 8080 END AS bigint) AS dst_port,
  cast(CASE WHEN {SYN} THEN 6 WHEN {NTP} THEN 17 WHEN l_linenumber <= 3 THEN 6 WHEN l_linenumber <= 5 THEN 17
    WHEN l_linenumber = 6 THEN 1 ELSE 47 END AS bigint) AS protocol,
  cast(l_quantity AS bigint) * (CASE WHEN {SYN} THEN 1000 WHEN {NTP} THEN 1000 WHEN {NEW} THEN 1000 ELSE 1 END) AS packets,
  cast(l_quantity AS bigint) * (CASE WHEN {SYN} THEN 1000 * 60 WHEN {NTP} THEN 1000 * 468 WHEN {NEW} THEN 1000 * 90 ELSE 60 + l_partkey % 1440 END) AS octets,
  cast(CASE WHEN {SYN} THEN 2 WHEN l_linenumber > 3 THEN 0 WHEN l_returnflag = 'A' THEN 2
    WHEN l_returnflag = 'N' THEN 16 ELSE 24 END AS bigint) AS tcp_flags,
  cast(32 + l_partkey % 96 AS bigint) AS ttl, (l_orderkey + l_partkey) % 40 = 0 AS is_fragment,
  l_orderkey AS flow_id, cast(l_linenumber AS bigint) AS flow_line
FROM lineitem"""),
    "v_packets": (("v_flows",), """
SELECT flow_id, flow_line, tick, node_id, src_ip, dst_ip, src_port, dst_port, protocol, octets // packets AS pkt_len,
  tcp_flags, ttl, is_fragment,
  CASE WHEN dst_port = 53 AND protocol = 17 THEN 'host' || (src_port % 40) || '.example' END AS dns_qname,
  protocol = 47 AS was_gre, octets // packets + 24 AS outer_len, octets // packets AS inner_len,
  '172.16.0.' || (src_port % 60) AS inner_dst_ip
FROM v_flows"""),
    "v_counters": (("v_flows",), """
SELECT node_id, tick, cast(sum(packets) OVER w AS bigint) AS rx_packets, cast(sum(octets) OVER w AS bigint) AS rx_bytes,
  cast(sum(tcp) OVER w AS bigint) AS tcp_in, cast(sum(udp) OVER w AS bigint) AS udp_in, cast(sum(icmp) OVER w AS bigint) AS icmp_in
FROM (SELECT node_id, tick, sum(packets) AS packets, sum(octets) AS octets,
        sum(CASE WHEN protocol = 6 THEN packets ELSE 0 END) AS tcp, sum(CASE WHEN protocol = 17 THEN packets ELSE 0 END) AS udp,
        sum(CASE WHEN protocol = 1 THEN packets ELSE 0 END) AS icmp FROM v_flows GROUP BY node_id, tick) t
WINDOW w AS (PARTITION BY node_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
    "v_http": ((), """
SELECT event_id, 'site' || (user_id % 2) AS site_id,
  cast(CASE WHEN event_id % 10 < 5 THEN 400 + cast(floor(event_id / 10) AS bigint) % 60
    ELSE cast(floor(event_id / 10) AS bigint) % 600 END AS bigint) AS tick,
  '203.0.113.' || (user_id % 120) AS ip,
  CASE WHEN event_id % 10 < 5 OR event_type = 'signup' THEN 'POST' ELSE 'GET' END AS method,
  CASE WHEN event_id % 10 < 5 THEN '/login' WHEN event_id % 97 = 6 THEN '/wp-login.php' WHEN event_id % 89 = 7 THEN '/.env'
    WHEN event_id % 83 = 8 THEN '/a/../../etc/passwd' WHEN event_type = 'purchase' THEN '/api/v1/orders'
    ELSE '/item/' || (user_id % 25) END AS path,
  cast(CASE WHEN event_id % 10 < 5 THEN (CASE WHEN event_id % 3 = 0 THEN 200 ELSE 401 END)
    WHEN event_type = 'error' THEN 500 WHEN event_id % 101 = 9 THEN 499 ELSE 200 END AS bigint) AS status,
  cast(200 + event_id % 4000 AS bigint) AS size,
  CASE WHEN event_id % 10 < 5 THEN 'python-requests/2.31' WHEN user_id % 9 = 0 THEN 'curl/8.0'
    ELSE 'Mozilla/5.0 (X11; Linux x86_64)' END AS ua,
  CASE WHEN event_id % 4 = 0 THEN '2' ELSE '1.1' END AS http_version,
  CASE WHEN event_id % 3 = 0 THEN cast(event_id % 700 AS double) END AS resp_time_ms
FROM events"""),
    "v_payloads": ((), """
SELECT doc_id, '192.0.2.' || (doc_id % 20) AS dst_ip, 500 + (doc_id // 20) * 7 % 200 AS tick,
  CASE WHEN doc_id % 7 = 0 THEN 'GET mirai scan ' WHEN doc_id % 7 = 1 THEN 'gafgyt mirai '
    WHEN doc_id % 7 = 2 THEN 'VALUE k 0 ' ELSE '' END || text AS payload
FROM documents"""),
    "v_blocklist": (("v_flows",), """
SELECT DISTINCT src_ip AS indicator FROM v_flows WHERE src_ip LIKE '10.1.%' AND src_ip LIKE '%7'"""),
    "v_iocs": ((), """
SELECT * FROM (VALUES (1, 'mirai', 'Mirai', 'botnet'), (2, 'gafgyt', 'Gafgyt', 'botnet'), (3, 'scan', 'Scanner', 'unknown'))
  AS t(ord, pattern, attack_name, attack_family)"""),
    "v_hits": (("v_payloads", "v_iocs"), """
SELECT p.doc_id, p.dst_ip, p.tick, (SELECT arg_min(attack_name || ':' || attack_family, ord) FROM v_iocs
  WHERE contains(p.payload, pattern)) AS ioc_hit FROM v_payloads p"""),
    "v_labels": ((), "SELECT * FROM (VALUES ('192.0.2.3', 'Web Server'), ('192.0.2.7', 'DB Server')) AS t(ip, label)"),
    # 2^n addresses per network, counted from the dotted form.
    "v_subnets": ((), """
SELECT * FROM (VALUES ('192.0.2.0', 29, '192.0.2.', 0, 7), ('192.0.2.16', 30, '192.0.2.', 16, 19))
  AS t(network, prefix_len, stem, lo, hi)"""),
    "v_ports": ((), "SELECT unnest([80, 443]) AS port UNION ALL SELECT * FROM range(8000, 8101)"),
    "v_dst": (("v_flows",), """
SELECT dst_ip, tick, cast(sum(packets) AS bigint) AS packets, cast(sum(octets) AS bigint) AS octets, count(*) AS flow_count,
  cast(sum(CASE WHEN protocol = 6 THEN packets ELSE 0 END) AS bigint) AS tcp_packets,
  cast(sum(CASE WHEN protocol = 17 THEN packets ELSE 0 END) AS bigint) AS udp_packets,
  cast(sum(CASE WHEN protocol IN (1, 58) THEN packets ELSE 0 END) AS bigint) AS icmp_packets,
  cast(sum(CASE WHEN protocol NOT IN (1, 6, 17, 58) THEN packets ELSE 0 END) AS bigint) AS other_packets,
  cast(sum(CASE WHEN protocol = 6 AND tcp_flags & 2 > 0 THEN packets ELSE 0 END) AS bigint) AS syn,
  cast(sum(CASE WHEN protocol = 6 AND tcp_flags & 16 > 0 THEN packets ELSE 0 END) AS bigint) AS ack,
  cast(sum(CASE WHEN protocol = 6 AND tcp_flags & 4 > 0 THEN packets ELSE 0 END) AS bigint) AS rst,
  cast(sum(CASE WHEN protocol = 6 AND tcp_flags & 1 > 0 THEN packets ELSE 0 END) AS bigint) AS fin,
  cast(sum(CASE WHEN protocol = 6 AND tcp_flags & 8 > 0 THEN packets ELSE 0 END) AS bigint) AS psh,
  cast(sum(CASE WHEN protocol = 6 AND tcp_flags & 32 > 0 THEN packets ELSE 0 END) AS bigint) AS urg,
  cast(sum(packets) AS double) AS pps, cast(sum(octets) * 8 AS double) AS bps,
  count(DISTINCT src_ip) AS src_ip_count,
  round(sum(CASE WHEN is_fragment THEN packets ELSE 0 END) / sum(packets) * 100, 1) AS fragment_pct,
  sum(octets) / sum(packets) AS avg_pkt_size
FROM v_flows GROUP BY dst_ip, tick"""),
    "v_dst_pct": (("v_dst",), """
SELECT *, CASE WHEN tcp_packets + udp_packets + icmp_packets > 0
    THEN round(tcp_packets / (tcp_packets + udp_packets + icmp_packets) * 100, 1) ELSE 0.0 END AS tcp_pct,
  CASE WHEN tcp_packets + udp_packets + icmp_packets > 0
    THEN round(udp_packets / (tcp_packets + udp_packets + icmp_packets) * 100, 1) ELSE 0.0 END AS udp_pct,
  CASE WHEN tcp_packets + udp_packets + icmp_packets > 0
    THEN round(icmp_packets / (tcp_packets + udp_packets + icmp_packets) * 100, 1) ELSE 0.0 END AS icmp_pct
FROM v_dst"""),
    "v_src": (("v_packets",), """
SELECT dst_ip, src_ip, count(*) AS count, cast(sum(pkt_len) AS bigint) AS bytes,
  count(*) FILTER (protocol = 6) AS tcp, count(*) FILTER (protocol = 17) AS udp, count(*) FILTER (protocol IN (1, 58)) AS icmp,
  count(*) FILTER (protocol NOT IN (1, 6, 17, 58)) AS other,
  count(*) FILTER (protocol = 6 AND tcp_flags & 2 > 0) AS syn, count(*) FILTER (protocol = 6 AND tcp_flags & 16 > 0) AS ack,
  count(DISTINCT ttl) AS ttl_unique FROM v_packets GROUP BY dst_ip, src_ip"""),
    "v_breakdown": (("v_packets",), """
SELECT dst_ip, count(*) AS packets, round(count(*) FILTER (protocol = 6) / count(*) * 100, 1) AS tcp_pct,
  round(count(*) FILTER (protocol = 17) / count(*) * 100, 1) AS udp_pct,
  round(count(*) FILTER (protocol IN (1, 58)) / count(*) * 100, 1) AS icmp_pct,
  round(count(*) FILTER (protocol NOT IN (1, 6, 17, 58)) / count(*) * 100, 1) AS other_pct,
  count(*) FILTER (is_fragment) AS fragment_count, round(count(*) FILTER (is_fragment) / count(*) * 100, 1) AS fragment_pct,
  count(*) FILTER (protocol = 6 AND tcp_flags & 2 > 0) AS syn, count(*) FILTER (protocol = 6 AND tcp_flags & 16 > 0) AS ack,
  count(*) FILTER (protocol = 6 AND tcp_flags & 4 > 0) AS rst, count(*) FILTER (protocol = 6 AND tcp_flags & 1 > 0) AS fin,
  count(*) FILTER (protocol = 6 AND tcp_flags & 8 > 0) AS psh, count(*) FILTER (protocol = 6 AND tcp_flags & 32 > 0) AS urg
FROM v_packets GROUP BY dst_ip"""),
    "v_ioc_top": (("v_hits",), """
SELECT dst_ip, cast(sum(c) AS bigint) AS hits, arg_min(ioc_hit, (-c, ioc_hit)) AS top_hit, max(c) AS top_hit_count,
  string_agg(ioc_hit, ',' ORDER BY ioc_hit) AS distinct_hits
FROM (SELECT dst_ip, ioc_hit, count(*) AS c FROM v_hits WHERE ioc_hit IS NOT NULL GROUP BY dst_ip, ioc_hit) GROUP BY dst_ip"""),
}


def with_views(body: str, *names: str, recursive: bool = False, extra: str = "") -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in VIEWS[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    ctes = [f"{name} AS ({VIEWS[name][1]})" for name in ordered]
    if extra:
        ctes.append(extra)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(ctes) + "\n" if ctes else "") + body


def oracle(name: str, body: str, *views: str, recursive: bool = False, extra: str = "") -> None:
    ORACLES[name] = with_views(body, *views, recursive=recursive, extra=extra)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- sources ---------------------------------------------------------------

oracle("read_flows", """SELECT tick, node_id, exporter_ip, src_ip, dst_ip, src_port, dst_port, protocol, packets, octets, tcp_flags
FROM v_flows""", "v_flows")
oracle("read_counters", "SELECT * FROM v_counters", "v_counters")
oracle("read_access_log", """SELECT event_id, site_id, tick, ip, method, path, status, size, ua,
  cast(NULL AS double) AS resp_time_ms, http_version FROM v_http""", "v_http")
oracle("read_json_access_log", """SELECT event_id, site_id, tick, ip, method,
  CASE WHEN event_id % 2 = 0 THEN path || '?k=1' ELSE path END AS path, status, size, ua,
  CASE WHEN event_id % 2 = 0 AND event_id % 200 > 0 THEN cast(CASE WHEN event_id % 200 < 100 THEN event_id % 200 * 1000
    ELSE event_id % 200 END AS double) END AS resp_time_ms, http_version FROM v_http""", "v_http")
oracle("read_connections", """SELECT node_id, src_ip, dst_port AS dport, count(*) AS connections FROM v_flows
GROUP BY ALL""", "v_flows")
oracle("read_dimensions", """SELECT dst_port, cast(sum(packets) AS bigint) AS packets FROM v_flows
WHERE dst_port IN (80, 443) OR dst_port BETWEEN 8000 AND 8100 GROUP BY dst_port""", "v_flows")

# --- projections -----------------------------------------------------------

oracle("proto_class", """SELECT CASE protocol WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 1 THEN 'icmp' WHEN 58 THEN 'icmp'
  ELSE 'other' END AS proto, count(*) AS flows, cast(sum(packets) AS bigint) AS packets FROM v_flows GROUP BY 1""", "v_flows")
oracle("tcp_flag_bits", """SELECT tcp_flags, tcp_flags & 2 > 0 AS syn, tcp_flags & 16 > 0 AS ack, tcp_flags & 4 > 0 AS rst,
  tcp_flags & 1 > 0 AS fin, tcp_flags & 8 > 0 AS psh, tcp_flags & 32 > 0 AS urg, count(*) AS flows FROM v_flows GROUP BY ALL""",
       "v_flows")
oracle("is_fragment", "SELECT dst_ip, is_fragment AS found, count(*) AS flows FROM v_flows GROUP BY ALL", "v_flows")
oracle("node_ip_filter", """SELECT node_id, dst_ip, count(*) AS flows, cast(sum(packets) AS bigint) AS packets FROM v_flows
WHERE dst_ip = '192.0.2.3' GROUP BY ALL""", "v_flows")
IN_SUBNETS = "EXISTS (SELECT 1 FROM v_subnets s WHERE cast(split_part(dst_ip, '.', 4) AS bigint) BETWEEN s.lo AND s.hi)"
oracle("subnet_filter", f"SELECT dst_ip, tick, packets, octets FROM v_dst WHERE {IN_SUBNETS}", "v_dst", "v_subnets")
oracle("http_version", """SELECT site_id, CASE event_id % 7 WHEN 0 THEN '2' WHEN 1 THEN '2' WHEN 2 THEN '2' WHEN 3 THEN '3'
  WHEN 4 THEN '3' WHEN 5 THEN '1.0' ELSE '' END AS version, count(*) AS requests FROM v_http GROUP BY ALL""", "v_http")
oracle("status_group", """SELECT site_id, (status // 100) || 'xx' AS status_group, count(*) AS requests FROM v_http
GROUP BY ALL""", "v_http")

GATE = """(length(path) > 6 OR contains(path, '''') OR contains(path, '.') OR contains(path, '$') OR contains(path, '<')
  OR contains(path, '(') OR contains(substr(path, 2), '/'))"""
THREAT_ROWS = " UNION ALL ".join(
    f"SELECT *, '{name}' AS threat FROM src WHERE {GATE} AND regexp_matches(path, {_quoted('(?i)' + pattern)})"
    for name, pattern in THREAT_PATTERNS.items())
oracle("threat_flags", f"""SELECT site_id, path, threat, count(*) AS requests FROM ({THREAT_ROWS}) GROUP BY ALL""",
       "v_http", extra="src AS (SELECT site_id, path FROM v_http)")
oracle("threat_flags_text", f"""SELECT kind, threat, count(*) AS texts, cast(sum(id) AS bigint) AS id_sum
FROM ({THREAT_ROWS}) GROUP BY ALL""", extra="""src AS (SELECT 'document' AS kind, doc_id AS id, text AS path FROM documents
  UNION ALL SELECT 'page', page_id, html FROM pages)""")
oracle("is_bot_ua", f"""SELECT ua, regexp_matches(ua, {_quoted('(?i)' + BOT_AGENTS)}) AS is_bot, count(*) AS requests
FROM v_http GROUP BY ALL""", "v_http")
BUCKET = """CASE WHEN pkt_len <= 64 THEN '0-64' WHEN pkt_len <= 128 THEN '65-128' WHEN pkt_len <= 256 THEN '129-256'
  WHEN pkt_len <= 512 THEN '257-512' WHEN pkt_len <= 1024 THEN '513-1024' WHEN pkt_len <= 1500 THEN '1025-1500' ELSE '1500+' END"""
oracle("size_bucket", f"SELECT dst_ip, {BUCKET} AS bucket, count(*) AS packets FROM v_packets GROUP BY ALL", "v_packets")
oracle("deep_sample", """SELECT node_id, tick, flow_id, flow_line, src_ip, dst_ip, pkt_len FROM (SELECT *, row_number() OVER
  (PARTITION BY node_id ORDER BY tick, flow_id, flow_line, src_ip, dst_ip) AS n FROM v_packets) WHERE n % 10 = 0""", "v_packets")

# --- measures --------------------------------------------------------------

oracle("node_measures", """SELECT node_id, tick, cast(sum(packets) AS bigint) AS packets, cast(sum(octets) AS bigint) AS octets,
  count(*) AS flow_count, tcp AS tcp_packets, udp AS udp_packets, icmp AS icmp_packets,
  cast(sum(CASE WHEN protocol NOT IN (1, 6, 17, 58) THEN packets ELSE 0 END) AS bigint) AS other_packets,
  cast(sum(CASE WHEN protocol = 6 AND tcp_flags & 2 > 0 THEN packets ELSE 0 END) AS bigint) AS syn,
  cast(sum(CASE WHEN protocol = 6 AND tcp_flags & 16 > 0 THEN packets ELSE 0 END) AS bigint) AS ack,
  cast(sum(CASE WHEN protocol = 6 AND tcp_flags & 4 > 0 THEN packets ELSE 0 END) AS bigint) AS rst,
  cast(sum(CASE WHEN protocol = 6 AND tcp_flags & 1 > 0 THEN packets ELSE 0 END) AS bigint) AS fin,
  cast(sum(CASE WHEN protocol = 6 AND tcp_flags & 8 > 0 THEN packets ELSE 0 END) AS bigint) AS psh,
  cast(sum(CASE WHEN protocol = 6 AND tcp_flags & 32 > 0 THEN packets ELSE 0 END) AS bigint) AS urg,
  cast(sum(packets) AS double) AS pps, cast(sum(octets) * 8 AS double) AS bps,
  CASE WHEN known > 0 THEN round(tcp / known * 100, 1) ELSE 0.0 END AS tcp_pct,
  CASE WHEN known > 0 THEN round(udp / known * 100, 1) ELSE 0.0 END AS udp_pct,
  CASE WHEN known > 0 THEN round(icmp / known * 100, 1) ELSE 0.0 END AS icmp_pct, count(DISTINCT src_ip) AS src_ip_count
FROM (SELECT *, cast(sum(packets) FILTER (protocol = 6) OVER w AS bigint) AS t, 1 AS one FROM v_flows
  WINDOW w AS (PARTITION BY node_id, tick)) JOIN totals USING (node_id, tick)
GROUP BY node_id, tick, tcp, udp, icmp, known""", "v_flows", extra="""totals AS (SELECT *, tcp + udp + icmp AS known FROM (
  SELECT node_id, tick, cast(sum(CASE WHEN protocol = 6 THEN packets ELSE 0 END) AS bigint) AS tcp,
    cast(sum(CASE WHEN protocol = 17 THEN packets ELSE 0 END) AS bigint) AS udp,
    cast(sum(CASE WHEN protocol IN (1, 58) THEN packets ELSE 0 END) AS bigint) AS icmp FROM v_flows GROUP BY node_id, tick))""")
DST_COLUMNS = """dst_ip, tick, packets, octets, flow_count, tcp_packets, udp_packets, icmp_packets, other_packets, syn, ack, rst,
  fin, psh, urg, pps, bps, tcp_pct, udp_pct, icmp_pct, src_ip_count, fragment_pct"""
oracle("dst_measures", f"SELECT {DST_COLUMNS}, round(avg_pkt_size, 6) AS avg_pkt_size FROM v_dst_pct", "v_dst_pct")


def _topk(source: str, keys: str, item: str, weight: str, k: int) -> str:
    return f"""SELECT {keys}, {item}, "count", rank FROM (SELECT *, row_number() OVER (PARTITION BY {keys}
  ORDER BY "count" DESC, {item}) AS rank FROM (SELECT {keys}, {item}, cast({weight} AS bigint) AS "count" FROM {source}
  GROUP BY {keys}, {item})) WHERE rank <= {k}"""


oracle("top_src_ips", _topk("v_flows", "node_id, tick", "src_ip", "sum(packets)", 20), "v_flows")
oracle("top_dst_ports", _topk("v_flows", "dst_ip, tick", "dst_port", "sum(packets)", 20), "v_flows")
oracle("top_src_ports", _topk("v_flows", "dst_ip", "src_port", "sum(packets)", 20), "v_flows")
oracle("src_cardinality", "SELECT dst_ip, count(DISTINCT src_ip) AS src_ip_count FROM v_flows GROUP BY dst_ip", "v_flows")
oracle("segment_totals", """SELECT tick, round(sum(pps), 1) AS total_pps, round(sum(bps), 1) AS total_bps,
  round(sum(tcp_pct * packets) / sum(packets), 1) AS tcp_pct, round(sum(udp_pct * packets) / sum(packets), 1) AS udp_pct,
  round(sum(icmp_pct * packets) / sum(packets), 1) AS icmp_pct, count(*) AS tracked_ips FROM v_dst_pct GROUP BY tick""",
       "v_dst_pct")

# --- evidence --------------------------------------------------------------

ENTROPY = "round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 3)"
oracle("src_entropy", f"SELECT dst_ip, {ENTROPY} AS src_entropy FROM (SELECT dst_ip, count AS c FROM v_src) GROUP BY dst_ip", "v_src")
oracle("ttl_entropy", f"""SELECT dst_ip, {ENTROPY} AS ttl_entropy FROM (SELECT dst_ip, ttl, count(*) AS c FROM v_packets
GROUP BY ALL) GROUP BY dst_ip""", "v_packets")
oracle("spoofing_detected", f"""SELECT dst_ip, n AS src_ip_count, src_entropy, ttl_entropy, n >= 500 AND ((ttl_entropy > 4.0 AND
  src_entropy > 8.0) OR (n > 5000 AND src_entropy > 10.0)) AS spoofing_detected FROM
 (SELECT dst_ip, count(*) AS n, {ENTROPY} AS src_entropy FROM (SELECT dst_ip, count AS c FROM v_src) GROUP BY dst_ip)
 JOIN (SELECT dst_ip, {ENTROPY} AS ttl_entropy FROM (SELECT dst_ip, ttl, count(*) AS c FROM v_packets GROUP BY ALL)
 GROUP BY dst_ip) USING (dst_ip)""", "v_src")
oracle("botnet_detected", f"""SELECT dst_ip, coalesce(src_ip_count, 0) AS src_ip_count,
  coalesce(src_ip_count, 0) > 5000 OR coalesce(named, false) AS botnet_detected FROM
 (SELECT dst_ip, count(*) AS src_ip_count FROM v_src GROUP BY dst_ip) FULL JOIN
 (SELECT dst_ip, bool_or({' OR '.join(f"contains(lower(ioc_hit), '{word}')" for word in BOTNET_WORDS)}) AS named
  FROM v_hits WHERE ioc_hit IS NOT NULL GROUP BY dst_ip) USING (dst_ip)""", "v_src", "v_hits")
oracle("packet_size_stats", """SELECT dst_ip, count(*) AS packets, round(sum(pkt_len) / count(*), 1) AS avg_pkt_length,
  CASE WHEN count(*) < 2 THEN 999.0 ELSE round(stddev_pop(pkt_len), 1) END AS pkt_length_std,
  count(*) FILTER (pkt_len <= 64) AS size_0_64, count(*) FILTER (pkt_len BETWEEN 65 AND 128) AS size_65_128,
  count(*) FILTER (pkt_len BETWEEN 129 AND 256) AS size_129_256, count(*) FILTER (pkt_len BETWEEN 257 AND 512) AS size_257_512,
  count(*) FILTER (pkt_len BETWEEN 513 AND 1024) AS size_513_1024, count(*) FILTER (pkt_len BETWEEN 1025 AND 1500) AS size_1025_1500,
  count(*) FILTER (pkt_len > 1500) AS size_1500_plus FROM v_packets GROUP BY dst_ip""", "v_packets")
oracle("ttl_distribution", _topk("v_packets", "dst_ip", "ttl", "count(*)", 15), "v_packets")
oracle("protocol_breakdown", """SELECT *, CASE WHEN syn + ack + rst + fin + psh + urg > 0
  THEN round(syn / (syn + ack + rst + fin + psh + urg), 6) ELSE 0.0 END AS syn_ratio FROM v_breakdown""", "v_breakdown")
oracle("dns_stats", f"""SELECT * FROM ({_topk("(SELECT * FROM v_packets WHERE dns_qname IS NOT NULL)", "node_id", "dns_qname", "count(*)", 10)})
JOIN (SELECT node_id, count(dns_qname) AS dns_total, count(DISTINCT dns_qname) AS dns_unique FROM v_packets GROUP BY node_id)
USING (node_id)""", "v_packets")
SIGNATURE = """CASE WHEN starts_with(payload, 'STAT' || chr(13) || chr(10)) OR starts_with(payload, 'VALUE ') THEN 'memcached'
  WHEN starts_with(hex(encode(payload)), '1700032A') THEN 'ntp_monlist' WHEN starts_with(hex(encode(payload)), 'D700032A') THEN 'ntp_monlist'
  WHEN starts_with(hex(encode(payload)), '3084') OR starts_with(hex(encode(payload)), '3082') THEN 'cldap'
  WHEN starts_with(hex(encode(payload)), 'FFFFFFFFFFFF') THEN 'chargen' END"""
oracle("payload_sig_counts", f"""SELECT dst_ip, signature, count(*) AS count FROM (SELECT dst_ip, {SIGNATURE} AS signature FROM v_payloads)
WHERE signature IS NOT NULL GROUP BY ALL""", "v_payloads")
oracle("payload_signature", f"""SELECT * FROM (SELECT doc_id, {SIGNATURE} AS signature FROM v_payloads) WHERE signature IS NOT NULL""",
       "v_payloads")
oracle("source_confidence", """SELECT dst_ip, src_ip, count, tcp, udp, icmp, other, syn, ack, bytes, ttl_unique,
  round(share * 100, 2) AS pct, cast(CASE WHEN listed THEN greatest(score, 90) ELSE score END AS bigint) AS confidence,
  listed AS threat_intel
FROM (SELECT *, src_ip IN (SELECT indicator FROM v_blocklist) AS listed, least(100,
  CASE WHEN share > 0.05 THEN 30 WHEN share > 0.02 THEN 15 ELSE 0 END
  + CASE WHEN tcp > 0 AND ack = 0 AND syn > 0 THEN 25 ELSE 0 END + CASE WHEN ttl_unique <= 1 AND count > 50 THEN 20 ELSE 0 END
  + CASE WHEN (tcp > 0)::int + (udp > 0)::int + (icmp > 0)::int = 1 AND count > 100 THEN 10 ELSE 0 END
  + CASE WHEN count > 500 THEN 15 WHEN count > 200 THEN 5 ELSE 0 END
  + CASE WHEN udp > tcp AND bytes / count < 100 AND count > 100 THEN 10 ELSE 0 END) AS score
  FROM (SELECT *, count / sum(count) OVER (PARTITION BY dst_ip) AS share FROM v_src))""", "v_src", "v_blocklist")
oracle("per_vm_breakdown", """SELECT node_id, rank, inner_ip, packets, bytes, tcp_pct, udp_pct, icmp_pct, src_ip_count,
  rank = 1 AS is_top_attacked, CASE inner_ip WHEN '172.16.0.3' THEN 'Web Server' WHEN '172.16.0.7' THEN 'DB Server' ELSE '' END AS label
FROM (SELECT node_id, inner_dst_ip AS inner_ip, count(*) AS packets, cast(sum(inner_len) AS bigint) AS bytes, 0.0::double AS tcp_pct,
  0.0::double AS udp_pct, 0.0::double AS icmp_pct, count(DISTINCT src_ip) AS src_ip_count,
  row_number() OVER (PARTITION BY node_id ORDER BY count(*) DESC, inner_dst_ip) AS rank
  FROM v_packets WHERE was_gre GROUP BY node_id, inner_dst_ip) WHERE rank <= 50""", "v_packets")
oracle("gre_overhead", """SELECT node_id, tick, bps, round(ratio, 6) AS overhead_ratio, round(gre, 6) AS gre_traffic_ratio,
  round(bps * (1.0 - ratio), 3) AS corrected_bps FROM (SELECT node_id, tick,
  coalesce(24 * count(*) FILTER (was_gre) / sum(outer_len) FILTER (was_gre), 0.0) AS ratio,
  count(*) FILTER (was_gre) / count(*) AS gre FROM v_packets GROUP BY node_id, tick)
JOIN (SELECT node_id, tick, cast(sum(octets) * 8 AS double) AS bps FROM v_flows GROUP BY node_id, tick) USING (node_id, tick)""",
       "v_packets")
oracle("ioc_hit_counts", "SELECT * FROM v_ioc_top", "v_ioc_top")
oracle("distinct_ioc", "SELECT DISTINCT dst_ip, ioc_hit FROM v_hits WHERE ioc_hit IS NOT NULL", "v_hits")
SAFE = """(src_ip LIKE '10.0.0.%' OR src_ip = '10.2.1.7' OR src_ip LIKE '10.3.2.%' OR src_ip LIKE '10.3.3.%')"""


def _sources(keys: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""SELECT {lead}src_ip, connections, ports, rank FROM (SELECT *, row_number() OVER ({part} ORDER BY connections DESC, src_ip)
  AS rank FROM (SELECT {lead}src_ip, count(*) AS connections,
  array_to_string(list_sort(list(DISTINCT dst_port))[1:20], ',') AS ports FROM v_flows
  WHERE dst_port NOT IN (SELECT port FROM v_ports) AND NOT {SAFE} GROUP BY {lead}src_ip)) WHERE rank <= 50"""


oracle("nonservice_sources", _sources("node_id"), "v_flows", "v_ports")
oracle("block_plan", """SELECT src_ip AS source_ip, 'non_service' AS block_scope, connections AS src_pps, ports AS dst_ports,
  cast(60 AS bigint) AS cooldown, cast(960 AS bigint) AS expires_tick
FROM (SELECT *, row_number() OVER (ORDER BY connections DESC, src_ip) AS position FROM found
  WHERE connections >= 10 AND src_ip NOT IN (SELECT src_ip FROM active))
WHERE position <= (SELECT least(50, greatest(200 - count(*), 0)) FROM active)""", "v_flows", "v_ports", extra=f"""found AS (
  SELECT src_ip, count(*) AS connections, array_to_string(list_sort(list(DISTINCT dst_port)), ',') AS ports FROM v_flows
  WHERE dst_port NOT IN (SELECT port FROM v_ports) AND NOT {SAFE} GROUP BY src_ip),
active AS (SELECT src_ip FROM found WHERE connections % 4 = 0 AND 800 + connections * 5 > 900)""")

# --- joins -----------------------------------------------------------------

oracle("cidr_join", """SELECT dst_ip, cast(sum(packets) AS bigint) AS packets, network, cast(prefix_len AS bigint) AS prefix_len
FROM v_flows JOIN v_subnets ON cast(split_part(dst_ip, '.', 4) AS bigint) BETWEEN lo AND hi GROUP BY ALL""", "v_flows", "v_subnets")
oracle("blocklist_join", """SELECT dst_ip, src_ip, count, src_ip IN (SELECT indicator FROM v_blocklist) AS threat_intel FROM v_src""",
       "v_src", "v_blocklist")
oracle("blocklist_ratio", """SELECT dst_ip, count(*) AS sources, count(*) FILTER (listed) AS matched,
  round(count(*) FILTER (listed) / count(*), 6) AS blocklist_ratio
FROM (SELECT DISTINCT dst_ip, src_ip, src_ip IN (SELECT indicator FROM v_blocklist) AS listed FROM v_flows) GROUP BY dst_ip""",
       "v_flows", "v_blocklist")
oracle("safelist_anti", f"SELECT src_ip, cast(sum(packets) AS bigint) AS packets FROM v_flows WHERE NOT {SAFE} GROUP BY src_ip", "v_flows")
oracle("label_join", """SELECT dst_ip, cast(sum(packets) AS bigint) AS packets, coalesce(any_value(label), '') AS label
FROM v_flows LEFT JOIN v_labels ON ip = dst_ip GROUP BY dst_ip""", "v_flows", "v_labels")
oracle("ioc_join", "SELECT doc_id, dst_ip, ioc_hit FROM v_hits WHERE ioc_hit IS NOT NULL", "v_hits")
oracle("ioc_join_long_list", """SELECT p.doc_id, arg_min(hit, ord) AS ioc_hit FROM v_payloads p JOIN patterns ON contains(p.payload, pattern)
GROUP BY p.doc_id""", "v_payloads", "v_iocs", extra="""patterns AS (SELECT ord, pattern, attack_name || ':' || attack_family AS hit
  FROM v_iocs UNION ALL SELECT 100 + item_id, text, 'passage' || item_id || ':unknown' FROM benchmark WHERE text <> '')""")
oracle("asof_join", """SELECT f.exporter_ip, f.tick, f.flow_id, f.flow_line, f.src_ip, f.packets, r.rate
FROM v_flows f ASOF LEFT JOIN (SELECT exporter_ip, tick, max(ttl) AS rate FROM v_flows WHERE protocol = 47 GROUP BY ALL) r
ON f.exporter_ip = r.exporter_ip AND f.tick >= r.tick""", "v_flows")
oracle("merge_flow_over_packets", """SELECT dst_ip, tick, coalesce(f.pps, p.pps) AS pps, coalesce(f.bps, p.bps) AS bps,
  CASE WHEN f.pps IS NOT NULL THEN f.tcp_pct ELSE p.tcp_pct END AS tcp_pct,
  CASE WHEN f.pps IS NOT NULL THEN 'flow' ELSE 'packet' END AS source FROM f FULL JOIN p USING (dst_ip, tick)""", "v_flows",
       extra=",\n".join(f"""{name} AS (SELECT dst_ip, tick, cast(sum(packets) AS double) AS pps, cast(sum(octets) * 8 AS double) AS bps,
  coalesce(round(sum(CASE WHEN protocol = 6 THEN packets ELSE 0 END) / nullif(sum(CASE WHEN protocol IN (1, 6, 17, 58) THEN packets
  ELSE 0 END), 0) * 100, 1), 0.0) AS tcp_pct FROM v_flows WHERE src_port % 3 <> {drop} GROUP BY dst_ip, tick)"""
                        for name, drop in (("f", 0), ("p", 1))))
RATES = """rates AS (SELECT node_id, tick, d_packets / dt AS pps, d_bytes * 8 / dt AS bps, *EXCLUDE (node_id, tick) FROM (
  SELECT node_id, tick, tick - lag(tick) OVER w AS dt, rx_packets - lag(rx_packets) OVER w AS d_packets,
    rx_bytes - lag(rx_bytes) OVER w AS d_bytes, tcp_in - lag(tcp_in) OVER w AS t, udp_in - lag(udp_in) OVER w AS u,
    icmp_in - lag(icmp_in) OVER w AS i FROM v_counters WINDOW w AS (PARTITION BY node_id ORDER BY tick)) WHERE dt > 0),
counter_rates AS (SELECT node_id, tick, pps, bps, """ + ", ".join(
    f"""coalesce(last_value(CASE WHEN t + u + i > 0 THEN round({c} / (t + u + i) * 100, 1) END IGNORE NULLS)
    OVER (PARTITION BY node_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS {name}_pct"""
    for c, name in (("t", "tcp"), ("u", "udp"), ("i", "icmp"))) + " FROM rates)"
oracle("counter_rates", """SELECT node_id, tick, round(pps, 6) AS pps, round(bps, 6) AS bps, tcp_pct, udp_pct, icmp_pct
FROM counter_rates""", "v_counters", extra=RATES)
oracle("merge_node_sources", """SELECT c.node_id, c.tick, round(CASE WHEN f.pps > c.pps THEN f.pps ELSE c.pps END, 6) AS pps,
  round(CASE WHEN f.pps > c.pps THEN f.bps ELSE c.bps END, 6) AS bps, coalesce(f.tcp_pct, c.tcp_pct) AS tcp_pct,
  coalesce(f.udp_pct, c.udp_pct) AS udp_pct, coalesce(f.icmp_pct, c.icmp_pct) AS icmp_pct
FROM counter_rates c LEFT JOIN f USING (node_id, tick)""", "v_counters", extra=RATES + """,
f AS (SELECT node_id, tick, pps, bps, """ + ", ".join(
    f"CASE WHEN t + u + i > 0 THEN round({c} / (t + u + i) * 100, 1) ELSE 0.0 END AS {name}_pct"
    for c, name in (("t", "tcp"), ("u", "udp"), ("i", "icmp"))) + """ FROM (SELECT node_id, tick, cast(sum(packets) AS double) AS pps,
  cast(sum(octets) * 8 AS double) AS bps, sum(CASE WHEN protocol = 6 THEN packets ELSE 0 END) AS t,
  sum(CASE WHEN protocol = 17 THEN packets ELSE 0 END) AS u, sum(CASE WHEN protocol = 1 THEN packets ELSE 0 END) AS i
  FROM v_flows GROUP BY node_id, tick))""")

# --- windows ---------------------------------------------------------------

VIEWS["v_base"] = (("v_dst",), """
SELECT dst_ip, tick, pps, bps, row_number() OVER k AS rn,
  list(pps) OVER w AS pw, list(bps) OVER w AS bw
FROM v_dst WINDOW k AS (PARTITION BY dst_ip ORDER BY tick),
  w AS (PARTITION BY dst_ip ORDER BY tick ROWS BETWEEN 299 PRECEDING AND CURRENT ROW)""")


def _baseline_views(hour: str) -> dict[str, tuple[tuple[str, ...], str]]:
    """Row-by-row baseline: lists of the last samples, refreshed on rows 11, 21, ..."""
    return {
        "v_hour": (("v_base",), f"""
SELECT dst_ip, tick, rn, count(*) OVER h AS hn, list(pps) OVER h AS hw FROM (SELECT *, {hour} AS hr FROM v_base)
WINDOW h AS (PARTITION BY dst_ip, hr ORDER BY tick ROWS BETWEEN 359 PRECEDING AND CURRENT ROW)"""),
        "v_fresh": (("v_base", "v_hour"), """
SELECT b.dst_ip, b.tick, b.rn, pps, bps, CASE WHEN b.rn >= 2 THEN list_avg(pw) ELSE 0.0 END AS avg_pps,
  CASE WHEN due THEN list_sort(pw)[least(len(pw) * 95 // 100, len(pw) - 1) + 1] END AS f95,
  CASE WHEN due THEN list_sort(pw)[least(len(pw) * 99 // 100, len(pw) - 1) + 1] END AS f99,
  CASE WHEN due THEN list_avg(bw) END AS favg_bps,
  CASE WHEN due THEN list_sort(bw)[least(len(bw) * 99 // 100, len(bw) - 1) + 1] END AS fb99,
  CASE WHEN due THEN hn >= 60 END AS fready,
  CASE WHEN due THEN CASE WHEN hn >= 60 THEN list_sort(hw)[least(len(hw) * 99 // 100, len(hw) - 1) + 1] ELSE -1.0 END END AS fh99,
  CASE WHEN due THEN b.rn > 300 END AS fwas
FROM (SELECT *, rn > 1 AND rn % 10 = 1 AS due FROM v_base) b JOIN v_hour h ON b.dst_ip = h.dst_ip AND b.tick = h.tick"""),
        "v_rolling": (("v_fresh",), """
SELECT dst_ip, tick, pps, bps, rn AS sample_no, avg_pps, coalesce(p95, 0.0) AS p95_pps, coalesce(p99, 0.0) AS p99_pps,
  coalesce(a_bps, 0.0) AS avg_bps, coalesce(b99, 0.0) AS p99_bps, coalesce(hready, false) AS hour_ready,
  CASE WHEN hready THEN h99 ELSE 0.0 END AS hour_p99, rn >= 300 AS ready,
  CASE WHEN p99 IS NULL THEN 5000.0 ELSE greatest(3 * CASE WHEN hready THEN greatest(h99, p99 * 0.5) ELSE p99 END, 5000.0) END AS threshold,
  CASE WHEN was THEN greatest(3 * b99, 50000000.0) ELSE 0.0 END AS bps_threshold
FROM (SELECT *, last_value(f95 IGNORE NULLS) OVER w AS p95, last_value(f99 IGNORE NULLS) OVER w AS p99,
  last_value(favg_bps IGNORE NULLS) OVER w AS a_bps, last_value(fb99 IGNORE NULLS) OVER w AS b99,
  last_value(fready IGNORE NULLS) OVER w AS hready, last_value(fh99 IGNORE NULLS) OVER w AS h99,
  last_value(fwas IGNORE NULLS) OVER w AS was FROM v_fresh
  WINDOW w AS (PARTITION BY dst_ip ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""),
    }


VIEWS.update(_baseline_views("tick // 3600 % 24"))
oracle("rolling_baseline", """SELECT dst_ip, tick, sample_no, round(avg_pps, 6) AS avg_pps, p95_pps, p99_pps,
  round(avg_bps, 6) AS avg_bps, p99_bps, ready FROM v_rolling""", "v_rolling")
oracle("threshold", "SELECT dst_ip, tick, ready, threshold, bps_threshold FROM v_rolling", "v_rolling")
oracle("velocity", """SELECT dst_ip, tick, pps, delta, round(avg_pps, 6) AS avg_pps,
  ready AND delta > avg_pps * 5 AND pps > avg_pps * 2 AS is_jump FROM (SELECT *, pps - coalesce(lag(pps) OVER
  (PARTITION BY dst_ip ORDER BY tick), 0.0) AS delta FROM v_rolling)""", "v_rolling")
oracle("baseline_summary", """SELECT dst_ip, round(threshold, 1) AS threshold, round(avg_pps, 1) AS avg_pps, round(p99_pps, 1) AS p99_pps
FROM (SELECT *, row_number() OVER (PARTITION BY dst_ip ORDER BY tick DESC) AS age FROM v_rolling) WHERE age = 1 AND ready
ORDER BY round(threshold, 1) DESC, dst_ip LIMIT 20""", "v_rolling")
VIEWS.update(_baseline_views("tick // 300 % 24"))
oracle("hourly_baseline", "SELECT dst_ip, tick, hour_ready, hour_p99, threshold FROM v_rolling", "v_rolling")
VIEWS.update(_baseline_views("tick // 3600 % 24"))

VIEWS["v_calibrated"] = (("v_dst",), """
SELECT dst_ip, list_avg(v) AS avg_pps, list_sort(v)[least(len(v) * 99 // 100, len(v) - 1) + 1] AS p99_pps,
  greatest(3 * list_sort(v)[least(len(v) * 99 // 100, len(v) - 1) + 1], 5000.0) AS threshold
FROM (SELECT dst_ip, list(pps) AS v FROM (SELECT *, row_number() OVER (PARTITION BY dst_ip ORDER BY tick DESC) AS age
  FROM v_dst WHERE tick < 600) WHERE age <= 300 GROUP BY dst_ip)""")
VIEWS["v_hot"] = (("v_dst_pct", "v_calibrated"), """
SELECT d.*, c.avg_pps, coalesce(c.threshold, 10000.0) AS threshold,
  CASE WHEN c.threshold IS NULL THEN d.pps >= 10000 OR d.bps >= 500000000 ELSE d.pps > c.threshold END AS hot
FROM v_dst_pct d LEFT JOIN v_calibrated c USING (dst_ip)""")
VIEWS["v_runs"] = (("v_hot",), """
SELECT *, row_number() OVER (PARTITION BY dst_ip ORDER BY tick) - row_number() OVER (PARTITION BY dst_ip, hot ORDER BY tick) AS island
FROM v_hot""")
VIEWS["v_floods"] = (("v_hot",), """
SELECT dst_ip, min(tick) AS first_tick, max(tick) AS last_tick, count(*) AS length, max(pps) AS peak_pps, max(bps) AS peak_bps,
  max(src_ip_count) AS peak_sources, any_value(threshold) AS threshold, sum(tcp_packets) AS t, sum(udp_packets) AS u, sum(icmp_packets) AS i,
  sum(syn) AS syn, sum(syn + ack + rst + fin + psh + urg) AS flags
FROM (SELECT *, row_number() OVER (PARTITION BY dst_ip ORDER BY tick) - row_number() OVER (PARTITION BY dst_ip, hot ORDER BY tick) AS island
  FROM v_hot WHERE tick >= 600) WHERE hot GROUP BY dst_ip, island HAVING count(*) >= 3""")


def family_sql(tcp="tcp_pct", udp="udp_pct", icmp="icmp_pct", syn="0.0", dns="false", other="0.0", frag="0.0") -> str:
    return f"""CASE WHEN {frag} > 60 THEN 'fragment_flood' WHEN {dns} AND {udp} > 50 THEN 'dns_flood' WHEN {udp} > 45 THEN 'udp_flood'
  WHEN {tcp} > 45 AND {syn} > 0.5 THEN 'syn_flood' WHEN {icmp} > 30 THEN 'icmp_flood'
  WHEN list_sort([{tcp}, {udp}, {icmp}])[2] > 35 THEN 'multi_vector' WHEN {other} > 30 THEN 'protocol_flood'
  WHEN {udp} >= {tcp} AND {udp} >= {icmp} AND {udp} > 5 THEN 'udp_flood'
  WHEN {tcp} >= {udp} AND {tcp} >= {icmp} AND {tcp} > 5 THEN CASE WHEN {syn} >= 0.3 THEN 'syn_flood' ELSE 'tcp_flood' END
  WHEN {icmp} > 5 THEN 'icmp_flood'
  WHEN greatest({tcp}, {udp}, {icmp}, {other}) <= 0 THEN 'unknown'
  WHEN {tcp} = greatest({tcp}, {udp}, {icmp}, {other}) THEN 'tcp_flood' WHEN {udp} = greatest({udp}, {icmp}, {other}) THEN 'udp_flood'
  WHEN {icmp} >= {other} THEN 'icmp_flood' ELSE 'protocol_flood' END"""


SYN_RATIO = "CASE WHEN syn + ack + rst + fin + psh + urg > 0 THEN syn / (syn + ack + rst + fin + psh + urg) ELSE 0.0 END"
VIEWS["v_family"] = (("v_dst_pct",), f"""
SELECT *, {family_sql(syn='sr', frag='fragment_pct')} AS family FROM (SELECT *, {SYN_RATIO} AS sr FROM v_dst_pct)""")

oracle("calibrated_threshold", "SELECT dst_ip, round(avg_pps, 6) AS avg_pps, p99_pps, threshold FROM v_calibrated", "v_calibrated")
oracle("sustained", """SELECT dst_ip, min(tick) AS first_tick, max(tick) AS last_tick, count(*) AS length, max(pps) AS peak_pps
FROM v_runs WHERE hot GROUP BY dst_ip, island HAVING count(*) >= 3""", "v_runs")
oracle("holddown", """SELECT dst_ip, tick AS resolved_tick FROM (SELECT *, row_number() OVER (PARTITION BY dst_ip, hot, island ORDER BY tick)
AS n FROM v_runs) WHERE NOT hot AND n = 10""", "v_runs")
oracle("classification_lock", """SELECT dst_ip, tick, family, locked_family, coalesce(locked_family, family) AS effective_family
FROM (SELECT *, (SELECT arg_min(l.family, l.tick) FROM locks l WHERE l.dst_ip = f.dst_ip AND l.tick <= f.tick) AS locked_family
FROM v_family f)""", "v_family", extra="""locks AS (SELECT dst_ip, tick, family FROM (SELECT *, row_number() OVER
  (PARTITION BY dst_ip, family, island ORDER BY tick) AS vote FROM (SELECT *, row_number() OVER (PARTITION BY dst_ip ORDER BY tick)
  - row_number() OVER (PARTITION BY dst_ip, family ORDER BY tick) AS island FROM v_family)) WHERE vote = 3)""")
oracle("velocity_curve", """SELECT incident_id, dst_ip, cast(t AS double) AS t, round(pps, 1) AS pps FROM (SELECT *, row_number() OVER
  (PARTITION BY incident_id, t // 5 ORDER BY t) AS n FROM (SELECT d.dst_ip, d.dst_ip || '@' || first_tick AS incident_id, tick - first_tick AS t, pps
  FROM v_dst d JOIN (SELECT dst_ip AS ip, first_tick, last_tick FROM v_floods) ON ip = d.dst_ip AND tick BETWEEN first_tick AND last_tick)) WHERE n = 1""",
       "v_dst", "v_floods")
oracle("metrics_rollup", """SELECT node_id, tick // 5 * 5 AS slot, round(max(pps), 1) AS pps, round(max(bps), 1) AS bps,
  round(sum(pps) / count(*), 1) AS avg_pps, count(*) AS samples, arg_max(tcp_pct, tick) AS tcp_pct, arg_max(udp_pct, tick) AS udp_pct,
  arg_max(icmp_pct, tick) AS icmp_pct, arg_max(conn_count, tick) AS conn_count, arg_max(threshold, tick) AS threshold
FROM r2 GROUP BY ALL""", "v_flows", extra="""n AS (SELECT node_id, tick, cast(sum(packets) AS double) AS pps, cast(sum(octets) * 8 AS double) AS bps,
  count(*) AS conn_count, sum(CASE WHEN protocol = 6 THEN packets ELSE 0 END) AS t, sum(CASE WHEN protocol = 17 THEN packets ELSE 0 END) AS u,
  sum(CASE WHEN protocol = 1 THEN packets ELSE 0 END) AS i FROM v_flows GROUP BY node_id, tick),
r0 AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY tick) AS rn, list(pps) OVER w AS pw, list(pps) OVER h AS hw FROM n
  WINDOW w AS (PARTITION BY node_id ORDER BY tick ROWS 299 PRECEDING), h AS (PARTITION BY node_id ORDER BY tick ROWS 359 PRECEDING)),
r1 AS (SELECT *, CASE WHEN rn > 1 AND rn % 10 = 1 THEN greatest(5000.0, 3 * CASE WHEN rn >= 60 THEN greatest(
  list_sort(hw)[least(len(hw) * 99 // 100, len(hw) - 1) + 1], 0.5 * list_sort(pw)[least(len(pw) * 99 // 100, len(pw) - 1) + 1])
  ELSE list_sort(pw)[least(len(pw) * 99 // 100, len(pw) - 1) + 1] END) END AS fresh FROM r0),
r2 AS (SELECT *, coalesce(last_value(fresh IGNORE NULLS) OVER (PARTITION BY node_id ORDER BY tick ROWS UNBOUNDED PRECEDING), 5000.0) AS threshold,
  CASE WHEN t + u + i > 0 THEN round(t / (t + u + i) * 100, 1) ELSE 0.0 END AS tcp_pct,
  CASE WHEN t + u + i > 0 THEN round(u / (t + u + i) * 100, 1) ELSE 0.0 END AS udp_pct,
  CASE WHEN t + u + i > 0 THEN round(i / (t + u + i) * 100, 1) ELSE 0.0 END AS icmp_pct FROM r1)""")
oracle("incident_evidence_limited", """SELECT incident_id, phase, position, tick, flow_id, flow_line, src_ip, pkt_len FROM (
  SELECT *, 'during' AS phase, row_number() OVER (PARTITION BY incident_id ORDER BY tick, flow_id, flow_line, src_ip) AS position
  FROM near WHERE tick >= first_tick QUALIFY position <= 1500
  UNION ALL
  SELECT *, 'before' AS phase, row_number() OVER (PARTITION BY incident_id ORDER BY tick DESC, flow_id DESC, flow_line DESC, src_ip DESC) AS position
  FROM near WHERE tick < first_tick QUALIFY position <= 40)""", "v_packets", "v_floods", extra="""near AS (
  SELECT p.*, f.dst_ip || '@' || first_tick AS incident_id, first_tick FROM v_packets p JOIN v_floods f ON p.dst_ip = f.dst_ip
  AND p.tick BETWEEN first_tick - 60 AND last_tick)""")
oracle("incident_evidence", """SELECT incident_id, phase, row_number() OVER (PARTITION BY incident_id, phase
  ORDER BY way * tick, way * flow_id, way * flow_line, CASE WHEN way = 1 THEN src_ip END, CASE WHEN way = -1 THEN src_ip END DESC) AS position,
  tick, flow_id, flow_line, src_ip, pkt_len FROM (
  SELECT p.*, f.dst_ip || '@' || first_tick AS incident_id, CASE WHEN p.tick < first_tick THEN 'before' ELSE 'during' END AS phase,
    CASE WHEN p.tick < first_tick THEN -1 ELSE 1 END AS way
  FROM v_packets p JOIN v_floods f ON p.dst_ip = f.dst_ip AND p.tick <= last_tick)""", "v_packets", "v_floods")
oracle("incident_evidence_any_age", """SELECT incident_id, phase, position, tick, flow_id, flow_line, src_ip, pkt_len FROM (
  SELECT *, 'during' AS phase, row_number() OVER (PARTITION BY incident_id ORDER BY tick, flow_id, flow_line, src_ip) AS position
  FROM upto WHERE tick >= first_tick QUALIFY position <= 10000
  UNION ALL
  SELECT *, 'before' AS phase, row_number() OVER (PARTITION BY incident_id ORDER BY tick DESC, flow_id DESC, flow_line DESC, src_ip DESC) AS position
  FROM upto WHERE tick < first_tick QUALIFY position <= 1000)""", "v_packets", "v_floods", extra="""upto AS (
  SELECT p.*, f.dst_ip || '@' || first_tick AS incident_id, first_tick FROM v_packets p JOIN v_floods f ON p.dst_ip = f.dst_ip
  AND p.tick <= last_tick)""")
oracle("correlate_l3_l7", """SELECT node_id, node_id || '@' || tick AS incident_id, tick AS started_tick,
  EXISTS (SELECT 1 FROM v_flows f WHERE f.node_id = h.node_id AND f.tick = h.tick GROUP BY f.tick HAVING sum(packets) > 5000)
  OR EXISTS (SELECT 1 FROM gaps g WHERE g.node_id = h.node_id AND h.tick BETWEEN g.a AND g.b) AS correlated_l3l4
FROM (SELECT DISTINCT 'node' || substr(site_id, 5) AS node_id, tick FROM v_http WHERE status >= 400) h""", "v_flows", "v_http",
       extra="""n AS (SELECT node_id, tick, sum(packets) > 5000 AS hot FROM v_flows GROUP BY node_id, tick),
gaps AS (SELECT node_id, min(tick) AS a, max(tick) AS b FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY tick)
  - row_number() OVER (PARTITION BY node_id, hot ORDER BY tick) AS island FROM n) WHERE hot GROUP BY node_id, island)""")
oracle("nonservice_connections", """SELECT node_id, dst_port AS dport, count(*) AS connections FROM v_flows
WHERE dst_port NOT IN (80, 443) AND dst_port NOT BETWEEN 8000 AND 8100 GROUP BY ALL""", "v_flows")
oracle("sp_rates", """SELECT node_id, tick, """ + ", ".join(
    f"cast(greatest(0, round({name})) AS bigint) AS {out}" for name, out in (
        ("ds / dt", "service_pps"), ("dsb * 8 / dt", "service_bps"), ("dn / dt", "non_service_pps"),
        ("dnb * 8 / dt", "non_service_bps"), ("db / dt", "blocked_pps"))) + """ FROM (SELECT node_id, tick, tick - lag(tick) OVER w AS dt,
  s - lag(s) OVER w AS ds, sb - lag(sb) OVER w AS dsb, n - lag(n) OVER w AS dn, nb - lag(nb) OVER w AS dnb, b - lag(b) OVER w AS db
  FROM c WHERE last_in_slot = tick WINDOW w AS (PARTITION BY node_id ORDER BY tick)) WHERE dt >= 1""", "v_flows", extra="""c AS (
  SELECT node_id, tick, sum(s) OVER w AS s, sum(sb) OVER w AS sb, sum(n) OVER w AS n, sum(nb) OVER w AS nb, sum(b) OVER w AS b,
    max(tick) OVER (PARTITION BY node_id, tick // 5) AS last_in_slot
  FROM (SELECT node_id, tick, sum(CASE WHEN svc THEN packets ELSE 0 END) AS s, sum(CASE WHEN svc THEN octets ELSE 0 END) AS sb,
    sum(CASE WHEN svc THEN 0 ELSE packets END) AS n, sum(CASE WHEN svc THEN 0 ELSE octets END) AS nb,
    sum(CASE WHEN tcp_flags = 24 THEN packets ELSE 0 END) AS b
    FROM (SELECT *, dst_port IN (80, 443) OR dst_port BETWEEN 8000 AND 8100 AS svc FROM v_flows) GROUP BY node_id, tick)
  WINDOW w AS (PARTITION BY node_id ORDER BY tick))""")

# --- classification --------------------------------------------------------

oracle("classify_attack", "SELECT dst_ip, tick, tcp_pct, udp_pct, icmp_pct, family FROM v_family", "v_family")
TCP_SUBTYPE = """CASE WHEN ft = 0 THEN '' WHEN fin / ft > 0.15 AND psh / ft > 0.15 AND urg / ft > 0.15 THEN 'xmas_flood'
  WHEN greatest(syn, ack, rst, fin, psh) / ft < 0.05 THEN 'null_flood' WHEN syn / ft > 0.3 AND ack / ft > 0.3 THEN 'syn_ack_flood'
  WHEN rst / ft > 0.3 THEN 'rst_flood' WHEN fin / ft > 0.3 THEN 'fin_flood' WHEN ack / ft > 0.45 AND syn / ft < 0.15 THEN 'ack_flood'
  WHEN psh / ft > 0.25 AND ack / ft > 0.2 THEN 'psh_ack_flood' ELSE 'tcp_generic' END"""
FLAG_TOTAL = "syn + ack + rst + fin + psh + urg AS ft"
oracle("classify_tcp_subtype", f"SELECT dst_ip, tick, {TCP_SUBTYPE} AS tcp_subtype FROM (SELECT *, {FLAG_TOTAL} FROM v_dst)", "v_dst")


def _reflector(port: str) -> str:
    return f"""CASE {port} WHEN 53 THEN 'dns' WHEN 123 THEN 'ntp' WHEN 1900 THEN 'ssdp' WHEN 11211 THEN 'memcached' WHEN 389 THEN 'cldap'
  WHEN 19 THEN 'chargen' WHEN 161 THEN 'snmp' WHEN 3702 THEN 'wsd' WHEN 5353 THEN 'mdns' WHEN 1194 THEN 'openvpn'
  WHEN 3283 THEN 'apple_remote' END || '_amplification'"""


def subtype_sql(avg: str) -> str:
    reflector = f"coalesce({_reflector('src_port')}, {_reflector('dst_port')}, '')"
    mixed = """coalesce(CASE src_port WHEN 53 THEN 'dns_amplification' WHEN 123 THEN 'ntp_amplification' WHEN 1900 THEN 'ssdp_amplification' END,
    CASE dst_port WHEN 53 THEN 'dns_amplification' WHEN 123 THEN 'ntp_amplification' WHEN 1900 THEN 'ssdp_amplification' END, 'mixed')"""
    return f"""CASE family WHEN 'unknown' THEN CASE WHEN sub <> '' THEN sub ELSE {reflector} END
  WHEN 'udp_flood' THEN CASE WHEN fragment_pct > 30 THEN 'udp_fragment_flood'
    WHEN dst_port = 443 AND {avg} > 0 AND {avg} < 1300 THEN 'quic_flood' WHEN {reflector} <> '' THEN {reflector}
    WHEN {avg} > 0 AND {avg} < 100 THEN 'small_packet_flood' WHEN {avg} > 1200 THEN 'amplification_generic' ELSE 'volumetric' END
  WHEN 'syn_flood' THEN CASE WHEN syn > 0.3 * ft AND ack > 0.3 * ft THEN 'syn_ack_flood' ELSE 'syn_flood' END
  WHEN 'tcp_flood' THEN CASE WHEN sub <> '' THEN sub ELSE 'tcp_generic' END
  WHEN 'multi_vector' THEN 'multi_' || CASE WHEN sub <> '' THEN sub ELSE {mixed} END
  WHEN 'dns_flood' THEN CASE WHEN (dst_port = 53 OR src_port = 53) AND {avg} > 512 THEN 'dns_amplification' ELSE 'dns_query_flood' END
  WHEN 'icmp_flood' THEN CASE WHEN {avg} > 1000 THEN 'ping_of_death' ELSE 'ping_flood' END
  WHEN 'protocol_flood' THEN CASE WHEN sub <> '' THEN sub ELSE 'gre_flood' END WHEN 'fragment_flood' THEN 'ip_fragment_flood' ELSE '' END"""


TOP_PORTS = """tp AS (SELECT dst_ip, tick, arg_min(dst_port, (-c, dst_port)) AS dst_port FROM (SELECT dst_ip, tick, dst_port, sum(packets) AS c
  FROM v_flows GROUP BY ALL) GROUP BY dst_ip, tick),
sp AS (SELECT dst_ip, tick, arg_min(src_port, (-c, src_port)) AS src_port FROM (SELECT dst_ip, tick, src_port, sum(packets) AS c
  FROM v_flows GROUP BY ALL) GROUP BY dst_ip, tick)"""
oracle("classify_subtype", f"""SELECT dst_ip, tick, family, {subtype_sql('avg_pkt_size')} AS subtype
FROM (SELECT *, {TCP_SUBTYPE} AS sub FROM (SELECT *, {FLAG_TOTAL} FROM v_family JOIN tp USING (dst_ip, tick) JOIN sp USING (dst_ip, tick)))""",
       "v_family", extra=TOP_PORTS)

_NAME = "lower(trim(split_part(top_hit, ':', 1)))"
TOOL_SUBTYPE = "CASE " + " ".join(f"WHEN contains({_NAME}, '{word}') THEN '{sub}'" for word, sub, _ in TOOL_WORDS) + " END"
TOOL_NAME = "CASE " + " ".join(f"WHEN contains({_NAME}, '{word}') THEN {_quoted(tool) if tool else 'NULL'}"
                               for word, _, tool in TOOL_WORDS) + " END"
HINT = "trim(substr(top_hit, strpos(top_hit, ':') + 1))"
NEW_FAMILY = f"CASE WHEN top_hit IS NOT NULL AND {HINT} NOT IN ('', 'unknown') AND family IN ('unknown', '') THEN {HINT} ELSE family END"
NEW_SUBTYPE = f"""CASE WHEN {TOOL_SUBTYPE} IS NOT NULL AND subtype IN ('', 'volumetric', 'syn_flood', 'ping_flood', 'tcp_generic')
  THEN {TOOL_SUBTYPE} ELSE subtype END"""
# least() skips nulls here
BOOST = "cast(CASE WHEN top_hit_count IS NULL THEN 0 ELSE least(top_hit_count, 30) END AS bigint)"
BREAKDOWN_FAMILY = family_sql(syn="sr", other="other_pct", frag="fragment_pct", dns="dns")
VIEWS["v_summary"] = (("v_breakdown", "v_ioc_top"), f"""
SELECT b.*, {SYN_RATIO} AS sr, {FLAG_TOTAL}, top_hit, top_hit_count, s.avg_len, s.std_len, n.dns_unique, coalesce(n.dns_unique, 0) >= 10 AS dns,
  tp.dst_port, sp.src_port, g.top_signature, g.top_signature_count
FROM v_breakdown b LEFT JOIN v_ioc_top USING (dst_ip)
JOIN (SELECT dst_ip, round(sum(pkt_len) / count(*), 1) AS avg_len, round(stddev_pop(pkt_len), 1) AS std_len FROM v_packets GROUP BY dst_ip) s USING (dst_ip)
LEFT JOIN (SELECT dst_ip, count(DISTINCT dns_qname) AS dns_unique FROM v_packets GROUP BY dst_ip) n USING (dst_ip)
JOIN (SELECT dst_ip, arg_min(dst_port, (-c, dst_port)) AS dst_port FROM (SELECT dst_ip, dst_port, count(*) AS c FROM v_packets GROUP BY ALL)
  GROUP BY dst_ip) tp USING (dst_ip)
JOIN (SELECT dst_ip, arg_min(src_port, (-c, src_port)) AS src_port FROM (SELECT dst_ip, src_port, count(*) AS c FROM v_packets GROUP BY ALL)
  GROUP BY dst_ip) sp USING (dst_ip)
LEFT JOIN (SELECT dst_ip, arg_min(signature, (-c, signature)) AS top_signature, max(c) AS top_signature_count FROM (SELECT dst_ip, signature,
  count(*) AS c FROM (SELECT dst_ip, {SIGNATURE} AS signature FROM v_payloads) WHERE signature IS NOT NULL GROUP BY ALL) GROUP BY dst_ip) g
  USING (dst_ip)""")
oracle("enrich_from_ioc", f"""SELECT dst_ip, family AS before, {NEW_FAMILY} AS family, {NEW_SUBTYPE} AS subtype, {TOOL_NAME} AS tool, {BOOST} AS boost
FROM (SELECT *, 'volumetric' AS subtype, {family_sql(syn="sr", other="other_pct", frag="fragment_pct")} AS family FROM v_summary)""",
       "v_summary")
RESOLVED = f"""r1 AS (SELECT *, {BREAKDOWN_FAMILY} AS family FROM v_summary),
r2 AS (SELECT *, {subtype_sql('avg_len')} AS s0 FROM (SELECT *, {TCP_SUBTYPE} AS sub FROM r1)),
r3 AS (SELECT * EXCLUDE (family), CASE WHEN family = 'unknown' AND tcp_pct > 40 AND sub <> '' THEN 'tcp_flood' ELSE family END AS family,
  CASE WHEN family IN ('unknown', 'tcp_flood') AND tcp_pct > 40 AND sub <> '' THEN sub ELSE s0 END AS subtype FROM r2),
r4 AS (SELECT * EXCLUDE (family, subtype), {NEW_FAMILY} AS f4, {NEW_SUBTYPE} AS s4, {TOOL_NAME} AS tool, {BOOST} AS boost,
  top_signature_count >= 5 AS sure FROM r3),
resolved AS (SELECT *, CASE WHEN sure AND f4 IN ('udp_flood', 'unknown', 'multi_vector') THEN 'udp_flood' ELSE f4 END AS family,
  CASE WHEN sure THEN CASE top_signature WHEN 'ntp_monlist' THEN 'ntp_amplification' ELSE top_signature || '_amplification' END ELSE s4 END AS subtype
  FROM r4)"""
oracle("resolve_family_subtype", "SELECT dst_ip, family, subtype, tool, boost FROM resolved", "v_summary", extra=RESOLVED)

# --- web requests ----------------------------------------------------------

VIEWS["v_w"] = (("v_http",), """
SELECT h.*, t.i + h.tick AS upto, h.tick AS born FROM v_http h, (SELECT unnest(range(0, 10)) AS i) t""")
_THREAT_SUMS = ",\n  ".join(
    f"count(*) FILTER ({GATE} AND regexp_matches(path, {_quoted('(?i)' + p)})) AS threat_{n}" for n, p in THREAT_PATTERNS.items())
VIEWS["v_stats"] = (("v_w",), f"""
SELECT *, {' + '.join('threat_' + n for n in THREAT_PATTERNS)} AS threat_total,
  round(real_rps, 1) AS rps, round(real_rps / unique_ips, 1) AS rps_per_ip
FROM (SELECT *, total_requests / elapsed AS real_rps, round(elapsed, 1) AS window_seconds,
  round((status_4xx + status_5xx) / total_requests * 100, 1) AS error_rate, round(bots / total_requests * 100, 1) AS bot_request_pct,
  round(v10 / total_requests * 100, 1) AS http_1_0_pct, round(v11 / total_requests * 100, 1) AS http_1_1_pct,
  round(v2 / total_requests * 100, 1) AS h2_pct, round(v3 / total_requests * 100, 1) AS h3_pct
FROM (SELECT site_id, upto AS tick, count(*) AS total_requests, CASE WHEN count(*) > 1 THEN greatest(1.0, upto - min(born))::double ELSE 10.0 END AS elapsed,
  count(DISTINCT ip) AS unique_ips,
  {', '.join(f"count(*) FILTER (status // 100 = {d}) AS status_{d}xx" for d in (1, 2, 3, 4, 5))},
  count(*) FILTER (status = 499) AS status_499, count(*) FILTER (regexp_matches(ua, {_quoted('(?i)' + BOT_AGENTS)})) AS bots,
  count(*) FILTER (http_version = '1.0') AS v10, count(*) FILTER (http_version = '1.1') AS v11, count(*) FILTER (http_version = '2') AS v2,
  count(*) FILTER (http_version = '3') AS v3, round(avg(resp_time_ms), 1) AS avg_response_ms,
  {_THREAT_SUMS}
FROM v_w GROUP BY site_id, upto))""")
VIEWS["v_l7"] = (("v_stats", "v_w"), """
SELECT * FROM v_stats JOIN (SELECT site_id, upto AS tick, max(c) AS top_ip_count FROM (SELECT site_id, upto, ip, count(*) AS c FROM v_w GROUP BY ALL)
  GROUP BY site_id, upto) USING (site_id, tick)
JOIN (SELECT site_id, upto AS tick, max(c) AS top_path_count, arg_min(path, (-c, path)) AS top_path FROM (SELECT site_id, upto, path, count(*) AS c
  FROM v_w GROUP BY ALL) GROUP BY site_id, upto) USING (site_id, tick)""")
_L7_COLUMNS = ", ".join(
    ["site_id", "tick", "total_requests", "rps", "window_seconds", "unique_ips", "error_rate"]
    + [f"status_{g}" for g in ("1xx", "2xx", "3xx", "4xx", "5xx", "499")] + ["bot_request_pct"]
    + [f"threat_{n}" for n in THREAT_PATTERNS]
    + ["threat_total", "http_1_0_pct", "http_1_1_pct", "h2_pct", "h3_pct", "avg_response_ms", "rps_per_ip", "top_ip_count", "top_path",
       "top_path_count"])
oracle("l7_window_stats", f"SELECT {_L7_COLUMNS} FROM v_l7", "v_l7")
for _name, _item, _k in (("l7_top_ips", "ip", 50), ("l7_top_paths", "path", 20), ("l7_top_agents", "ua", 20)):
    oracle(_name, _topk(f"(SELECT site_id, upto AS tick, {_item} FROM v_w)", "site_id, tick", _item, "count(*)", _k),
           "v_w")
_AUTH = " OR ".join(f"contains(lower(top_path), '{p}')" for p in (
    "/login", "/signin", "/auth", "/oauth", "/api/login", "/wp-login.php", "/admin/login", "/user/login"))
L7_SUBTYPE = f"""CASE WHEN h2_pct > 30 AND rps > 200 AND status_499 / total_requests * 100 > 20 AND rps_per_ip > 50 THEN 'h2_rapid_reset'
  WHEN h2_pct > 30 AND rps_per_ip > 200 AND unique_ips < 20 AND rps > 500 THEN 'h2_settings_flood'
  WHEN h2_pct > 30 AND rps_per_ip > 100 AND unique_ips < 30 AND status_4xx / total_requests * 100 > 40 THEN 'h2_continuation_flood'
  WHEN h3_pct > 30 AND rps > 300 AND unique_ips > 5 THEN 'quic_flood' WHEN unique_ips <= 2 AND total_requests > 50 THEN 'single_source_abuse'
  WHEN top_path_count / total_requests > 0.5 AND error_rate > 40 AND ({_AUTH}) THEN 'credential_stuffing'
  WHEN top_path_count / total_requests > 0.7 AND error_rate < 20 THEN 'scraping'
  WHEN contains(lower(top_path), '/api/') OR contains(lower(top_path), '/graphql') THEN 'api_abuse'
  WHEN rps < 50 AND unique_ips > 20 AND error_rate > 60 THEN 'slow_rate' WHEN rps > 500 AND unique_ips > 10 THEN 'volumetric_flood'
  ELSE 'l7_flood' END"""
oracle("classify_l7_subtype", f"SELECT site_id, tick, total_requests, {L7_SUBTYPE} AS attack_subtype FROM v_l7", "v_l7")
oracle("l7_path_max", """SELECT site_id, tick, top_path, top_path_count, round(top_path_count / total_requests, 6) AS path_share,
  round(top_ip_count / total_requests, 6) AS ip_share FROM v_l7""", "v_l7")
VIEWS["v_spans"] = (("v_stats",), """
SELECT site_id, site_id || '@' || min(tick) AS incident_id, min(tick) AS a, max(tick) AS b FROM (SELECT *, row_number() OVER
  (PARTITION BY site_id ORDER BY tick) - row_number() OVER (PARTITION BY site_id, error_rate > 40 ORDER BY tick) AS island FROM v_stats)
WHERE error_rate > 40 GROUP BY site_id, island HAVING count(*) >= 3""")
oracle("l7_attack_summary", """SELECT incident_id, w AS window_summed_requests, status_2xx, status_3xx, status_4xx, status_5xx, threat_hits,
  """ + ", ".join(f"CASE WHEN c0 + c1 + c2 + c3 > 0 THEN round({c} / (c0 + c1 + c2 + c3) * 100, 1) ELSE 0.0 END AS {n}_pct"
                  for c, n in (("c0", "h1_0"), ("c1", "h1_1"), ("c2", "h2"), ("c3", "h3"))) + """, exact_requests
FROM (SELECT incident_id, cast(sum(total_requests) AS bigint) AS w, cast(sum(status_2xx) AS bigint) AS status_2xx,
  cast(sum(status_3xx) AS bigint) AS status_3xx, cast(sum(status_4xx) AS bigint) AS status_4xx, cast(sum(status_5xx) AS bigint) AS status_5xx,
  cast(sum(threat_total) AS bigint) AS threat_hits, sum(round(http_1_0_pct / 100 * total_requests)) AS c0,
  sum(round(http_1_1_pct / 100 * total_requests)) AS c1, sum(round(h2_pct / 100 * total_requests)) AS c2,
  sum(round(h3_pct / 100 * total_requests)) AS c3
  FROM v_stats s JOIN v_spans p ON s.site_id = p.site_id AND s.tick BETWEEN a AND b GROUP BY incident_id)
JOIN (SELECT incident_id, count(h.event_id) AS exact_requests FROM v_spans p LEFT JOIN v_http h ON h.site_id = p.site_id AND h.tick BETWEEN a AND b
  GROUP BY incident_id) USING (incident_id)""", "v_stats", "v_spans", "v_http")
oracle("l7_attack_top_paths", """SELECT incident_id, path, window_summed, rank FROM (SELECT *, row_number() OVER (PARTITION BY incident_id
  ORDER BY window_summed DESC, path) AS rank FROM (SELECT incident_id, path, cast(sum(c) AS bigint) AS window_summed
  FROM (SELECT *, row_number() OVER (PARTITION BY site_id, tick ORDER BY c DESC, path) AS r FROM (SELECT site_id, upto AS tick, path, count(*) AS c
    FROM v_w GROUP BY ALL)) t JOIN v_spans p ON t.site_id = p.site_id AND t.tick BETWEEN a AND b WHERE r <= 20
  GROUP BY incident_id, path)) WHERE rank <= 20""", "v_w", "v_spans")
oracle("l7_attack_whole_paths", """SELECT incident_id, path, window_summed, exact_count, rank FROM (SELECT *, row_number() OVER (PARTITION BY incident_id
  ORDER BY window_summed DESC, path) AS rank FROM (SELECT incident_id, path, count(*) AS window_summed, count(*) FILTER (upto = born) AS exact_count
  FROM v_w t JOIN v_spans p ON t.site_id = p.site_id AND t.upto BETWEEN a AND b GROUP BY incident_id, path)) WHERE rank <= 20""", "v_w", "v_spans")

_ATTACK_KINDS = {"path": ("path", "true", 20), "ip": ("ip", "true", 50), "ua": ("ua", "ua <> ''", 20)} | {
    f"threat {name}": (f"'{name}'", f"{GATE} AND regexp_matches(path, {_quoted('(?i)' + p)})", 10) for name, p in THREAT_PATTERNS.items()}
oracle("l7_attack_lists", f"""SELECT incident_id, kind, item, window_summed, exact_count, rank FROM (SELECT *, row_number() OVER (PARTITION BY incident_id, kind
  ORDER BY window_summed DESC, item) AS rank FROM ({' UNION ALL '.join(f"""SELECT incident_id, '{kind.split()[0]}' AS kind, {item} AS item, {k} AS k,
  count(*) AS window_summed, count(*) FILTER (upto = born) AS exact_count
  FROM v_w t JOIN v_spans p ON t.site_id = p.site_id AND t.upto BETWEEN a AND b WHERE {rule} GROUP BY incident_id, {item}"""
    for kind, (item, rule, k) in _ATTACK_KINDS.items())})) WHERE rank <= k""", "v_w", "v_spans")

# --- reports ---------------------------------------------------------------

oracle("topk_per_group", """SELECT dst_ip, octets, flow_id, flow_line, src_ip, rank FROM (SELECT *, row_number() OVER (PARTITION BY dst_ip
  ORDER BY octets DESC, flow_id, flow_line, src_ip) AS rank FROM v_flows) WHERE rank <= 10""", "v_flows")
oracle("sustained_floods", f"""SELECT dst_ip, first_tick, last_tick, length, peak_pps, peak_bps, peak_sources, threshold, tcp_pct, udp_pct, icmp_pct,
  {family_sql(syn="CASE WHEN flags > 0 THEN syn / flags ELSE 0.0 END")} AS family
FROM (SELECT *, round(t / (t + u + i) * 100, 1) AS tcp_pct, round(u / (t + u + i) * 100, 1) AS udp_pct, round(i / (t + u + i) * 100, 1) AS icmp_pct
  FROM v_floods)""", "v_floods")
oracle("dst_report", """SELECT tick, dst_ip AS ip, coalesce(label, '') AS label, round(pps, 1) AS pps, round(bps, 1) AS bps, tcp_pct, udp_pct,
  icmp_pct, round(coalesce(avg_pps, 0), 1) AS baseline_pps, round(threshold, 1) AS threshold_pps,
  CASE WHEN hot THEN 'attack' WHEN threshold > 0 AND pps > threshold * 0.7 THEN 'elevated' ELSE 'normal' END AS status, src_ip_count
FROM (SELECT *, row_number() OVER (PARTITION BY tick, hot ORDER BY pps DESC, dst_ip) AS r FROM v_hot) LEFT JOIN v_labels ON ip = dst_ip
WHERE hot OR r <= 100""", "v_hot", "v_labels")
oracle("dst_report_totals", """SELECT tick, round(sum(pps), 1) AS total_pps, round(sum(bps), 1) AS total_bps, count(*) AS tracked_ip_count,
  count(*) FILTER (hot) AS active_attacks FROM v_hot GROUP BY tick""", "v_hot")
oracle("ip_status", """SELECT dst_ip, tick, CASE WHEN threshold > 0 AND pps > threshold * 0.7 THEN 'elevated' ELSE 'normal' END AS status
FROM v_hot""", "v_hot")


# --- detectors -------------------------------------------------------------

# The detectors feed back into themselves, so these oracles walk the ticks with a
# recursive CTE that carries the learned samples as lists.
_P99 = "list_sort({v})[least(len({v}) * 99 // 100, len({v}) - 1) + 1]"
_REFRESH = f"""SELECT * EXCLUDE (p99, avg_bps, thr, bthr, pend),
  CASE WHEN due THEN {_P99.format(v='pl')} ELSE p99 END AS p99, CASE WHEN due THEN list_avg(bl) ELSE avg_bps END AS avg_bps,
  CASE WHEN due THEN greatest(5000.0, 3 * CASE WHEN len(hl) >= 60 THEN greatest({_P99.format(v='hl')}, 0.5 * {_P99.format(v='pl')})
    ELSE {_P99.format(v='pl')} END) ELSE thr END AS thr,
  CASE WHEN due AND ready THEN greatest(3 * {_P99.format(v='bl')}, 50000000.0) ELSE bthr END AS bthr,
  CASE WHEN due THEN 0 ELSE pend END AS pend"""


def _learn(source: str, rule: str) -> str:
    """Nested steps: append the sample where ``rule`` holds, refresh every tenth time, mark readiness."""
    added = f"""SELECT * EXCLUDE (pl, bl, hl, pend, avg_pps), CASE WHEN learn THEN list_append(pl, pps)[-300:] ELSE pl END AS pl,
    CASE WHEN learn THEN list_append(bl, bps)[-300:] ELSE bl END AS bl, CASE WHEN learn THEN list_append(hl, pps)[-360:] ELSE hl END AS hl,
    CASE WHEN learn AND len(pl) >= 1 THEN pend + 1 ELSE pend END AS pend, avg_pps FROM (SELECT *, {rule} AS learn FROM ({source}))"""
    due = f"SELECT * EXCLUDE (avg_pps), CASE WHEN learn AND len(pl) >= 2 THEN list_avg(pl) ELSE avg_pps END AS avg_pps, learn AND pend >= 10 AS due FROM ({added})"
    fresh = f"{_REFRESH} FROM ({due})"
    return f"SELECT * EXCLUDE (ready), ready OR len(pl) >= 300 AS ready FROM ({fresh})"


_START = """[]::DOUBLE[] AS pl, []::DOUBLE[] AS bl, []::DOUBLE[] AS hl, 0 AS pend, 0.0::DOUBLE AS avg_pps, 0.0::DOUBLE AS avg_bps,
  0.0::DOUBLE AS p99, 5000.0::DOUBLE AS thr, 0.0::DOUBLE AS bthr, false AS ready"""
_KEEP = "pl, bl, hl, pend, avg_pps, avg_bps, p99, thr, bthr, ready"

_DST_STEP = f"""SELECT dst_ip, tick, {_KEEP}, learned, confirm2 AS confirm, op2 AS op, started2 AS started, pk2 AS pk, bk2 AS bk,
  below2 AS below, CASE WHEN ev IN ('open', 'update') THEN tick ELSE updated END AS updated, ev, pps, bps, fresh FROM (
 SELECT *, CASE WHEN op AND below2 >= 10 THEN 'resolve' WHEN op AND present AND tick - updated >= 5 THEN 'update'
   WHEN NOT op AND confirm1 >= 3 THEN 'open' END AS ev, op AND below2 < 10 OR NOT op AND confirm1 >= 3 AS op2,
   CASE WHEN NOT op AND confirm1 >= 3 THEN 0 ELSE confirm1 END AS confirm2, CASE WHEN NOT op AND confirm1 >= 3 THEN tick ELSE started END AS started2,
   CASE WHEN op THEN greatest(pk, pps) WHEN confirm1 >= 3 THEN pps ELSE pk END AS pk2,
   CASE WHEN op THEN greatest(bk, bps) WHEN confirm1 >= 3 THEN bps ELSE bk END AS bk2 FROM (
  SELECT *, CASE WHEN NOT op THEN 0 WHEN NOT present OR pps < CASE WHEN fresh THEN 10000.0 ELSE thr END THEN below + 1 ELSE 0 END AS below2,
    CASE WHEN op OR NOT present THEN confirm WHEN NOT over THEN 0 WHEN ready OR pps >= 50000 THEN confirm + 1 ELSE confirm END AS confirm1 FROM (
   SELECT *, CASE WHEN NOT ready THEN pps >= 10000 OR bps >= 500000000 ELSE pps > thr OR (avg_bps > 0 AND bps > avg_bps * 10) END AS over FROM (
    SELECT * EXCLUDE (learned, fresh), CASE WHEN learn THEN tick ELSE learned END AS learned, fresh AND NOT learn AS fresh FROM (LEARNT)))))"""
_DST_NEXT = """SELECT s.* EXCLUDE (tick, ev, pps, bps, pl, bl, hl, pend, avg_pps, avg_bps, p99, thr, bthr, ready, fresh), g.tick, g.present, g.pps, g.bps,
  gone OR s.fresh AS fresh, CASE WHEN gone THEN [] ELSE s.pl END AS pl, CASE WHEN gone THEN [] ELSE s.bl END AS bl,
  CASE WHEN gone THEN [] ELSE s.hl END AS hl, CASE WHEN gone THEN 0 ELSE s.pend END AS pend, CASE WHEN gone THEN 0.0 ELSE s.avg_pps END AS avg_pps,
  CASE WHEN gone THEN 0.0 ELSE s.avg_bps END AS avg_bps, CASE WHEN gone THEN 0.0 ELSE s.p99 END AS p99,
  CASE WHEN gone THEN 5000.0 ELSE s.thr END AS thr, CASE WHEN gone THEN 0.0 ELSE s.bthr END AS bthr, s.ready AND NOT gone AS ready
FROM (SELECT w.*, coalesce(g0.tick - w.learned > 600 AND g0.present, false) AS gone FROM w JOIN grid g0 ON g0.dst_ip = w.dst_ip AND g0.tick = w.tick + 1) s
JOIN grid g ON g.dst_ip = s.dst_ip AND g.tick = s.tick + 1"""
_DST_WALK = f"""grid AS (SELECT d.dst_ip, t.tick, m.pps IS NOT NULL AS present, coalesce(m.pps, 0.0) AS pps, coalesce(m.bps, 0.0) AS bps
  FROM (SELECT DISTINCT dst_ip FROM v_dst) d CROSS JOIN (SELECT unnest(range(0, (SELECT max(tick) + 1 FROM v_dst))) AS tick) t
  LEFT JOIN v_dst m ON m.dst_ip = d.dst_ip AND m.tick = t.tick),
w AS (SELECT dst_ip, -1::BIGINT AS tick, {_START}, NULL::BIGINT AS learned, 0 AS confirm, false AS op, NULL::BIGINT AS started, 0.0::DOUBLE AS pk,
  0.0::DOUBLE AS bk, 0 AS below, 0::BIGINT AS updated, NULL::VARCHAR AS ev, 0.0::DOUBLE AS pps, 0.0::DOUBLE AS bps, true AS fresh
  FROM (SELECT DISTINCT dst_ip FROM v_dst)
  UNION ALL {_DST_STEP.replace('LEARNT', _learn(_DST_NEXT, 'present AND NOT op AND (fresh OR ready OR pps < 10000)'))})"""
DST_EVENTS = """SELECT dst_ip AS key, ev AS event, tick, started AS started_tick, pps, bps, pk AS peak_pps, bk AS peak_bps,
  CASE WHEN fresh THEN 0.0 ELSE thr END AS threshold, avg_pps FROM w WHERE ev IS NOT NULL"""
oracle("detect_dst", f"SELECT * EXCLUDE (avg_pps), round(avg_pps, 6) AS avg_pps FROM ({DST_EVENTS})", "v_dst", recursive=True, extra=_DST_WALK)
DST_INCIDENTS = """SELECT key || '@' || started_tick AS incident_id, key, started_tick, max(CASE WHEN event = 'resolve' THEN tick END) AS ended_tick,
  max(CASE WHEN event = 'resolve' THEN tick END) - started_tick AS duration, max(peak_pps) AS peak_pps, max(peak_bps) AS peak_bps,
  arg_max(threshold, tick) AS threshold, round(arg_min(avg_pps, tick), 1) AS baseline_pps, count(*) FILTER (event = 'update') AS updates
FROM events0 GROUP BY key, started_tick"""
oracle("dst_incidents", DST_INCIDENTS, "v_dst", recursive=True, extra=_DST_WALK + f", events0 AS ({DST_EVENTS})")

_NODE_STEP = f"""SELECT node_id, rn, first, tick, {_KEEP}, above2 AS above, op2 AS op, started2 AS started, pk2 AS pk, bk2 AS bk, below2 AS below,
  CASE WHEN ev IN ('open', 'update') THEN tick ELSE updated END AS updated, CASE WHEN ev = 'resolve' THEN tick ELSE last_end END AS last_end,
  ev, pps, bps FROM (
 SELECT *, CASE WHEN op AND below2 >= 10 THEN 'resolve' WHEN op AND tick - updated >= 5 THEN 'update' WHEN opens THEN 'open' END AS ev,
   op AND below2 < 10 OR opens AS op2, CASE WHEN opens THEN tick ELSE started END AS started2, CASE WHEN opens THEN 0 ELSE above1 END AS above2,
   CASE WHEN op THEN greatest(pk, pps) WHEN opens THEN pps ELSE pk END AS pk2, CASE WHEN op THEN greatest(bk, bps) WHEN opens THEN bps ELSE bk END AS bk2 FROM (
  SELECT *, CASE WHEN NOT op THEN 0 WHEN pps < thr THEN below + 1 ELSE 0 END AS below2,
    NOT op AND over2 AND (pps >= 50000 OR above1 >= 3) AS opens FROM (
   SELECT *, CASE WHEN op THEN above WHEN over2 THEN above + 1 ELSE 0 END AS above1 FROM (
    SELECT *, over AND (pps >= 50000 OR NOT ((NOT ready AND tick - first < 90) OR coalesce(tick - last_end < 60, false))) AS over2 FROM (
     SELECT *, pps > thr * CASE WHEN ratio > 0.3 THEN 0.7 ELSE 1.0 END OR (bthr > 0 AND bps > bthr)
       OR (NOT ready AND (pps >= 10000 OR bps > 1000000000)) AS over FROM (LEARNT))))))"""
_NODE_NEXT = """SELECT w.* EXCLUDE (rn, tick, ev, pps, bps, first), n.rn, n.tick, n.pps, n.bps, n.ratio, coalesce(w.first, n.tick) AS first
FROM w JOIN n ON n.node_id = w.node_id AND n.rn = w.rn + 1"""
_NODE_WALK = f"""n AS (SELECT node_id, tick, cast(sum(packets) AS double) AS pps, cast(sum(octets) * 8 AS double) AS bps,
  count(DISTINCT CASE WHEN src_ip IN (SELECT indicator FROM v_blocklist) THEN src_ip END) / count(DISTINCT src_ip) AS ratio,
  row_number() OVER (PARTITION BY node_id ORDER BY tick) AS rn FROM v_flows GROUP BY node_id, tick),
w AS (SELECT node_id, 0::BIGINT AS rn, NULL::BIGINT AS first, -1::BIGINT AS tick, {_START}, 0 AS above, false AS op, NULL::BIGINT AS started,
  0.0::DOUBLE AS pk, 0.0::DOUBLE AS bk, 0 AS below, 0::BIGINT AS updated, NULL::BIGINT AS last_end, NULL::VARCHAR AS ev, 0.0::DOUBLE AS pps,
  0.0::DOUBLE AS bps FROM (SELECT DISTINCT node_id FROM v_flows)
  UNION ALL {_NODE_STEP.replace('LEARNT', _learn(_NODE_NEXT, 'NOT op AND above = 0 AND pps <= thr AND (ready OR pps < 10000)'))})"""
oracle("detect_node", """SELECT node_id AS key, ev AS event, tick, started AS started_tick, pps, bps, pk AS peak_pps, bk AS peak_bps, thr AS threshold,
  round(avg_pps, 6) AS avg_pps FROM w WHERE ev IS NOT NULL""", "v_flows", "v_blocklist", recursive=True, extra=_NODE_WALK)

_HTTP_STEP = """SELECT site_id, rn, CASE WHEN ev = 'resolve' THEN greatest(rps, 1.0) ELSE base2 END AS base, CASE WHEN ev = 'resolve' THEN 1 ELSE n2 END AS n,
  ev <> 'resolve' AND (op OR opens) AS op, CASE WHEN opens THEN tick ELSE started END AS started, peak2 AS peak, CASE WHEN opens THEN 0 ELSE calm2 END AS calm,
  CASE WHEN ev <> '' THEN ev END AS ev, tick, rps, signals2 AS signals, base2 AS shown FROM (
 SELECT *, CASE WHEN op AND calm2 >= 3 THEN 'resolve' WHEN op THEN 'update' WHEN opens THEN 'open' ELSE '' END AS ev, CASE WHEN opens THEN signals ELSE 0 END AS signals2,
   CASE WHEN opens THEN rps ELSE peak1 END AS peak2 FROM (
  SELECT *, CASE WHEN NOT op THEN 0 WHEN tick - started < 15 THEN calm WHEN total_requests < 10 OR rps < 50 OR (rps < peak1 * 0.1 AND error_rate < 30)
     OR (base2 > 5 AND rps < base2 * 2 AND error_rate < 30) THEN calm + 1 ELSE 0 END AS calm2,
    NOT op AND total_requests >= 15 AND signals >= 2 AND unique_ips >= 3 AS opens FROM (
   SELECT *, CASE WHEN op AND total_requests >= 15 THEN greatest(peak, rps) ELSE peak END AS peak1,
     CASE WHEN rps > lim THEN 2 ELSE 0 END + (top_ip_count > 20 AND top_ip_count / total_requests > 0.3)::INT
     + (top_path_count > 30 AND top_path_count / total_requests > 0.6)::INT + (error_rate > 50 AND total_requests > 20)::INT
     + (status_5xx > greatest(total_requests * 0.3, 15))::INT + (bot_request_pct > 70 AND total_requests > 30)::INT
     + (threat_total > greatest(total_requests * 0.2, 10))::INT AS signals FROM (
    SELECT *, CASE WHEN n2 < 10 THEN 500.0 WHEN n2 >= 30 THEN CASE WHEN base2 > 1 THEN base2 * 5 ELSE 100.0 END
      WHEN base2 > 5 THEN greatest(base2 * 5, 150.0) ELSE 150.0 END AS lim FROM (
     SELECT *, CASE WHEN clean THEN base * (1 - a) + a * rps ELSE base END AS base2, CASE WHEN clean THEN n + 1 ELSE n END AS n2 FROM (
      SELECT w.site_id, r.rn, w.base, w.n, w.op, w.started, w.peak, w.calm, r.tick, r.rps, r.total_requests, r.unique_ips, r.error_rate, r.top_ip_count,
        r.top_path_count, r.status_5xx, r.bot_request_pct, r.threat_total, CASE WHEN w.n < 300 THEN 1 / (w.n + 1) ELSE 0.01 END AS a,
        NOT w.op AND r.total_requests >= 15 AND r.error_rate < 60 AND (w.n < 3 OR r.rps < w.base * 10) AS clean
      FROM w JOIN r ON r.site_id = w.site_id AND r.rn = w.rn + 1))))))"""
_HTTP_WALK = f"""r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY tick) AS rn FROM v_l7),
w AS (SELECT site_id, 0::BIGINT AS rn, 0.0::DOUBLE AS base, 0 AS n, false AS op, NULL::BIGINT AS started, 0.0::DOUBLE AS peak, 0 AS calm, NULL::VARCHAR AS ev,
  -1::BIGINT AS tick, 0.0::DOUBLE AS rps, 0 AS signals, 0.0::DOUBLE AS shown FROM (SELECT DISTINCT site_id FROM v_http) UNION ALL {_HTTP_STEP})"""
oracle("detect_http", """SELECT site_id AS key, ev AS event, tick, started AS started_tick, rps, peak AS peak_rps, round(shown, 1) AS baseline_rps,
  cast(signals AS bigint) AS signals FROM w WHERE ev IS NOT NULL""", "v_l7", recursive=True, extra=_HTTP_WALK)
oracle("l7_baseline", """SELECT site_id, tick, rps, clean, samples, round(usual, 6) AS baseline_rps FROM learned WHERE rn > 0""", "v_l7", recursive=True,
       extra="""r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY tick) AS rn FROM v_l7),
learned AS (SELECT site_id, 0::BIGINT AS rn, -1::BIGINT AS tick, 0.0::DOUBLE AS rps, false AS clean, 0::BIGINT AS samples, 0.0::DOUBLE AS usual
  FROM (SELECT DISTINCT site_id FROM v_http)
  UNION ALL SELECT site_id, rn, tick, rps, clean, samples + clean::BIGINT, CASE WHEN clean THEN (1 - a) * usual + a * rps ELSE usual END FROM (
    SELECT p.site_id, r.rn, r.tick, r.rps, p.samples, p.usual, CASE WHEN p.samples < 300 THEN 1 / (p.samples + 1) ELSE 0.01 END AS a,
      r.total_requests >= 15 AND r.error_rate < 60 AND (p.samples < 3 OR r.rps < p.usual * 10) AS clean
    FROM learned p JOIN r ON r.site_id = p.site_id AND r.rn = p.rn + 1))""")
oracle("detect_nonservice", """SELECT node_id, min(tick) AS started_tick, arg_max(close_tick, tick) AS ended_tick,
  cast(max(nsp) AS bigint) AS peak_non_service_pps, CASE WHEN arg_min(pps > threshold, tick) THEN 'both' ELSE 'non_service' END AS zone
FROM (SELECT *, sum(CASE WHEN gap >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY node_id ORDER BY tick) AS incident FROM (
  SELECT *, rn - lag(rn) OVER (PARTITION BY node_id ORDER BY tick) - 1 AS gap FROM (
    SELECT *, row_number() OVER k AS rn, lead(tick, 5) OVER k AS close_tick FROM rated JOIN r2 USING (node_id, tick)
    WINDOW k AS (PARTITION BY node_id ORDER BY tick)) WHERE nsp > 1000)) GROUP BY node_id, incident""", "v_flows",
       extra="""c AS (
  SELECT node_id, tick, pps, sum(x) OVER (PARTITION BY node_id ORDER BY tick) AS ns, max(tick) OVER (PARTITION BY node_id, tick // 5) AS slot_end
  FROM (SELECT node_id, tick, cast(sum(packets) AS double) AS pps, sum(CASE WHEN dst_port IN (80, 443) OR dst_port BETWEEN 8000 AND 8100
    THEN 0 ELSE packets END) AS x FROM v_flows GROUP BY node_id, tick)),
rated AS (SELECT node_id, tick, greatest(0, round((ns - lag(ns) OVER w) / (tick - lag(tick) OVER w))) AS nsp FROM c WHERE tick = slot_end
  WINDOW w AS (PARTITION BY node_id ORDER BY tick) QUALIFY lag(ns) OVER w IS NOT NULL),
r0 AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY tick) AS n, list(pps) OVER w AS pw, list(pps) OVER h AS hw FROM c
  WINDOW w AS (PARTITION BY node_id ORDER BY tick ROWS 299 PRECEDING), h AS (PARTITION BY node_id ORDER BY tick ROWS 359 PRECEDING)),
r1 AS (SELECT *, CASE WHEN n > 1 AND n % 10 = 1 THEN greatest(5000.0, 3 * CASE WHEN n >= 60 THEN greatest(
  list_sort(hw)[least(len(hw) * 99 // 100, len(hw) - 1) + 1], 0.5 * list_sort(pw)[least(len(pw) * 99 // 100, len(pw) - 1) + 1])
  ELSE list_sort(pw)[least(len(pw) * 99 // 100, len(pw) - 1) + 1] END) END AS fresh FROM r0),
r2 AS (SELECT node_id, tick, pps, coalesce(last_value(fresh IGNORE NULLS) OVER (PARTITION BY node_id ORDER BY tick ROWS UNBOUNDED PRECEDING),
  5000.0) AS threshold FROM r1)""")


# --- binary telemetry ------------------------------------------------------

# Each datagram carries the flows of one order (flow_id) at one exporter.
VIEWS["v_datagrams"] = (("v_flows",), """
SELECT exporter_ip, tick, flow_id, tick * 1000000000 + flow_id AS seq, count(*) AS lines FROM v_flows GROUP BY exporter_ip, tick, flow_id""")
_DECODED = "src_ip, dst_ip, src_port, dst_port, protocol"
oracle("route_datagrams", """SELECT prefix || exporter_ip AS exporter_ip, CASE prefix WHEN 'v5-' THEN 'netflow_v5' WHEN 'sflow-' THEN 'sflow'
  ELSE CASE WHEN right(exporter_ip, 1) IN ('0', '2') THEN 'netflow_v9' ELSE 'ipfix' END END AS kind, count(*) AS datagrams
FROM v_datagrams, (SELECT unnest(['v5-', 'sflow-', 'templated-']) AS prefix) GROUP BY ALL""", "v_datagrams")
oracle("decode_netflow_v5", f"""SELECT exporter_ip, tick, {_DECODED}, packets * rate AS packets, octets * rate AS octets, tcp_flags, rate AS sample_rate
FROM (SELECT *, greatest(1, cast(right(exporter_ip, 1) AS bigint)) AS rate FROM v_flows)""", "v_flows")
oracle("decode_sflow_v5", """SELECT exporter_ip, tick, src_ip, dst_ip, CASE WHEN protocol IN (6, 17) THEN src_port ELSE 0 END AS src_port,
  CASE WHEN protocol IN (6, 17) THEN dst_port ELSE 0 END AS dst_port, protocol, packets, octets,
  CASE WHEN protocol = 6 THEN tcp_flags ELSE 0 END AS tcp_flags, packets AS sample_rate FROM v_flows""", "v_flows")
oracle("extract_templates", """SELECT exporter_ip, 7::BIGINT AS domain, template_id::BIGINT AS template_id, seq, template_id = 300 AS is_options, CASE template_id
  WHEN 256 THEN '7:2,4:1,6:1,11:2,8:4,12:4,2:4,1:4' WHEN 257 THEN '8:4,12:4,2:8,1:8,6:2,4:1,7:2,11:2'
  ELSE CASE WHEN right(exporter_ip, 1) IN ('0', '2') THEN '1:4,34:4' ELSE '1:4,305:4' END END AS fields
FROM v_datagrams JOIN (VALUES (256, 5), (257, 7), (300, 11)) t(template_id, every) ON flow_id % every = 0""", "v_datagrams")
_KNOWN = """known AS (SELECT f.*, 1 AS one FROM (SELECT *, tick * 1000000000 + flow_id AS seq FROM v_flows) f JOIN (SELECT exporter_ip,
  min(seq) FILTER (flow_id % 5 = 0) AS first_even, min(seq) FILTER (flow_id % 7 = 0) AS first_odd FROM v_datagrams GROUP BY exporter_ip) a
  ON a.exporter_ip = f.exporter_ip AND f.seq >= CASE WHEN flow_line % 2 = 0 THEN first_even ELSE first_odd END)"""
oracle("decode_templated", f"""SELECT exporter_ip, tick, {_DECODED}, packets, octets, tcp_flags, 1::BIGINT AS sample_rate FROM known""", "v_datagrams",
       extra=_KNOWN)
oracle("extract_sampling", "SELECT exporter_ip, tick, seq, flow_id % 3 + 1 AS rate FROM v_datagrams WHERE flow_id % 11 = 0", "v_datagrams")
oracle("apply_sampling", """SELECT exporter_ip, tick, rate AS sample_rate, count(*) AS flows, cast(sum(packets * factor) AS bigint) AS packets,
  cast(sum(octets * factor) AS bigint) AS octets FROM (
 SELECT 'v5-' || exporter_ip AS exporter_ip, tick, greatest(1, cast(right(exporter_ip, 1) AS bigint)) AS rate, rate AS factor, packets, octets FROM v_flows
 UNION ALL SELECT 'sflow-' || exporter_ip, tick, packets, 1, packets, octets FROM v_flows
 UNION ALL SELECT 'templated-' || k.exporter_ip, k.tick, coalesce(r.rate, 1), coalesce(r.rate, 1), k.packets, k.octets
   FROM known k ASOF LEFT JOIN (SELECT exporter_ip, seq, flow_id % 3 + 1 AS rate FROM v_datagrams WHERE flow_id % 11 = 0) r
   ON k.exporter_ip = r.exporter_ip AND k.seq >= r.seq) GROUP BY ALL""", "v_datagrams", extra=_KNOWN)
oracle("exporter_allowlist", """SELECT exporter_ip, count(*) AS flows FROM v_flows WHERE exporter_ip IN ('198.51.100.1', '198.51.100.2')
GROUP BY exporter_ip""", "v_flows")
oracle("collector_quality", """SELECT exporter_ip, received, CASE WHEN ok THEN 0 ELSE received END AS rejected, CASE WHEN ok THEN bad ELSE 0 END AS errors,
  CASE WHEN ok THEN records ELSE 0 END AS records, CASE WHEN ok THEN filtered ELSE 0 END AS filtered
FROM (SELECT exporter_ip, exporter_ip <> '198.51.100.0' AS ok, count(*) AS received, count(*) FILTER (flow_id % 10 = 9) AS bad FROM v_datagrams
  GROUP BY exporter_ip) JOIN (SELECT exporter_ip, count(*) FILTER (flow_id % 10 <> 9) AS records,
  count(*) FILTER (flow_id % 10 <> 9 AND dst_ip <> '192.0.2.3') AS filtered FROM v_flows GROUP BY exporter_ip) USING (exporter_ip)""", "v_datagrams")
oracle("scan_pcap", """SELECT 'capture-' || (flow_id // 50) || '.pcap' AS path, 1::BIGINT AS link_type, count(*) AS frames,
  cast(sum(34 + CASE flow_line % 3 WHEN 0 THEN 0 WHEN 1 THEN 4 ELSE 8 END + CASE protocol WHEN 6 THEN 20 WHEN 47 THEN
    28 + CASE WHEN flow_id % 2 = 0 THEN 8 ELSE 4 END ELSE 8 END) AS bigint) AS bytes, max(tick * 1000000 + flow_line) AS last_us
FROM v_packets GROUP BY ALL""", "v_packets")
oracle("scan_large_pcap", f"SELECT *, frames - 1 AS last_no, frames AS numbers FROM ({ORACLES['scan_pcap']})")
_PORT = "CASE WHEN protocol IN (6, 17) THEN {p} ELSE 0 END AS {p}"
oracle("decode_frames", f"""SELECT flow_id, flow_line, src_ip, dst_ip, {_PORT.format(p='src_port')}, {_PORT.format(p='dst_port')}, protocol,
  CASE WHEN protocol = 47 THEN outer_len ELSE pkt_len END AS pkt_len, CASE WHEN protocol = 6 THEN tcp_flags ELSE 0 END AS tcp_flags, ttl, is_fragment
FROM v_packets""", "v_packets")
oracle("gre_decap", """SELECT flow_id, flow_line, src_ip, CASE WHEN was_gre THEN inner_dst_ip ELSE dst_ip END AS dst_ip,
  CASE WHEN protocol IN (6, 17, 47) THEN src_port ELSE 0 END AS src_port, CASE WHEN protocol IN (6, 17, 47) THEN dst_port ELSE 0 END AS dst_port,
  CASE WHEN was_gre THEN 17 ELSE protocol END AS protocol, pkt_len, CASE WHEN protocol = 6 THEN tcp_flags ELSE 0 END AS tcp_flags, ttl,
  is_fragment AND NOT was_gre AS is_fragment, was_gre, CASE WHEN was_gre THEN inner_dst_ip END AS inner_dst_ip,
  CASE WHEN was_gre THEN outer_len ELSE pkt_len END AS outer_len, inner_len FROM v_packets""", "v_packets")


# --- incidents and state ---------------------------------------------------

oracle("write_incidents", f"""SELECT key, started_tick, arg_max(event, (tick, event = 'resolve')) AS event, max(tick) AS tick, max(peak_pps) AS peak_pps,
  max(peak_bps) AS peak_bps FROM ({DST_EVENTS}) GROUP BY key, started_tick""", "v_dst", recursive=True, extra=_DST_WALK)
# Every destination has enough samples by tick 450, so resuming changes nothing after it.
oracle("baseline_snapshot", f"SELECT * EXCLUDE (avg_pps), round(avg_pps, 6) AS avg_pps FROM ({DST_EVENTS}) WHERE tick >= 450", "v_dst",
       recursive=True, extra=_DST_WALK)
_REPORT_TOP = """(SELECT incident_id, arg_min({c}, (-n, {c})) AS {a} FROM (SELECT incident_id, {c}, count(*) AS n FROM during GROUP BY ALL)
  GROUP BY incident_id)"""
_REPORT_LIST = """(SELECT incident_id, string_agg({c} || ':' || n, ';' ORDER BY r) AS {a} FROM (SELECT *, row_number() OVER (PARTITION BY incident_id
  ORDER BY n DESC, {c}) AS r FROM (SELECT incident_id, {c}, count(*) AS n FROM during WHERE {w} GROUP BY ALL)) WHERE r <= 20 GROUP BY incident_id)"""
_REPORT = f"""met AS (SELECT f.dst_ip || '@' || first_tick AS incident_id, ioc_hit FROM v_hits h
  JOIN v_floods f ON h.dst_ip = f.dst_ip AND h.tick BETWEEN first_tick AND last_tick WHERE ioc_hit IS NOT NULL),
during AS (SELECT p.*, f.dst_ip || '@' || first_tick AS incident_id FROM v_packets p
  JOIN v_floods f ON p.dst_ip = f.dst_ip AND p.tick BETWEEN first_tick AND last_tick),
v_summary AS (SELECT *, {SYN_RATIO} AS sr, {FLAG_TOTAL}, coalesce(dns_unique, 0) >= 10 AS dns FROM (
  SELECT f.dst_ip, f.dst_ip || '@' || first_tick AS incident_id, last_tick - first_tick AS duration, first_tick, last_tick, peak_pps, peak_bps,
    threshold FROM v_floods f)
 JOIN (SELECT incident_id, count(*) AS packets, round(count(*) FILTER (protocol = 6) / count(*) * 100, 1) AS tcp_pct,
   round(count(*) FILTER (protocol = 17) / count(*) * 100, 1) AS udp_pct, round(count(*) FILTER (protocol IN (1, 58)) / count(*) * 100, 1) AS icmp_pct,
   round(count(*) FILTER (protocol NOT IN (1, 6, 17, 58)) / count(*) * 100, 1) AS other_pct,
   round(count(*) FILTER (is_fragment) / count(*) * 100, 1) AS fragment_pct, count(DISTINCT dns_qname) AS dns_unique,
   {', '.join(f"count(*) FILTER (protocol = 6 AND tcp_flags & {bit} > 0) AS {name}" for name, bit in (('syn', 2), ('ack', 16), ('rst', 4), ('fin', 1), ('psh', 8), ('urg', 32)))},
   round(sum(pkt_len) / count(*), 1) AS avg_len, CASE WHEN count(*) < 2 THEN 999.0 ELSE round(stddev_pop(pkt_len), 1) END AS std_len
   FROM during GROUP BY incident_id) USING (incident_id)
 LEFT JOIN (SELECT incident_id, arg_min(ioc_hit, (-c, ioc_hit)) AS top_hit, max(c) AS top_hit_count FROM (SELECT incident_id, ioc_hit,
   count(*) AS c FROM met GROUP BY ALL) GROUP BY incident_id) USING (incident_id)
 LEFT JOIN (SELECT incident_id, arg_min(signature, (-c, signature)) AS top_signature, max(c) AS top_signature_count FROM (SELECT incident_id, signature,
   count(*) AS c FROM (SELECT f.dst_ip || '@' || first_tick AS incident_id, {SIGNATURE} AS signature FROM v_payloads p
   JOIN v_floods f ON p.dst_ip = f.dst_ip AND p.tick BETWEEN first_tick AND last_tick) WHERE signature IS NOT NULL GROUP BY ALL)
   GROUP BY incident_id) USING (incident_id)
 LEFT JOIN {_REPORT_TOP.format(c='dst_port', a='dst_port')} USING (incident_id) LEFT JOIN {_REPORT_TOP.format(c='src_port', a='src_port')} USING (incident_id)
 LEFT JOIN {_REPORT_LIST.format(c='src_ip', w='true', a='top_sources')} USING (incident_id)
 LEFT JOIN {_REPORT_LIST.format(c='dst_port', w='dst_port <> 0', a='top_ports')} USING (incident_id)
 LEFT JOIN (SELECT incident_id, string_agg(DISTINCT ioc_hit, ';' ORDER BY ioc_hit) AS distinct_hits FROM met GROUP BY incident_id) USING (incident_id)
 LEFT JOIN (SELECT incident_id, n AS src_ip_count, se, te, n >= 500 AND ((te > 4.0 AND se > 8.0) OR (n > 5000 AND se > 10.0)) AS spoofed FROM
   (SELECT incident_id, count(*) AS n, {ENTROPY} AS se FROM (SELECT incident_id, src_ip, count(*) AS c FROM during GROUP BY ALL) GROUP BY incident_id)
   JOIN (SELECT incident_id, {ENTROPY} AS te FROM (SELECT incident_id, ttl, count(*) AS c FROM during GROUP BY ALL) GROUP BY incident_id)
   USING (incident_id)) USING (incident_id)
 LEFT JOIN (SELECT incident_id, string_agg(t || ':' || cast(round(round(pps, 1) * 10) AS bigint), ';' ORDER BY t) AS velocity_curve FROM (
   SELECT f.dst_ip || '@' || first_tick AS incident_id, d.tick - first_tick AS t, d.pps, row_number() OVER (PARTITION BY f.dst_ip, first_tick,
     (d.tick - first_tick) // 5 ORDER BY d.tick) AS n FROM v_floods f JOIN v_dst d ON d.dst_ip = f.dst_ip AND d.tick BETWEEN first_tick AND last_tick)
   WHERE n = 1 GROUP BY incident_id) USING (incident_id)
 LEFT JOIN (SELECT incident_id, bool_or({' OR '.join(f"contains(lower(ioc_hit), '{word}')" for word in BOTNET_WORDS)}) AS botnet_named
   FROM met GROUP BY incident_id) USING (incident_id)),
{RESOLVED.replace('resolved AS (SELECT *,', 'resolved AS (SELECT *, src_ip_count > 5000 OR coalesce(botnet_named, false) AS botnet,')}"""
_SCORE = """cast(least(100, greatest(0, CASE WHEN duration < 10 THEN 15 WHEN duration < 30 THEN 25 WHEN duration < 120 THEN 35 ELSE 45 END
    + least(25, floor(peak_pps / greatest(threshold, 1) * 5)) + CASE WHEN src_ip_count > 5000 THEN 10 WHEN src_ip_count > 1000 THEN 5 ELSE 0 END
    + CASE WHEN greatest(tcp_pct, udp_pct, icmp_pct) > 80 THEN 10 ELSE 0 END + CASE WHEN avg_len > 0 AND std_len < 50 THEN 10 ELSE 0 END
    + CASE WHEN duration > 300 THEN 10 WHEN duration > 60 THEN 5 ELSE 0 END + least(20, boost) + CASE WHEN spoofed THEN 10 ELSE 0 END
    + CASE WHEN botnet THEN 10 ELSE 0 END)) AS bigint) AS confidence"""
oracle("incident_report", f"""SELECT incident_id, first_tick AS started_tick, last_tick AS ended_tick, duration, peak_pps, peak_bps, threshold,
  family AS attack_family, subtype AS attack_subtype, tool AS attack_tool, {_SCORE}, packets, tcp_pct, udp_pct, icmp_pct, other_pct, fragment_pct,
  src_ip_count, se AS src_entropy, te AS ttl_entropy, avg_len AS avg_pkt_length, std_len AS pkt_length_std, spoofed AS spoofing_detected,
  botnet AS botnet_detected, dns_unique, distinct_hits, top_sources, top_ports, velocity_curve
FROM resolved""", "v_packets", "v_floods", "v_hits", extra=_REPORT)
oracle("incident_confidence", f"""SELECT incident_id, duration, peak_pps, threshold, src_ip_count, greatest(tcp_pct, udp_pct, icmp_pct) AS dominant_pct,
  avg_len AS avg_pkt_length, std_len AS pkt_length_std, boost, spoofed AS spoofing_detected, botnet AS botnet_detected, {_SCORE}
FROM resolved""", "v_packets", "v_floods", "v_hits", extra=_REPORT)

oracle("stream_measures", """SELECT dst_ip, tick, packets, octets, flow_count, tcp_packets, udp_packets, icmp_packets, other_packets,
  syn, ack, rst, fin, psh, urg, pps, bps, tcp_pct, udp_pct, icmp_pct, fragment_pct, avg_pkt_size
FROM v_dst_pct WHERE tick < (SELECT max(tick) - 10 FROM v_flows)""", "v_flows", "v_dst_pct")

ORACLES["stream_detect_dst"] = ORACLES["detect_dst"]
ORACLES["stream_detect_node"] = ORACLES["detect_node"]
ORACLES["stream_detect_http"] = ORACLES["detect_http"]
ORACLES["stream_incidents"] = ORACLES["write_incidents"]
# a resolve without a row of that destination and second is one that silence made
_HEARD = "heard AS (SELECT * FROM v_dst WHERE NOT (tick BETWEEN 630 AND 655 AND dst_ip IN ('192.0.2.3', '192.0.2.200')))"
oracle("absent_ticks", f"""SELECT key, started_tick, tick, peak_pps, peak_bps FROM ({DST_EVENTS}) e
WHERE event = 'resolve' AND NOT EXISTS (SELECT 1 FROM heard h WHERE h.dst_ip = e.key AND h.tick = e.tick)""", "v_dst", recursive=True,
       extra=f"{_HEARD}, {_DST_WALK.replace('v_dst', 'heard')}")
oracle("stream_l7", f"SELECT {_L7_COLUMNS} FROM v_l7 WHERE tick < (SELECT max(tick) - 10 FROM v_http)", "v_l7", "v_http")

oracle("stream_asof_templates", f"""SELECT 'v5-' || exporter_ip AS exporter_ip, tick, {_DECODED}, packets * rate AS packets, octets * rate AS octets, tcp_flags,
  rate AS sample_rate FROM (SELECT *, greatest(1, cast(right(exporter_ip, 1) AS bigint)) AS rate FROM v_flows)
UNION ALL SELECT 'sflow-' || exporter_ip, tick, src_ip, dst_ip, CASE WHEN protocol IN (6, 17) THEN src_port ELSE 0 END,
  CASE WHEN protocol IN (6, 17) THEN dst_port ELSE 0 END, protocol, packets, octets, CASE WHEN protocol = 6 THEN tcp_flags ELSE 0 END, packets FROM v_flows
UNION ALL SELECT 'templated-' || exporter_ip, tick, {_DECODED}, packets * factor, octets * factor, tcp_flags, factor FROM (
  SELECT k.*, coalesce(r.rate, 1) AS factor FROM known k ASOF LEFT JOIN (SELECT exporter_ip, seq, flow_id % 3 + 1 AS rate FROM v_datagrams
  WHERE flow_id % 11 = 0) r ON k.exporter_ip = r.exporter_ip AND k.seq >= r.seq)""", "v_datagrams", extra=_KNOWN)

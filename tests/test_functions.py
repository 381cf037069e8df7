import ipaddress
import random

from pyspark.sql import functions as F

from trafficlens.functions import http, network
from trafficlens.operators import joins
from trafficlens.sources import access_log, tables

GOOD = ["1.2.3.4", "255.0.255.1", "::", "::1", "2001:db8::1", "fe80::1:2:3", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4",
        "64:ff9b::192.0.2.33", "1::", "2001:DB8:0:0:8:800:200C:417A"]
BAD = ["", "x", "1.2.3", "256.1.1.1", "1:2:3", "1::2::3", ":::", "12345::", "1:2:3:4:5:6:7:8:9", "g::1", "1.2.3.4.5"]


def test_addresses(spark):
    rows = spark.createDataFrame([(a,) for a in GOOD + BAD], "a string")
    for row in rows.select("a", network.address_hex(F.col("a")).alias("h")).collect():
        expected = ipaddress.ip_address(row.a).packed.hex().upper() if row.a in GOOD else None
        assert row.h == expected, row.a


def test_cidr_join_against_brute_force(spark):
    nets = ["10.0.0.0/8", "10.1.0.0/15", "192.0.2.16/30", "2001:db8::/33", "2001:db8:8000::/33", "0.0.0.0/0", "::1/128"]
    ips = ["10.1.2.3", "10.3.0.1", "192.0.2.19", "192.0.2.20", "2001:db8::5", "2001:db8:8000::5", "::1", "bad"]
    networks = joins.parse_networks(spark.createDataFrame([(n,) for n in [*nets, "junk", "10.0.0.0/99"]], "entry string"))
    assert networks.count() == len(nets)
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    found = {(r.ip, r.entry) for r in joins.cidr_join(df, "ip", networks).select("ip", "entry").collect()}
    expected = {(i, n) for i in ips if i != "bad" for n in nets if ipaddress.ip_address(i) in ipaddress.ip_network(n, strict=False)}
    assert found == expected
    kept = {r.ip for r in joins.cidr_join(df, "ip", networks, "left_anti").collect()}
    assert kept == {"bad"}


def test_no_subnets_keep_everything(spark):
    df = spark.createDataFrame([("1.1.1.1",), ("2.2.2.2",)], "dst_ip string")
    none = spark.createDataFrame([], "network string, prefix_len bigint")
    one = spark.createDataFrame([("1.0.0.0", 8)], "network string, prefix_len bigint")
    assert joins.subnet_filter(df, "dst_ip", none).count() == 2
    assert joins.subnet_filter(df, "dst_ip", one).count() == 1


def test_http_versions_and_ports(spark):
    cases = {"HTTP/1.1": "1.1", "HTTP/1.0": "1.0", "HTTP/2.0": "2", "http/2": "2", "h2": "2", "h2c": "2", "h3": "3",
             "HTTP/3": "3", "": "", "spdy": ""}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "raw string, want string")
    assert rows.filter(http.http_version(F.col("raw")) != F.col("want")).count() == 0
    config = spark.createDataFrame([("tcp", "80, 443,x,90-88"), ("udp", "8000-8002")], "protocol string, port_value string")
    assert sorted(r.port for r in tables.expand_ports(config).collect()) == [80, 443, 8000, 8001, 8002]


def test_access_log_edges(spark):
    lines = [
        '1.1.1.1 - - [x] "GET /a?b=1 HTTP/1.1" 200 - "-" "curl/8"',
        '1.1.1.1 - - [x] "GET /a HTTP/1.1" 404 10',
        "garbage",
        '{"client_ip": "2.2.2.2", "statusCode": "503", "url": "/q?x=1", "duration": 0.25, "httpVersion": "h2"}',
        '{"remote_addr": "", "host": "3.3.3.3", "status": 200, "request_time": 150}',
        '{"remote_addr": "2.2.2.2", "status": 0}',
        '{"status": 200}', "{broken",
    ]
    rows = access_log.parse_access_lines(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    got = [(r.ip, r.path, r.status, r.size, r.ua, r.resp_time_ms, r.http_version) for r in rows]
    assert got == [("1.1.1.1", "/a", 200, 0, "curl/8", None, "1.1"), ("1.1.1.1", "/a", 404, 10, "", None, "1.1"),
                   ("2.2.2.2", "/q?x=1", 503, 0, "", 250.0, "2"), ("3.3.3.3", "/", 200, 0, "", 150.0, "")]


def test_asof_join_against_brute_force(spark):
    import random

    rng = random.Random(5)
    left = [(k, t * 10 + i, t, i) for k in "ab" for t in range(0, 400, 7) for i in range(2)]
    right = sorted({(k, t * 10 + rng.randrange(3), t, rng.randrange(3)) for k in "ab" for t in rng.sample(range(400), 25)})
    right = list({(k, s): (k, s, t, v) for k, s, t, v in right}.values())
    ldf = spark.createDataFrame(left, "k string, seq bigint, tick bigint, i bigint")
    rdf = spark.createDataFrame(right, "k string, seq bigint, tick bigint, v bigint")
    got = {(r.k, r.seq, r.i): r.v for r in joins.asof_join(ldf, rdf, ["k"], ["seq"], "v", slot=50).collect()}
    for k, seq, _, i in left:
        before = [(s, v) for rk, s, _, v in right if rk == k and s <= seq]
        assert got[k, seq, i] == (max(before)[1] if before else None)


def test_asof_join_forgets_after_silence(spark):
    ldf = spark.createDataFrame([("a", s, s) for s in (10, 100, 190, 500)], "k string, seq bigint, tick bigint")
    rdf = spark.createDataFrame([("a", 5, 5, 1)], "k string, seq bigint, tick bigint, v bigint")
    got = {r.seq: r.v for r in joins.asof_join(ldf, rdf, ["k"], ["seq"], "v", slot=50, idle_limit=150).collect()}
    assert got == {10: 1, 100: 1, 190: 1, 500: None}


def test_pattern_order_and_long_list(spark):
    patterns = spark.createDataFrame([(2, "long pattern here", "Long", "f"), (1, "pat", "Short", "f"), (3, "zz", "Z", "g"),
                                      (4, "a", "A", "h")], "ord bigint, pattern string, attack_name string, attack_family string")
    payloads = spark.createDataFrame([(1, "xx long pattern here"), (2, "zz"), (3, "qqq"), (4, ""), (5, "bazz"), (6, "zz")],
                                     "id bigint, payload string")
    inline = {r.id: r.ioc_hit for r in joins.ioc_join(payloads, patterns, inline=True).collect()}
    joined = {r.id: r.ioc_hit for r in joins.ioc_join(payloads, patterns).collect()}
    assert inline == joined == {1: "Short:f", 2: "Z:g", 3: None, 4: None, 5: "Z:g", 6: "Z:g"}


def test_long_list_over_many_texts(spark):
    """Grams of all widths at all places: text ends, other bytes than ASCII, bytes above 127 in front, empty and null texts, copies."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abé\x00 ") for _ in range(rng.randrange(30))) for _ in range(300)] + ["", None, "ab" * 40, "ab" * 40]
    listed = sorted({t[i:i + n] for t in texts[:60] for n, i in [(rng.randrange(1, 14), rng.randrange(20))] if t[i:i + n]} - set("abé\x00 "))
    listed += ["é" * 4, "never there", "abababababababab"]
    patterns = spark.createDataFrame([(k % 7, p, f"p{k}", "f") for k, p in enumerate(listed)],
                                     "ord bigint, pattern string, attack_name string, attack_family string")
    payloads = spark.createDataFrame(list(enumerate(texts)), "id bigint, payload string")
    got = {r.id: r.ioc_hit for r in joins.ioc_join(payloads, patterns).collect()}
    order = sorted((k % 7, f"p{k}:f", p) for k, p in enumerate(listed))
    assert got == {n: next((hit for _, hit, p in order if t and p in t), None) for n, t in enumerate(texts)}
    assert len(set(got.values())) > 10


def test_long_list_has_no_expression_for_each_byte(spark):
    """Payloads are searched by array operations, whatever their length: 45 MB here."""
    patterns = spark.createDataFrame([(1, "needle in it", "N", "f")], "ord bigint, pattern string, attack_name string, attack_family string")
    payloads = spark.range(40).selectExpr("id", "concat(repeat(concat('some hay ', id), 100000), if(id % 10 = 3, 'needle in it', '')) AS payload")
    found = joins.ioc_join(payloads, patterns)
    assert "sequence(" not in found._jdf.queryExecution().toString()
    assert sorted(r.id for r in found.filter("ioc_hit IS NOT NULL").collect()) == [3, 13, 23, 33]


def test_signature_searches_find_what_the_signatures_find(spark):
    """Random strings of the signatures' own pieces, spaces of all kinds, both cases and letters that fold to ASCII ones elsewhere."""
    import re

    from pyspark.sql import functions as F

    rng = random.Random(7)
    source = " ".join(http.THREAT_PATTERNS.values())
    pieces = sorted(set(re.findall(r"[a-zA-Z0-9]+", source)) | set("'.$<(/;:={}%_-\\ \t\n\r\x0b\u2028\u00a0KſİıÉ5a")) + ["..", "../", "()", "${", "://", "or ", "select ", " from "] * 3
    whole = ["union  select", "x or 5", "'OR\n'", "select\ta from b", "select a\nfrom b", "insert into", "drop\x0btable", "update  a set", "; alter x",
             "<SCRIPT", "javascript:", "onload =", "EVAL (", "document.Cookie", "alert(", "../", "..\\", "%2E%2e/", "phar://", "/etc/shadow", "/proc/self/",
             "/wp-json/wp/", "/XMLRPC.php", "/.git/", "/.well-known/security.txt", "() {", "${jndi:", "/api/v12/keys", "/vendor/phpunit", "update \u2028x set", "unIon ſelect"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))) for _ in range(6000)] + whole + [a + rng.choice(pieces) + b for a in whole for b in whole] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, path string")
    plain = F.filter(F.array(*[F.when(F.rlike("path", F.lit("(?i)" + p)), F.lit(n)) for n, p in http.THREAT_PATTERNS.items()]), lambda n: n.isNotNull())
    found = rows.select("path", http.threat_flags(F.col("path")).alias("got"),
                        F.when(http.worth_matching(F.col("path")), plain).otherwise(F.array().cast("array<string>")).alias("want")).collect()
    assert [(r.path, r.got, r.want) for r in found if r.got != r.want] == []
    assert {name for r in found for name in r.got} == set(http.THREAT_PATTERNS)
    assert sum(len(r.got) for r in found) > 1500


def test_asof_in_order_pairs_nothing(spark):
    """Many values in one slot: the latest earlier one by keys, also over slots without any, and no join of the two sides."""
    rng = random.Random(5)
    left = [(rng.choice(("a", "b", "c", None)), rng.randrange(0, 3000), i) for i in range(3000)]
    right = [(k, t, rng.choice((None, 1, 2, 3))) for k in "ab" for t in sorted(rng.sample(range(120), 60)) + sorted(rng.sample(range(2000, 2300), 150))]
    ldf = spark.createDataFrame(left, "k string, seq bigint, i bigint").withColumn("tick", F.expr("seq div 10"))
    rdf = spark.createDataFrame([*right, (None, 0, 9)], "k string, seq bigint, v bigint").withColumn("tick", F.expr("seq div 10"))
    want = {}
    for k, seq, i in left:
        before = [v for rk, rseq, v in right if rk == k and rseq <= seq]
        want[i] = (k, seq, before[-1] if before else None)
    for heard in (None, ldf.select("k", "tick").union(spark.sql("SELECT 'd', 7L")).distinct()):
        got = joins.asof_in_order(ldf, rdf, ["k"], ["seq"], "v", slot=10, heard=heard)
        assert got.columns == ["k", "seq", "i", "tick", "v"]
        assert {r.i: (r.k, r.seq, r.v) for r in got.collect()} == want
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()

import ipaddress
import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from pageloom.functions.ips import BLOCKED_NETWORKS, ip_blocked
from pageloom.functions.urls import domain, join_url, valid_href
from pageloom.operators.nets import with_blocked, with_nets
from pageloom.operators.safety import check_urls

DNS = [("example.com", "93.184.216.34"), ("ferry.example", "151.101.0.9"), ("tide.example", "209.216.230.2"), ("foo", "93.184.216.35"),
       ("mixed.com", "93.184.216.34"), ("mixed.com", "10.1.1.1"), ("inner.com", "192.168.1.5")]


def verdicts(spark, urls, strict=False):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    dns = spark.createDataFrame(DNS, "host string, ip string")
    return [(r.is_safe, r.reason) for r in check_urls(df, dns, strict=strict).orderBy("i").collect()]


def test_public_urls_are_safe(spark):
    urls = ["http://ferry.example/north?day=1", "HTTP://u:p@Example.com:8080/x", "https://tide.example:444", "https://[2001:db8::5]:8443/a"]
    assert verdicts(spark, urls) == [(True, "URL is safe.")] * 4


def test_refused_urls(spark):
    urls = [
        *(f"https://{ipaddress.ip_network(n)[-1]}/" for n in BLOCKED_NETWORKS if ":" not in n),
        "ws://ferry.example", "data:text/plain,x", "https://LOCALHOST:81/x", "http://[foo]/", "http://a]b[/", "http://x[::2]/", "http://[v1x]/", "http://[1.2.3.4]/",
        "http://127.1/", "http://2130706433/", "http://0x7f000001/", "http://017700000001/", "http://[::1]:9/",
        "http://[fc00::1]/", "http://[fe80::1]/", "http://", "http:///p", "", None, "http://gone.com/", "http://[::1",
        "http://mixed.com", "http://inner.com", "http://256.1.1.1/",
    ]
    got = verdicts(spark, urls)
    assert not any(safe for safe, _ in got)
    reasons = dict(zip(urls, (reason for _, reason in got)))
    assert reasons["ws://ferry.example"] == "Disallowed scheme 'ws'. Only http and https are allowed."
    assert reasons["http://127.1/"] == "Hostname '127.1' resolved to blocked/private IP '127.0.0.1'."
    assert reasons["http://mixed.com"] == "Hostname 'mixed.com' resolved to blocked/private IP '10.1.1.1'."
    assert reasons["http://gone.com/"] == "Could not resolve hostname 'gone.com'."
    assert reasons["http:///p"] == "URL does not contain a valid hostname."


def test_mapped_ipv6_is_refused_only_when_strict(spark):
    url = ["http://[::ffff:127.0.0.1]/"]
    assert verdicts(spark, url)[0][0] and not verdicts(spark, url, strict=True)[0][0]


IPS = [
    "1.2.3.4", "10.0.0.1", "100.63.255.255", "100.64.0.0", "172.15.255.255", "172.16.0.0", "172.32.0.0", "192.0.0.255",
    "192.0.1.0", "192.0.2.9", "198.17.255.255", "198.19.0.1", "198.51.100.1", "203.0.113.255", "223.255.255.255", "224.0.0.1",
    "255.255.255.255", "01.2.3.4", "1.2.3", "256.1.1.1", "::1", "::", "::2", "fc00::1", "fdff::", "fe00::", "fe80::1%eth0", "febf::", "fec0::",
    "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2::3", "::ffff:127.0.0.1", "::ffff:127.0.0.01", "1:2", ":1", "1:", ":::",
    "1:2:3:4:5:6:7:8:9", "12345::", "::1.2.3.4", "", "2001:db8::g", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "nonsense", "fe80::1%",
]


def test_ip_blocked_agrees_with_the_standard_library(spark):
    nets = [ipaddress.ip_network(n) for n in BLOCKED_NETWORKS]

    def expected(ip):
        try:
            return any(ipaddress.ip_address(ip) in n for n in nets)
        except ValueError:
            return True

    df = spark.createDataFrame([(ip,) for ip in IPS], "ip string").select("ip", ip_blocked("ip").alias("b"))
    assert {r.ip: r.b for r in df.collect()} == {ip: expected(ip) for ip in IPS}


@pytest.mark.parametrize("url,expected", [
    ("https://news.ycombinator.com/item?id=123", "news.ycombinator.com"), ("http://example.com:8080/path", "example.com:8080"),
    ("HTTP://u:p@E.com/", "u:p@e.com"), ("//a_b.com?x", "a_b.com"), ("mailto:x@y", ""), ("https://a b.com/x", "a b.com"),
])
def test_domain(spark, url, expected):
    assert spark.range(1).select(domain(F.lit(url))).first()[0] == expected


JOINS = [
    ("https://example.com/store/catalog/page.html", "/item/a"), ("https://example.com/a/b/index.html", "../details.html"),
    ("https://example.com/a/b/index.html", "../../img.png"), ("https://example.com/items", "?p=2"), ("https://e.com/a/", "//c.org/x"),
    ("https://e.com/a", "mailto:x@y"), ("https://e.com/a/b", "../../../x"), ("https://e.com/a?q=1", ""), ("https://e.com", "b"),
    ("https://e.com/a/b/", "."), ("https://e.com/a/b;p/c;d?e#f", "g;h/../i;j?k#l"), ("http://e.com/a//b", "c//d/./e/.."),
    ("https://e.com/a", "http:x"), ("https://e.com/a", "https:x"), ("https://e.com/a;p?q", "#f"), ("https://e.com/a", " /b"),
    ("https://e.com/a/b", "..;x"), ("https://e.com/a/b", "/../x"), ("HTTP://E.com/a", "/x/y"), ("https://e.com/a", "./b\n"),
    ("https://e.com", "//"), ("https://e.com/x", "///y"), ("https://e.com/a", "/b c"), ("https://e.com/a", "b?"), ("http://e.com", "?a"),
    ("https://e.com/a", "/a/./b/../c"), ("https://e.com/a", "/.."), ("https://e.com/a", "/et."), ("https://e.com/a#x", "#"),
]


def test_join_agrees_with_the_standard_library(spark):
    df = spark.createDataFrame(JOINS, "base string, ref string").select("base", "ref", join_url("base", "ref").alias("j"))
    assert {(r.base, r.ref): r.j for r in df.collect()} == {pair: urljoin(*pair) for pair in JOINS}


def test_valid_href(spark):
    cases = {"": False, "#x": False, " JavaScript:void(0)": False, "MAILTO:a": False, "/x": True, "   ": True, "javascripts": True}
    df = spark.createDataFrame([(h,) for h in cases], "h string").select("h", valid_href("h").alias("v"))
    assert {r.h: r.v for r in df.collect()} == cases
    assert spark.range(1).select(valid_href(F.lit(None).cast("string"))).first()[0] is False


def test_nets_by_brute_force(spark):
    rng = random.Random(6)
    v4 = lambda: str(ipaddress.IPv4Address(rng.choice([10 << 24, 192 << 24]) + rng.randrange(1 << rng.choice([6, 14, 24]))))
    v6 = lambda: str(ipaddress.IPv6Address((0xFD << 120) + (rng.randrange(1 << 10) << rng.choice([0, 40, 100]))))
    nets = [f"{v4()}/{rng.randint(4, 32)}" for _ in range(300)] + [f"{v6()}/{rng.randint(4, 128)}" for _ in range(200)] + [v4(), v6()]
    bad = ["", None, "x/8", "10.0.0.0/33", "10.0.0.0/-1", "10.0.0.0/8/9", "fd00::/129", "10.0.0/8", "1.2.3.4/"]
    rows = [(n, rng.choice(["allow", "block", None])) for n in nets] + [(n, "block") for n in bad] + [(nets[0], "allow")] * 3
    ips = [v4() for _ in range(300)] + [v6() for _ in range(200)] + ["8.8.8.8", "::1", "no", "", None, "10.0.0.256", "10.0.0.1", "10.0.0.1"]
    got = with_nets(
        spark.createDataFrame(list(enumerate(ips)), "id int, ip string").repartition(4).withColumn("key", F.lit(1)),
        spark.createDataFrame(rows, "net string, action string").repartition(3),
    ).collect()
    known = {}
    for n, action in rows:
        if n not in bad:
            known.setdefault(ipaddress.ip_network(n, strict=False), []).append((action or "block", n))
    assert len(got) == len(ips)
    for r in got:
        try:
            ip = ipaddress.ip_address(r.ip)
        except ValueError:
            assert (r.net, r.action) == (None, None), r
            continue
        hits = [n for n in known if n.version == ip.version and ip in n]
        if not hits:
            assert (r.net, r.action) == (None, None), r
        else:
            action, text_ = min(known[max(hits, key=lambda n: n.prefixlen)], key=lambda x: (x[0] != "allow", x[1]))
            assert (r.net, r.action) == (text_, action), r


def test_blocked_by_a_table_of_nets(spark):
    nets = spark.createDataFrame([("10.0.0.0/8", None), ("10.1.0.0/16", "allow"), ("::1", "block")], "net string, action string")
    ips = ["10.0.0.1", "10.1.2.3", "127.0.0.1", "::1", "bad", "::ffff:10.0.0.1"]
    rows = spark.createDataFrame([(i,) for i in ips], "ip string")
    assert {r.ip: r.blocked for r in with_blocked(rows, nets).collect()} == dict(zip(ips, [True, False, False, True, True, False]))
    assert {r.ip: r.blocked for r in with_blocked(rows, nets, mapped=True).collect()}["::ffff:10.0.0.1"]
    none = spark.createDataFrame([], "net string")
    assert {r.ip for r in with_blocked(rows, none).where("blocked").collect()} == {"bad"}
    urls = spark.createDataFrame([("http://10.0.0.1/",), ("http://10.1.0.1/",), ("http://167772161/",), ("http://a.com/",), ("http://b.com",), ("http://[::1]/",)], "url string")
    dns = spark.createDataFrame([("a.com", "10.9.9.9"), ("a.com", "8.8.8.8"), ("B.com", "127.0.0.1")], "host string, ip string")
    got = {r.url: r.is_safe for r in check_urls(urls, dns, nets=nets).collect()}
    assert got == {"http://10.0.0.1/": False, "http://10.1.0.1/": True, "http://167772161/": False, "http://a.com/": False,
                   "http://b.com": True, "http://[::1]/": False}


def test_a_million_nets_need_no_broadcast_and_no_range_join(spark):
    nets = spark.range(1_000_000).select(F.concat(F.lit("11."), F.expr("id div 65536"), F.lit("."), F.expr("id div 256 % 256"), F.lit("."), F.expr("id % 256"), F.lit("/32")).alias("net"))
    ips = spark.range(2000).select(F.concat(F.lit("11.0."), F.expr("id % 256"), F.lit("."), F.expr("id % 251")).alias("ip"))
    found = with_nets(ips, nets)
    assert found.where("net = concat(ip, '/32')").count() == 2000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and not any("Cross" in j or "<=" in j or ">=" in j or "ResolvedHint" in j for j in joins)

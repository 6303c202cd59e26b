"""Queries on URLs, addresses, fetch logs, robots, schedules and retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pageloom.functions.ips import ip_blocked
from pageloom.functions.urls import domain, join_url, valid_href
from pageloom.operators.fetches import (
    backoff_total, fetch_outcome, fetch_view, is_transient, resolve_redirects, resolve_retries,
)
from pageloom.operators.nets import address_bits, with_nets
from pageloom.operators.robots import effective_delay, robots_policy, robots_rules, with_robots
from pageloom.operators.safety import check_urls
from pageloom.operators.schedule import send_schedule
from pageloom.plans.catalog import Catalog, table
from pageloom.session import scratch_path
from pageloom.sources.pages import read_pages, stream_pages
from pageloom.streaming.keyed import send_schedule_in_order, send_schedule_stream
from pageloom.streaming.run import run_available, stream_table

web = Catalog()


# sources

@web.query("page_scan", "SELECT page_id, url, html FROM pages")
def page_scan(spark: SparkSession, folder: str) -> DataFrame:
    return read_pages(spark, f"{folder}/pages.parquet")


@web.query("page_scan_stream", "SELECT page_id, url, html FROM pages")
def page_scan_stream(spark: SparkSession, folder: str) -> DataFrame:
    return run_available(stream_pages(spark, f"{folder}/pages.parquet*"), "page-scan")


# URLs

@web.query("url_domain", r"""
SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS domain FROM pages""")
def url_domain(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", domain("url").alias("domain"))


def corpus_dns(pages: DataFrame) -> DataFrame:
    """Addresses of the hosts of the corpus: some private, some with two, some missing."""
    hosts = pages.select(domain("url").alias("host")).distinct().withColumn("n", F.length("host"))
    first = F.when(F.col("n") % 5 == 0, F.concat(F.lit("10.0.0."), "n")).otherwise(F.concat(F.lit("93.184.216."), "n"))
    second = F.when(F.col("n") % 3 == 0, F.concat(F.lit("192.168.1."), "n"))
    ips = F.filter(F.array(first, second), lambda ip: ip.isNotNull())
    return hosts.where("n % 7 <> 0").select("host", F.explode(ips).alias("ip"))


def _url_variant() -> str:
    """The same expression in Spark and DuckDB: page URLs and shapes that must be refused."""
    return """CASE page_id % 14
      WHEN 4 THEN concat('ftp://e.com/', page_id) WHEN 5 THEN concat('http://localhost:80/', page_id)
      WHEN 6 THEN concat('http://127.0.0.1/', page_id) WHEN 7 THEN concat('http://10.', page_id % 256, '.0.1/')
      WHEN 8 THEN concat('http:///p', page_id) WHEN 9 THEN '' WHEN 10 THEN concat('http://[::1]/', page_id)
      WHEN 11 THEN concat('http://2130706433/', page_id) WHEN 12 THEN concat('https://missing', page_id, '.example/')
      WHEN 13 THEN replace(url, '://', '://user:pw@') ELSE url END"""


@web.query("url_safety", rf"""
WITH v AS (SELECT page_id, {_url_variant()} AS u, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS host FROM pages),
h AS (SELECT page_id, u, host, length(host) AS n FROM v),
r AS (SELECT page_id, u AS url, CASE page_id % 14
    WHEN 4 THEN 'Disallowed scheme ''ftp''. Only http and https are allowed.'
    WHEN 5 THEN 'Access to localhost hostnames is forbidden.'
    WHEN 6 THEN 'Hostname ''127.0.0.1'' resolved to blocked/private IP ''127.0.0.1''.'
    WHEN 7 THEN format('Hostname ''10.{{}}.0.1'' resolved to blocked/private IP ''10.{{}}.0.1''.', page_id % 256, page_id % 256)
    WHEN 8 THEN 'URL does not contain a valid hostname.'
    WHEN 9 THEN 'URL must be a non-empty string.'
    WHEN 10 THEN 'Hostname ''::1'' resolved to blocked/private IP ''::1''.'
    WHEN 11 THEN 'Hostname ''2130706433'' resolved to blocked/private IP ''127.0.0.1''.'
    WHEN 12 THEN format('Could not resolve hostname ''missing{{}}.example''.', page_id)
    ELSE CASE WHEN n % 7 = 0 THEN format('Could not resolve hostname ''{{}}''.', host)
      WHEN n % 5 = 0 THEN format('Hostname ''{{}}'' resolved to blocked/private IP ''10.0.0.{{}}''.', host, n)
      WHEN n % 3 = 0 THEN format('Hostname ''{{}}'' resolved to blocked/private IP ''192.168.1.{{}}''.', host, n)
      ELSE 'URL is safe.' END END AS reason FROM h)
SELECT page_id, url, reason, reason = 'URL is safe.' AS is_safe FROM r""")
def url_safety(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    urls = pages.select("page_id", F.expr(_url_variant()).alias("url"))
    return check_urls(urls, corpus_dns(pages)).select("page_id", "url", "reason", "is_safe")


_IP = """CASE WHEN event_id % 5 < 3 THEN concat(10 + event_id % 240, '.', event_id % 256, '.', event_id * 7 % 256, '.', event_id * 13 % 256)
      WHEN event_id % 5 = 3 THEN concat(CASE event_id % 7 WHEN 0 THEN 'fc00' WHEN 1 THEN 'fdab' WHEN 2 THEN 'FE80' WHEN 3 THEN 'febf'
        WHEN 4 THEN 'fec0' WHEN 5 THEN '2001:db8' ELSE '64:ff9b' END, '::', event_id % 9000)
      ELSE concat('1.2.', event_id) END"""


@web.query("ip_blocked", rf"""
WITH e AS (SELECT event_id, {_IP} AS ip, 10 + event_id % 240 AS a, event_id % 256 AS b, event_id * 7 % 256 AS c FROM events)
SELECT event_id, ip, CASE WHEN event_id % 5 < 3 THEN
    a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254)
    OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 198 AND b IN (18, 19))
    OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 192 AND b = 88 AND c = 99)
    OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)
  WHEN event_id % 5 = 3 THEN event_id % 7 < 4 ELSE true END AS blocked FROM e""")
def ip_blocked_events(spark: SparkSession, folder: str) -> DataFrame:
    ips = table(spark, folder, "events").select("event_id", F.expr(_IP).alias("ip"))
    return ips.withColumn("blocked", ip_blocked("ip"))


# Networks of many lengths that lie in one another, some allowed, and IPv6 ones; one row in nine is no network.
_NET = """CASE event_id % 9 WHEN 0 THEN concat('10.', event_id, '/33') WHEN 1 THEN concat('fd00::', event_id % 97, '/', 120 + event_id % 9)
      WHEN 2 THEN 'fd00::/8' WHEN 3 THEN concat('64:ff9b::', event_id % 97)
      ELSE concat(10 + event_id % 240, '.', event_id % 256, '.', event_id * 7 % 256, '.0/', event_id % 25) END"""
_NET_ACTION = "CASE WHEN event_id % 4 = 1 THEN 'allow' WHEN event_id % 4 = 2 THEN 'block' END"
_LOOKED_UP = """CASE WHEN event_id % 5 < 3 THEN concat(10 + event_id % 240, '.', event_id % 256, '.', event_id * 7 % 256, '.', event_id * 13 % 256)
      WHEN event_id % 5 = 3 THEN concat(CASE event_id % 3 WHEN 0 THEN 'FD00::' WHEN 1 THEN '64:ff9b:0::' ELSE 'fe80::1:' END, event_id % 97)
      ELSE concat('1.2.', event_id) END"""

# addresses as a version and a number: the IPv6 ones of these rows have 16 high bits and 16 low ones that differ
_NETS_SQL = f"""n AS (SELECT {_NET} AS net, {_NET_ACTION} AS action, event_id, event_id % 9 AS k FROM events),
nv AS (SELECT net, coalesce(action, 'block') AS action, CASE WHEN k IN (1, 2, 3) THEN 6 ELSE 4 END AS v,
    CASE k WHEN 1 THEN 120 + event_id % 9 WHEN 2 THEN 8 WHEN 3 THEN 128 ELSE event_id % 25 END AS len,
    CASE k WHEN 1 THEN ('0xfd00' || '0000' || '0000' || lpad((event_id % 97)::VARCHAR, 4, '0'))::UBIGINT WHEN 2 THEN ('0xfd00' || '000000000000')::UBIGINT
      WHEN 3 THEN ('0x0064' || 'ff9b' || '0000' || lpad((event_id % 97)::VARCHAR, 4, '0'))::UBIGINT
      ELSE (((10 + event_id % 240) * 256 + event_id % 256) * 256 + event_id * 7 % 256)::UBIGINT * 256 END AS num
  FROM n WHERE k <> 0),
nk AS (SELECT v, len, CASE WHEN v = 4 THEN num >> (32 - len)::UBIGINT WHEN len < 16 THEN num >> (64 - len)::UBIGINT ELSE num >> (128 - len)::UBIGINT END AS p, net, action FROM nv),
nets AS (SELECT v, len, p, arg_min(net, (action <> 'allow', net)) AS net, arg_min(action, (action <> 'allow', net)) AS action FROM nk GROUP BY ALL),
a AS (SELECT event_id, {_LOOKED_UP} AS ip, CASE WHEN event_id % 5 < 3 THEN 4 WHEN event_id % 5 = 3 THEN 6 END AS v,
    CASE WHEN event_id % 5 < 3 THEN (((10 + event_id % 240) * 256 + event_id % 256) * 256 + event_id * 7 % 256)::UBIGINT * 256 + event_id * 13 % 256
      WHEN event_id % 5 = 3 THEN CASE event_id % 3 WHEN 0 THEN ('0xfd00' || '0000' || '0000' || lpad((event_id % 97)::VARCHAR, 4, '0'))::UBIGINT
        WHEN 1 THEN ('0x0064' || 'ff9b' || '0000' || lpad((event_id % 97)::VARCHAR, 4, '0'))::UBIGINT
        ELSE ('0xfe80' || '0000' || '0001' || lpad((event_id % 97)::VARCHAR, 4, '0'))::UBIGINT END END AS num FROM events),
lens AS (SELECT DISTINCT v, len FROM nets),
tried AS (SELECT event_id, v, len, CASE WHEN v = 4 THEN num >> (32 - len)::UBIGINT WHEN len < 16 THEN num >> (64 - len)::UBIGINT ELSE num >> (128 - len)::UBIGINT END AS p FROM a JOIN lens USING (v)),
hit AS (SELECT event_id, arg_max(net, len) AS net, arg_max(action, len) AS action FROM tried JOIN nets USING (v, len, p) GROUP BY event_id)"""


def corpus_nets(events: DataFrame) -> DataFrame:
    return events.select(F.expr(_NET).alias("net"), F.expr(_NET_ACTION).alias("action"))


@web.query("ip_nets", f"""
WITH {_NETS_SQL}
SELECT event_id, ip, net, action, v IS NULL OR coalesce(action = 'block', false) AS blocked FROM a LEFT JOIN hit USING (event_id)""")
def ip_nets(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    addresses = events.select("event_id", F.expr(_LOOKED_UP).alias("ip"))
    known = address_bits("ip").isNotNull()
    return with_nets(addresses, corpus_nets(events)).withColumn("blocked", ~known | F.coalesce(F.col("action") == "block", F.lit(False)))


@web.query("url_safety_nets", f"""
WITH {_NETS_SQL}
SELECT event_id, CASE WHEN coalesce(action = 'block', false) THEN format('Hostname ''{{}}'' resolved to blocked/private IP ''{{}}''.', ip, ip)
    ELSE 'URL is safe.' END AS reason, NOT coalesce(action = 'block', false) AS is_safe
FROM a LEFT JOIN hit USING (event_id) WHERE v = 4""")
def url_safety_nets(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    urls = events.where("event_id % 5 < 3").select("event_id", F.expr(f"concat('http://', {_LOOKED_UP}, '/x')").alias("url"))
    dns = spark.createDataFrame([], "host string, ip string")
    return check_urls(urls, dns, nets=corpus_nets(events)).drop("url")


_REF = """CASE page_id % 10 WHEN 0 THEN '../x.html' WHEN 1 THEN '?p=2' WHEN 2 THEN '//c.org/x' WHEN 3 THEN 'mailto:x@y'
      WHEN 4 THEN './y' WHEN 5 THEN '' WHEN 6 THEN '#f' WHEN 7 THEN '/z/../w' WHEN 8 THEN '../../../../r' ELSE 'q/./s?k=1' END"""


@web.query("join_variants", rf"""
WITH p AS (SELECT page_id, url, {_REF} AS ref, regexp_extract(url, '^(https?)', 1) AS scheme,
    regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(url, '(\?[^#]*)', 1) AS query FROM pages),
d AS (SELECT *, regexp_replace(path, '[^/]*$', '') AS folder FROM p)
SELECT page_id, ref, CASE page_id % 10
    WHEN 0 THEN origin || regexp_replace(folder, '[^/]+/$', '') || 'x.html'
    WHEN 1 THEN origin || path || '?p=2' WHEN 2 THEN scheme || '://c.org/x' WHEN 3 THEN 'mailto:x@y'
    WHEN 4 THEN origin || folder || 'y' WHEN 5 THEN url WHEN 6 THEN origin || path || query || '#f'
    WHEN 7 THEN origin || '/w' WHEN 8 THEN origin || '/r' ELSE origin || folder || 'q/s?k=1' END AS joined FROM d""")
def join_variants(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", F.expr(_REF).alias("ref"))
    return pages.select("page_id", "ref", join_url("url", "ref").alias("joined"))


_HREF = """CASE event_id % 9 WHEN 0 THEN '' WHEN 1 THEN '#top' WHEN 2 THEN ' JavaScript:void(0)' WHEN 3 THEN 'MAILTO:a@b.c'
      WHEN 4 THEN concat('/p/', event_id) WHEN 5 THEN '   ' WHEN 6 THEN NULL WHEN 7 THEN concat('next.html#', event_id)
      ELSE concat('javascript', event_id) END"""


@web.query("href_filter", f"SELECT event_id, {_HREF} AS href, event_id % 9 IN (4, 5, 7, 8) AS valid FROM events")
def href_filter(spark: SparkSession, folder: str) -> DataFrame:
    links = table(spark, folder, "events").select("event_id", F.expr(_HREF).alias("href"))
    return links.withColumn("valid", valid_href("href"))


# fetch logs

_LOG = [
    "event_id", "concat('https://h', user_id % 20, '.example.com/', event_id) AS url",
    "CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 200 WHEN 'signup' THEN 404 WHEN 'error' THEN 503 ELSE 429 END AS status",
    "CASE event_type WHEN 'view' THEN 'OK' WHEN 'click' THEN 'OK' WHEN 'signup' THEN 'Not Found' "
    "WHEN 'error' THEN 'Service Unavailable' ELSE 'Too Many Requests' END AS reason",
    "CASE WHEN event_id % 83 = 0 THEN 'URL does not contain a valid hostname.' ELSE 'URL is safe.' END AS safety_reason",
    "event_id % 89 <> 0 AS allowed",
    "CASE WHEN event_id % 97 = 0 THEN 'Read timeout' WHEN event_id % 97 = 1 THEN 'connection reset' END AS request_error",
    "value",
]

_OUTCOME = f"""
WITH l AS (SELECT {", ".join(_LOG)} FROM events),
o AS (SELECT event_id, url, value, CASE WHEN safety_reason <> 'URL is safe.' THEN 400 WHEN NOT allowed THEN 403
    WHEN request_error IS NOT NULL THEN 500 ELSE status END AS status_code,
  CASE WHEN safety_reason <> 'URL is safe.' THEN 'Safety violation: ' || safety_reason
    WHEN NOT allowed THEN 'Access to ''' || url || ''' is restricted by site robots.txt policy.'
    WHEN request_error IS NOT NULL THEN 'Request failed: ' || request_error
    WHEN status <> 200 THEN 'HTTP ' || status || ': ' || reason END AS error_message FROM l)"""


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(*_LOG)


@web.query("fetch_outcome", _OUTCOME + """
SELECT event_id, url, status_code, error_message IS NULL AS success, error_message FROM o""")
def fetch_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return fetch_outcome(_log(spark, folder)).drop("value")


@web.query("fetch_projection", _OUTCOME + """
SELECT url, status_code, error_message IS NULL AS success,
  CASE WHEN error_message IS NULL THEN 'page ' || event_id ELSE '' END AS clean_text, error_message,
  value AS elapsed_seconds FROM o""")
def fetch_projection(spark: SparkSession, folder: str) -> DataFrame:
    text = F.when(F.col("success"), F.concat(F.lit("page "), "event_id")).otherwise("")
    results = fetch_outcome(_log(spark, folder)).withColumns({
        "clean_text": text, "raw_html": F.concat(F.lit("<p>"), text), "elapsed_seconds": F.col("value"),
    })
    return fetch_view(results)


@web.query("transient_flag", _OUTCOME + """
SELECT event_id, status_code IN (429, 500, 503) OR error_message LIKE '%failed%' OR error_message LIKE '%Timeout%' AS transient
FROM (SELECT event_id, status_code, coalesce(error_message, '') AS error_message FROM o)""")
def transient_flag(spark: SparkSession, folder: str) -> DataFrame:
    return fetch_outcome(_log(spark, folder)).select(
        "event_id", is_transient("status_code", "error_message").alias("transient")
    )


RESPONSE = """CASE WHEN p.page_id % 31 = 5 THEN 404 WHEN p.page_id % 7 <> 0 THEN 302 ELSE 200 END"""
LOCATION = """CASE WHEN p.page_id % 29 = 3 THEN NULL WHEN p.page_id % 7 <> 0 THEN n.url END"""


@web.query("redirect_final", rf"""
WITH RECURSIVE r AS (SELECT p.url, {RESPONSE} AS status, {LOCATION} AS target,
    length(regexp_extract(p.url, '^https?://([^/?#]*)', 1)) % 11 <> 0 AS safe,
    lower(regexp_extract(p.url, '^https?://([^/?#]*)', 1)) AS host
  FROM pages p LEFT JOIN pages n ON n.page_id = p.page_id + 1),
c AS (SELECT url AS start_url, url, 0 AS hops FROM r
  UNION ALL SELECT c.start_url, r.target, c.hops + 1 FROM c JOIN r ON r.url = c.url
    WHERE r.safe AND r.status = 302 AND r.target IS NOT NULL AND c.hops < 5),
l AS (SELECT start_url, max(hops) AS hops, arg_max(url, hops) AS url FROM c GROUP BY start_url)
SELECT l.start_url, l.url, l.hops,
  CASE WHEN NOT r.safe THEN 400 WHEN r.status = 302 AND l.hops = 5 THEN 400 ELSE r.status END AS status_code,
  r.safe AND r.status = 200 AS success,
  CASE WHEN NOT r.safe THEN format('Safety violation: Hostname ''{{}}'' resolved to blocked/private IP ''10.0.0.9''.', r.host)
    WHEN r.status = 302 AND l.hops = 5 THEN 'Too many redirects (exceeded limit of 5)'
    WHEN r.status = 302 THEN 'Redirect response missing Location header.'
    WHEN r.status = 404 THEN 'HTTP 404: Not Found' END AS error_message
FROM l JOIN r ON r.url = l.url""")
def redirect_final(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return resolve_redirects(pages.select("url"), *redirect_corpus(pages))


def redirect_corpus(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Responses and addresses: most pages lead to the one with the following id."""
    following = pages.select((F.col("page_id") - 1).alias("page_id"), "url").alias("n")
    responses = pages.alias("p").join(following, F.expr("n.page_id = p.page_id"), "left").select(
        "p.url", "p.html", F.expr(RESPONSE).alias("status"), F.expr(LOCATION).alias("location")
    ).withColumn("reason", F.expr("CASE status WHEN 200 THEN 'OK' WHEN 404 THEN 'Not Found' ELSE 'Found' END"))
    hosts = pages.select(domain("url").alias("host")).distinct()
    dns = hosts.withColumn("ip", F.expr("CASE WHEN length(host) % 11 = 0 THEN '10.0.0.9' ELSE '93.184.216.34' END"))
    return responses, dns


# robots

# Robots files given to the hosts of the corpus, by the length of the host name.
_BODIES = {
    0: "User-agent: *\nDisallow: /fr/\nAllow: /fr/8\nCrawl-delay: 2\n",
    1: "# hello\nUser-agent: samplecrawler\nUser-agent: other\nAllow: /en/1\nDisallow: /en/\nCrawl-delay: 1.5\n"
       "\nUser-agent: *\nDisallow: /\n",
    2: "Disallow: /x\nUser-agent: a\n\nUser-agent: *\nDisallow: /*.pdf$\nDisallow:\nCrawl-delay: 7\n"
       "User-agent: crawler # us\nDisallow: /de/%C3%A9\n",
}
AGENT = "SampleCrawler/1.0"
_STATUS = {0: 200, 1: 200, 2: 200, 3: 404, 4: 403, 6: 503}

_HOSTS_SQL = """h AS (SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS domain FROM pages)"""


def corpus_robots(spark: SparkSession, folder: str) -> DataFrame:
    hosts = table(spark, folder, "pages").select(domain("url").alias("domain")).distinct()
    kind = F.length("domain") % 7
    body, status = F.lit(None).cast("string"), F.lit(None).cast("int")
    for k, code in _STATUS.items():
        status = F.when(kind == k, code).otherwise(status)
        body = F.when(kind == k, F.lit(_BODIES.get(k, "User-agent: *\nDisallow: /"))).otherwise(body)
    return hosts.select("domain", status.alias("status"), body.alias("body"))


@web.query("robots_rules", f"""
WITH {_HOSTS_SQL},
r(kind, group_no, agents, rule_no, path, allow, crawl_delay) AS (VALUES
  (0, 1, '*', 0, '/fr/', false, 2), (0, 1, '*', 1, '/fr/8', true, 2),
  (1, 1, 'samplecrawler,other', 0, '/en/1', true, NULL), (1, 1, 'samplecrawler,other', 1, '/en/', false, NULL),
  (1, 2, '*', 0, '/', false, NULL),
  (2, 2, '*', 0, '/%2A.pdf%24', false, 7), (2, 2, '*', 1, '', true, 7),
  (2, 3, 'crawler', 0, '/de/%C3%A9', false, NULL))
SELECT h.domain, r.group_no::BIGINT AS group_no, r.agents, r.rule_no, r.path, r.allow, r.crawl_delay
FROM h JOIN r ON r.kind = length(h.domain) % 7""")
def robots_rule_rows(spark: SparkSession, folder: str) -> DataFrame:
    return robots_rules(corpus_robots(spark, folder)).withColumn("agents", F.array_join("agents", ","))


@web.query("robots_allowed", r"""
WITH p AS (SELECT page_id, length(regexp_extract(url, '^https?://([^/?#]*)', 1)) % 7 AS k,
    regexp_extract(url, '^https?://[^/?#]*(.*)$', 1) AS path FROM pages)
SELECT page_id, CASE k WHEN 0 THEN NOT starts_with(path, '/fr/')
    WHEN 1 THEN starts_with(path, '/en/1') OR NOT starts_with(path, '/en/')
    WHEN 4 THEN false WHEN 6 THEN false ELSE true END AS allowed,
  CASE k WHEN 0 THEN 2 END AS crawl_delay FROM p""")
def robots_allowed(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return with_robots(pages, robots_policy(corpus_robots(spark, folder), AGENT)).select("page_id", "allowed", "crawl_delay")


# Long robots files out of the parts: 500 rules a file, paths that begin one another, some allowed.
_RULE_SQL = "concat('/', p_partkey * 37 % 1000)"


@web.query("robots_long_files", f"""
WITH r AS (SELECT p_partkey // 500 AS d, p_partkey AS no, {_RULE_SQL} AS path, p_partkey % 3 = 0 AS allow FROM part),
u AS (SELECT event_id, event_id % 8 AS d, concat('/', event_id * 13 % 20000, '/x') AS path FROM events)
SELECT event_id, coalesce(arg_min(allow, no), true) AS allowed FROM u LEFT JOIN r ON r.d = u.d AND starts_with(u.path, r.path) GROUP BY event_id""")
def robots_long_files(spark: SparkSession, folder: str) -> DataFrame:
    rule = F.concat(F.when(F.expr("p_partkey % 3 = 0"), F.lit("Allow: ")).otherwise(F.lit("Disallow: ")), F.expr(_RULE_SQL))
    lines = table(spark, folder, "part").select(F.expr("p_partkey div 500").alias("d"), F.struct("p_partkey", rule.alias("rule")).alias("line"))
    files = lines.groupBy("d").agg(F.array_sort(F.collect_list("line")).alias("lines")).select(
        F.concat(F.lit("d"), "d", F.lit(".example")).alias("domain"), F.lit(200).alias("status"),
        F.concat(F.lit("User-agent: *\n"), F.array_join(F.transform("lines", lambda x: x["rule"]), "\n")).alias("body"),
    )
    urls = table(spark, folder, "events").selectExpr(
        "event_id", "concat('https://d', event_id % 8, '.example/', event_id * 13 % 20000, '/x') AS url")
    return with_robots(urls, robots_policy(files, AGENT)).select("event_id", "allowed")


@web.query("effective_delay", f"""
WITH {_HOSTS_SQL}
SELECT domain, CASE WHEN length(domain) % 7 = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS delay_seconds FROM h""")
def effective_delays(spark: SparkSession, folder: str) -> DataFrame:
    policy = robots_policy(corpus_robots(spark, folder), AGENT)
    return policy.select("domain", effective_delay().alias("delay_seconds"))


# schedules

_SCHEDULE = """
WITH RECURSIVE r AS (SELECT concat('h', user_id % 20) AS domain, event_id, epoch_us(ts) AS a,
    row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT domain, k, event_id, a, a AS t FROM r WHERE k = 1
  UNION ALL SELECT r.domain, r.k, r.event_id, r.a, greatest(r.a, s.t + 900000000) FROM s JOIN r ON r.domain = s.domain AND r.k = s.k + 1)
SELECT domain, event_id AS request_id, a AS arrival_us, t AS start_us FROM s"""


def _requests(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("h"), F.col("user_id") % 20).alias("domain"), F.col("event_id").alias("request_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("arrival_us"), F.lit(900_000_000).cast("bigint").alias("delay_us"),
    )


@web.query("send_schedule", _SCHEDULE)
def schedule(spark: SparkSession, folder: str) -> DataFrame:
    return send_schedule(_requests(table(spark, folder, "events"))).drop("delay_us")


@web.query("send_schedule_two_level", _SCHEDULE)
def schedule_two_level(spark: SparkSession, folder: str) -> DataFrame:
    return send_schedule(_requests(table(spark, folder, "events"))).drop("delay_us")


@web.query("send_schedule_stream", f"SELECT *, false AS late FROM ({_SCHEDULE})")
def schedule_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "events").schema
    events = stream_table(spark, f"{folder}/events.parquet*", schema)
    return run_available(send_schedule_stream(_requests(events)), "send-times")


@web.query("send_schedule_in_order", _SCHEDULE)
def schedule_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """The events, then one request without a domain from far ahead that lets the last ones go."""
    events = table(spark, folder, "events")
    closing = scratch_path(spark, "closing")
    last = events.limit(1).withColumn("user_id", F.lit(None).cast(events.schema["user_id"].dataType)).withColumn(
        "ts", F.lit("2200-01-01 00:00:00").cast(events.schema["ts"].dataType))
    stream = stream_table(spark, f"{folder}/events.parquet*", events.schema).union(stream_table(spark, closing + "*", events.schema))
    return run_available(send_schedule_in_order(_requests(stream), "1 day"), "ordered-times", lambda: last.write.parquet(closing))


# retries

_ATTEMPTS_SQL = """
WITH l AS (SELECT concat('u', user_id % 100, '/', event_id // 400) AS url, event_id,
    CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 503 WHEN 'signup' THEN 404 WHEN 'error' THEN 503 ELSE 412 END AS status_code,
    CASE event_type WHEN 'view' THEN NULL WHEN 'signup' THEN 'HTTP 404: Not Found'
      WHEN 'purchase' THEN 'HTTP 412: Precondition Failed' ELSE 'HTTP 503: Service Unavailable' END AS error_message FROM events),
a AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY event_id) AS attempt FROM l),
f AS (SELECT *, status_code IN (200, 404) OR attempt = 3 AS final FROM a WHERE attempt <= 3),
e AS (SELECT url, coalesce(min(attempt) FILTER (final), max(attempt)) AS attempt FROM f GROUP BY url),
r AS (SELECT f.url, f.attempt::INTEGER AS attempt, f.status_code, f.status_code = 200 AS success, f.error_message FROM e JOIN f USING (url, attempt))"""


def _attempts(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "events").selectExpr(
        "concat('u', user_id % 100, '/', event_id div 400) AS url", "event_id",
        "CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 503 WHEN 'signup' THEN 404 WHEN 'error' THEN 503 ELSE 412 END AS status_code",
        "CASE event_type WHEN 'view' THEN NULL WHEN 'signup' THEN 'HTTP 404: Not Found' "
        "WHEN 'purchase' THEN 'HTTP 412: Precondition Failed' ELSE 'HTTP 503: Service Unavailable' END AS error_message",
    )
    return log.withColumn("attempt", F.row_number().over(Window.partitionBy("url").orderBy("event_id")))


@web.query("retry_resolve", _ATTEMPTS_SQL + " SELECT * FROM r")
def retry_resolve(spark: SparkSession, folder: str) -> DataFrame:
    return resolve_retries(_attempts(spark, folder), ["url"])


@web.query("backoff_total", _ATTEMPTS_SQL + """
SELECT r.url, coalesce(sum(2 ** (a.attempt - 1)), 0)::DOUBLE AS waited_seconds
FROM r LEFT JOIN a ON a.url = r.url AND a.attempt < r.attempt GROUP BY r.url""")
def backoff_totals(spark: SparkSession, folder: str) -> DataFrame:
    return backoff_total(resolve_retries(_attempts(spark, folder), ["url"])).select("url", "waited_seconds")

import random

import pytest
from pageloom.operators.fetches import backoff_total, fetch_followed, is_transient, resolve_redirects, resolve_retries
from pageloom.operators.robots import robots_policy
from pageloom.operators.schedule import send_schedule


U = "https://example.com"


def hops(name, n):
    """A chain of n redirects that ends in a page."""
    return [(f"{U}/{name}/{i}", 302, "Found", f"/{name}/{i + 1}") for i in range(n)] + [(f"{U}/{name}/{n}", 200, "OK", None)]


def test_redirects(spark):
    responses = [
        (f"{U}/redirect", 302, "Found", "http://169.254.169.254/latest/meta-data/"),
        (f"{U}/start", 301, "Moved", "/final-page"), (f"{U}/final-page", 200, "OK", None),
        (f"{U}/nowhere", 302, "Found", None), (f"{U}/gone", 404, "Not Found", None), (f"{U}/self", 302, "Found", "/self"),
        (f"{U}/lost", 307, "Temporary", "http://lost.example/"), *hops("five", 5), *hops("six", 6),
    ]
    unsafe = "Safety violation: Hostname '169.254.169.254' resolved to blocked/private IP '169.254.169.254'."
    limit = "Too many redirects (exceeded limit of 5)"
    expected = {
        "/redirect": ("http://169.254.169.254/latest/meta-data/", 1, 400, False, unsafe),
        "/start": (f"{U}/final-page", 1, 200, True, None), "/final-page": (f"{U}/final-page", 0, 200, True, None),
        "/nowhere": (f"{U}/nowhere", 0, 302, False, "Redirect response missing Location header."),
        "/gone": (f"{U}/gone", 0, 404, False, "HTTP 404: Not Found"), "/self": (f"{U}/self", 5, 400, False, limit),
        "/lost": ("http://lost.example/", 1, 400, False, "Safety violation: Could not resolve hostname 'lost.example'."),
        "/five/0": (f"{U}/five/5", 5, 200, True, None), "/six/0": (f"{U}/six/5", 5, 400, False, limit),
        "/six/1": (f"{U}/six/6", 5, 200, True, None), "/never": (f"{U}/never", 0, 500, False, "Request failed: no response recorded"),
    }
    got = resolve_redirects(
        spark.createDataFrame([(U + path,) for path in expected], "url string"),
        spark.createDataFrame(responses, "url string, status int, reason string, location string"),
        spark.createDataFrame([("example.com", "93.184.216.34")], "host string, ip string"),
    )
    assert {r.start_url[len(U):]: tuple(r)[1:] for r in got.collect()} == expected


def test_fetch_followed(spark):
    """Robots are asked at every hop; a page that several chains reach is parsed once; repeated answers count once."""
    responses = [
        (f"{U}/a", 302, "Found", "/b", None), (f"{U}/b", 302, "Found", "/page", None), (f"{U}/page", 200, "OK", None, "<p>Hi <b>there</b></p>"),
        (f"{U}/c", 302, "Found", "/closed/x", None), (f"{U}/closed/x", 200, "OK", None, "<p>no</p>"), (f"{U}/gone", 404, "Gone away", None, "<p>404</p>"),
    ]
    seeds = ["/a", "/b", "/page", "/c", "/closed/x", "/gone"]
    robots = spark.createDataFrame([("example.com", 200, "User-agent: *\nDisallow: /closed/")], "domain string, status int, body string")
    got = fetch_followed(
        spark.createDataFrame([(U + s,) for s in seeds], "url string"),
        spark.createDataFrame(responses * 2, "url string, status int, reason string, location string, html string"),
        spark.createDataFrame([("example.com", "93.184.216.34")], "host string, ip string"),
        robots_policy(robots, "bot/1"),
    ).collect()
    refused = f"Access to '{U}/closed/x' is restricted by site robots.txt policy."
    found = ("/page", 200, None, responses[2][4], "Hi there")
    assert len(got) == len(seeds)
    assert {r.start_url[len(U):]: (r.url[len(U):], r.status_code, r.error_message, r.raw_html, r.clean_text) for r in got} == {
        "/a": found, "/b": found, "/page": found, "/c": ("/closed/x", 403, refused, "", ""), "/closed/x": ("/closed/x", 403, refused, "", ""),
        "/gone": ("/gone", 404, "HTTP 404: Gone away", "", ""),
    }


def test_transient(spark):
    cases = {
        (503, None): True, (404, "HTTP 404: Not Found"): False, (412, "HTTP 412: Precondition Failed"): True,
        (408, "HTTP 408: Request Timeout"): True, (None, None): False,
    }
    df = spark.createDataFrame(list(cases), "s int, e string").select("s", "e", is_transient("s", "e").alias("t"))
    assert {(r.s, r.e): r.t for r in df.collect()} == cases


def test_retries(spark):
    rows = [("a", 1, 503, "x"), ("a", 2, 200, None), ("a", 3, 200, None), ("b", 1, 404, "y"), ("b", 2, 200, None),
            ("c", 1, 503, "x"), ("c", 2, 503, "x"), ("c", 3, 503, "z"), ("c", 4, 200, None), ("d", 1, 503, "x"), ("e", 1, 200, None)]
    got = backoff_total(resolve_retries(spark.createDataFrame(rows, "url string, attempt int, status_code int, error_message string"), ["url"]))
    assert {r.url: (r.attempt, r.success, r.error_message, r.waited_seconds) for r in got.collect()} == {
        "a": (2, True, None, 1.0), "b": (1, False, "y", 0.0), "c": (3, False, "z", 3.0), "d": (1, False, "x", 0.0), "e": (1, True, None, 0.0)
    }


def by_hand(rows):
    last, out = {}, {}
    for domain, request, arrival, delay in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        last[domain] = out[request] = max(arrival, last.get(domain, -10 ** 18) + delay)
    return out


def test_schedule_with_a_hot_domain_and_ties(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 3 else f"d{i % 50}", i, rng.choice([5, rng.randrange(0, 40_000)]), 70 if i % 3 else i % 50 + 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "domain string, request_id bigint, arrival_us bigint, delay_us bigint")
    got = {r.request_id: r.start_us for r in send_schedule(df).collect()}
    assert got == by_hand(rows)


def test_small_schedule(spark):
    rows = [("e", 1, 0, 1_000_000), ("e", 2, 100_000, 1_000_000), ("e", 3, 5_000_000, 1_000_000), ("e", 4, 5_100_000, 1_000_000)]
    df = spark.createDataFrame(rows, "domain string, request_id bigint, arrival_us bigint, delay_us bigint")
    assert [r.start_us for r in send_schedule(df).orderBy("request_id").collect()] == [0, 1_000_000, 5_000_000, 6_000_000]
    assert send_schedule(df.limit(0)).count() == 0


def test_attempts_with_one_number(spark):
    rows = [("u", 1, 503, "HTTP 503"), ("u", 1, 429, "b"), ("u", 1, 429, "a"), ("v", 1, 503, "x"), ("v", 1, 404, "y"), ("v", 1, 200, None)]
    attempts = spark.createDataFrame(rows, "url string, attempt int, status_code int, error_message string").repartition(4)
    got = {r.url: (r.status_code, r.error_message) for r in resolve_retries(attempts, ["url"]).collect()}
    assert got == {"u": (429, "a"), "v": (200, None)}

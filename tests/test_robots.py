import random
from urllib.robotparser import RobotFileParser

import pytest

from pageloom.operators.robots import effective_delay, robots_policy, robots_rules, with_robots
from pageloom.operators.schedule import requests_of

AGENT = "SampleCrawler/1.0"
BODIES = {
    "first-wins": "User-agent: *\nDisallow: /a\nAllow: /a/b\nCrawl-delay: 2",
    "allow-first": "User-agent: *\nAllow: /a/b\nDisallow: /a",
    "own-group": "User-agent: crawler\nDisallow: /x\nCrawl-delay: 1.5\n\nUser-agent: *\nDisallow: /",
    "literal": "User-agent: *\nDisallow: /*.pdf$",
    "empty-rule": "User-agent: *\nDisallow:",
    "no-rules": "User-agent: *\n\nUser-agent: *\nDisallow: /a",
    "rule-before-agent": "Disallow: /a\nUser-agent: *\nDisallow: /x",
    "blank-then-rule": "User-agent: *\nDisallow: /x\n\nDisallow: /a",
    "two-agents": "User-agent: foo\nUser-agent: SampleCrawl\nDisallow: /a # why\n# c\nCrawl-delay: 5",
    "two-defaults": "User-agent: *\nDisallow: /a\n\nUser-agent: *\nDisallow: /x",
    "encoded": "User-agent: *\nDisallow: /%7Ejoe/\nDisallow: /a%2fb?q=1\nDisallow: /é",
    "blanks": "User-agent : *\r\n  Disallow:   /a  \r\n \r\nAllow: /a\r\nSitemap: x\r\n",
    "rate": "User-agent: *\nRequest-rate: 1/5\n\nUser-agent: other\nDisallow: /",
    "nothing": "hello",
    "mixed": "User-agent: *\nDisallow: /x\nUser-agent: crawler\nCrawl-delay: 9\nAllow: /\n",
}
PATHS = ["/a", "/a/b", "/x/1", "/y", "/f.pdf", "", "/~joe/x", "/%7ejoe/", "/a/b?q=1", "/été", "/?x#y", "/*.pdf$", "/a%2Fb?q=1", "/a+b%zz"]


def test_bodies_agree_with_the_standard_library(spark):
    robots = spark.createDataFrame([(f"{k}.com", 200, body) for k, body in BODIES.items()], "domain string, status int, body string")
    urls = [(f"https://{k}.com{path}",) for k in BODIES for path in PATHS]
    got = with_robots(spark.createDataFrame(urls, "url string"), robots_policy(robots, AGENT)).collect()
    assert len(got) == len(urls)
    for r in got:
        parser = RobotFileParser()
        parser.parse(BODIES[r.url.split("/")[2][:-4]].splitlines())
        assert (r.allowed, r.crawl_delay) == (parser.can_fetch(AGENT, r.url), parser.crawl_delay(AGENT)), r.url


@pytest.mark.parametrize("status,allowed", [(404, True), (None, True), (401, False), (403, False), (500, False), (302, False)])
def test_statuses(spark, status, allowed):
    robots = spark.createDataFrame([("e.com", status, "User-agent: *\nDisallow: /")], "domain string, status int, body string")
    row = with_robots(spark.createDataFrame([("https://E.com/x",)], "url string"), robots_policy(robots, AGENT)).first()
    assert (row.allowed, row.crawl_delay) == (allowed, None)


def test_delay(spark):
    df = spark.createDataFrame([(2,), (None,)], "crawl_delay int").select(effective_delay().alias("d"))
    assert [r.d for r in df.collect()] == [2.0, 1.0]


def test_unsafe_host_denies(spark):
    robots = spark.createDataFrame([("e.com", 200, "", False)], "domain string, status int, body string, is_safe boolean")
    assert robots_policy(robots, AGENT).first().mode == "deny"


def test_requests_of_a_policy(spark):
    robots = spark.createDataFrame([("e.com", 200, "User-agent: *\nDisallow: /x\nCrawl-delay: 2")], "domain string, status int, body string")
    urls = spark.createDataFrame([(1, "https://e.com/a", 0), (2, "https://e.com/x", 0), (3, "https://f.com/a", 5)], "request_id bigint, url string, arrival_us bigint")
    got = requests_of(urls, robots_policy(robots, AGENT)).orderBy("request_id").collect()
    assert [tuple(r) for r in got] == [("e.com", 1, 0, 2_000_000), ("f.com", 3, 5, 1_000_000)]


def test_two_files_of_a_domain_give_the_rules_of_one(spark):
    rows = [("e.com", 404, "User-agent: *\nDisallow: /no"), ("e.com", 200, "User-agent: a\nDisallow: /x"), ("e.com", 200, "User-agent: b\nDisallow: /y")]
    robots = spark.createDataFrame(rows, "domain string, status int, body string").repartition(3)
    assert [(r.agents, r.path) for r in robots_rules(robots).collect()] == [(["a"], "/x")]
    assert robots_policy(robots, "a/1").first().rules[0].path == "/x"


def test_long_files_decide_as_the_first_match_does(spark):
    rng = random.Random(4)
    word = lambda: "/" + "".join(rng.choice("abcé%") for _ in range(rng.randint(4, 9))).replace("%", "%41")
    rules = [(rng.choice(["Allow", "Disallow"]), rng.choice([word(), f"/p{rng.randrange(10 ** 6)}"])) for _ in range(50_000)]
    body = "User-agent: *\n" + "\n".join(f"{kind}: {path}" for kind, path in rules if path)
    urls = [f"https://e.com{word()}" for _ in range(150)] + [f"https://e.com/p{rng.randrange(10 ** 6)}/x" for _ in range(300)]
    policy = robots_policy(spark.createDataFrame([("e.com", 200, body)], "domain string, status int, body string"), AGENT)
    parser = RobotFileParser()
    parser.parse(body.splitlines())
    got = with_robots(spark.createDataFrame([(u,) for u in urls], "url string"), policy).collect()
    assert len({r.allowed for r in got}) == 2
    assert {r.url: r.allowed for r in got} == {u: parser.can_fetch(AGENT, u) for u in urls}

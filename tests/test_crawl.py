import random

import pytest

from conftest import column, pages_of
from pageloom.operators.crawl import crawl_chains, crawl_errors, crawl_records, next_links

P1 = "https://example.com/page/1"


NEXT = [
    ('<a href="older/7.html" rel="next">more boats</a>', "https://example.com/log/", "https://example.com/log/older/7.html"),
    ('<a href="&#63;from=40">Next</a>', "https://example.com/tides", "https://example.com/tides?from=40"),
    ('<a class="next" href=" #top">go on</a>', P1, None), ('<a class="next" href="mailto:a@b.c">Next</a>', P1, None),
    ('<a rel="next" href="#">x</a><a rel="next" href="/2">y</a>', P1, None),
    ('<a href="/t">Next</a><a class="next" href="/c">x</a>', P1, "https://example.com/t"),
    ('<a class="nextgen" href="/g">x</a>', P1, "https://example.com/g"), ('<a id="Pager-NEXT" href=" /g ">x</a>', P1, "https://example.com/g"),
    ('<a href="/t">Next page</a>', P1, None), ('<a href="/t">NEXT <b>»</b></a>', P1, None), ('<a href="/t"> &gt;&gt; </a>', P1, "https://example.com/t"),
    ('<a href="/t">Επόμενη</a>', P1, "https://example.com/t"),
    ('<link rel="next" href="/l"><a rel="prev next" href="/2">p</a>', P1, "https://example.com/2"),
    ('<a rel="next">no link</a><a class="next" href="/2">p</a>', P1, "https://example.com/2"), ("", P1, None),
]


def test_next_link(spark):
    got = column(next_links(pages_of(spark, [case[:2] for case in NEXT])), "next_url")
    assert dict(zip(NEXT, got)) == {case: case[2] for case in NEXT}


def visits(spark, edges, seeds=("a",), **kw):
    df = spark.createDataFrame(edges, "url string, success boolean, next_url string")
    got = crawl_chains(spark.createDataFrame([(s,) for s in seeds], "url string"), df, **kw)
    return sorted((r.seed, r.page_no, r.url, r.success) for r in got.collect())


def test_repeated_pages_count_once(spark):
    edges = [("a", True, "b"), ("b", False, None), ("b", True, "c"), ("c", True, None)]
    assert visits(spark, edges * 3) == visits(spark, [edges[0], edges[2], edges[3]])


def chain(names, fail=()):
    return [(n, n not in fail, m) for n, m in zip(names, [*names[1:], None])]


def test_chain_and_page_cap(spark):
    assert visits(spark, chain("abcde")) == [("a", 1, "a", True), ("a", 2, "b", True), ("a", 3, "c", True)]
    assert [v[2] for v in visits(spark, chain("abcde"), max_pages=20)] == list("abcde")
    with pytest.raises(ValueError):
        visits(spark, chain("ab"), max_pages=21)


def test_longer_crawl_starts_with_the_shorter(spark):
    edges = chain("abcdefghijkl")
    five, twelve = (visits(spark, edges, max_pages=n) for n in (5, 12))
    assert twelve[:5] == five and len(twelve) == 12


def test_cycle_failure_and_missing_page(spark):
    assert [v[2] for v in visits(spark, [("a", True, "b"), ("b", True, "a")], max_pages=9)] == ["a", "b"]
    assert visits(spark, chain("abc", fail="b")) == [("a", 1, "a", True), ("a", 2, "b", False)]
    assert visits(spark, [("a", True, "gone")]) == [("a", 1, "a", True), ("a", 2, "gone", False)]


def test_many_seeds_that_meet_on_one_page(spark):
    edges = [(f"s{i}", True, "hub") for i in range(50)] + [("hub", True, "end"), ("end", True, None)]
    got = visits(spark, edges, seeds=[f"s{i}" for i in range(50)] * 2)
    assert len(got) == 150 and sum(v[2] == "hub" for v in got) == 50


def test_records_and_errors(spark):
    edges = spark.createDataFrame(chain("abc"), "url string, success boolean, next_url string")
    seen = crawl_chains(spark.createDataFrame([("a",)], "url string"), edges)
    records = spark.createDataFrame([("a", 0, "Item 1"), ("c", 0, "Item 3")], "url string, item_no int, title string")
    failed = spark.createDataFrame([("b", "bad")], "url string, error string")
    assert [r.title for r in crawl_records(seen, records).orderBy("page_no").collect()] == ["Item 1", "Item 3"]
    assert [(r.page_no, r.error) for r in crawl_errors(seen, failed).collect()] == [(2, "bad")]
    assert [(r.page_no, r.error) for r in crawl_errors(seen, failed.union(failed)).collect()] == [(2, "bad")]


def test_pages_of_one_site(spark):
    pages = pages_of(spark, [('<h1>P1</h1><a rel="next" href="/page/2">Next</a>', P1), ("<h1>P2</h1>", "https://example.com/page/2")])
    assert column(next_links(pages), "next_url") == ["https://example.com/page/2", None]


def walk(edges, seed, most):
    """Visits of one seed, page by page."""
    pages = {}
    for url, ok, target in edges:
        pages.setdefault(url, (ok, target))
    out, met, url = [], set(), seed
    while url is not None and url not in met and len(out) < most:
        ok, target = pages.get(url, (False, None))
        out.append((seed, len(out) + 1, url, ok))
        met.add(url)
        url = target if ok else None
    return out


@pytest.mark.parametrize("most", [1, 2, 3, 7, 16, 20])
def test_random_links_by_walking(spark, most):
    rng = random.Random(most)
    edges = [(f"u{i}", rng.random() < 0.95, f"u{rng.randrange(70)}" if rng.random() < 0.97 else None) for i in range(60)]
    edges += [(f"r{i}", True, f"r{(i + 1) % 19}") for i in range(19)] + [(f"c{i}", True, f"c{i + 1}") for i in range(40)]
    seeds = [e[0] for e in edges] + ["nowhere"]
    assert visits(spark, edges, seeds=seeds, max_pages=most) == sorted(v for s in seeds for v in walk(edges, s, most))


def test_twenty_pages_take_five_joins_of_the_visits(spark):
    df = spark.createDataFrame(chain([f"u{i}" for i in range(30)]), "url string, success boolean, next_url string")
    plan = crawl_chains(spark.createDataFrame([("u0",)], "url string"), df, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 6  # five, and one with the pages for success

"""A key with a third of all rows is split by adaptive execution, and results stay whole."""

import pytest
from pyspark.sql import functions as F

from pageloom.operators.crawl import crawl_chains
from pageloom.operators.enforce import page_scope
from pageloom.operators.fetches import resolve_redirects
from pageloom.operators.ledger import ledger_state
from pageloom.operators.robots import robots_policy, with_robots

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}
ROWS = 60_000


@pytest.fixture
def small_parts(spark):
    before = {key: spark.conf.get(key, None) for key in SMALL}
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        if value in (None, "<undefined>"):
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def run(df):
    """Rows of a query and whether a join of it was split."""
    rows = df.collect()
    return rows, "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def test_hot_domain(small_parts):
    ids = small_parts.range(0, ROWS, 1, 8)
    host = F.when(F.col("id") % 3 == 0, "hot.com").otherwise(F.concat(F.lit("h"), F.col("id") % 997, F.lit(".com")))
    urls = ids.select("id", F.concat(F.lit("https://"), host, F.lit("/p/"), F.sha2(F.col("id").cast("string"), 512)).alias("url"))
    robots = small_parts.createDataFrame(
        [("hot.com", 200, "User-agent: *\nDisallow: /p/0"), ("h1.com", 403, None)], "domain string, status int, body string"
    )
    rows, split = run(with_robots(urls, robots_policy(robots, "any/1")))
    assert len(rows) == ROWS and split
    refused = {r.id for r in rows if not r.allowed}
    assert refused == {r.id for r in rows if "//hot.com/p/0" in r.url or "//h1.com/" in r.url}


def test_hot_task(small_parts):
    events = small_parts.range(0, ROWS, 1, 8).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 997)).alias("task_id"),
        F.when(F.col("id") < 5000, "create").when(F.col("id") == 9000, "delete").when(F.col("id") == 9003, "create")
        .otherwise("update").alias("kind"),
        F.lit("running").alias("status"), F.lit("u").alias("url"), F.lit(1).alias("records_count"),
        F.sha2(F.col("id").cast("string"), 512).alias("records"), F.lit(None).cast("string").alias("error_message"),
        F.timestamp_seconds("id").alias("at"),
    )
    rows, split = run(ledger_state(events))
    state = {r.task_id: r for r in rows}
    assert len(rows) == 998 and split
    assert state["hot"].created_at.timestamp() == 9003 and state["hot"].updated_at.timestamp() == ROWS - 3


def test_hub_page(small_parts):
    pages = small_parts.range(0, ROWS // 3, 1, 8).select(F.sha2(F.col("id").cast("string"), 512).alias("url"))
    hub = small_parts.createDataFrame([("hub", "end"), ("end", None)], "url string, next_url string")
    edges = pages.select("url", F.lit("hub").alias("next_url")).union(hub).withColumn("success", F.lit(True))
    rows, split = run(crawl_chains(pages, edges, max_pages=3))
    assert len(rows) == ROWS and split
    assert sum(r.url == "hub" for r in rows) == sum(r.url == "end" for r in rows) == ROWS // 3


def test_hub_redirect(small_parts):
    seeds = small_parts.range(0, ROWS // 3, 1, 8).select(
        F.concat(F.lit("https://e.com/"), F.sha2(F.col("id").cast("string"), 512)).alias("url")
    )
    hub = small_parts.createDataFrame(
        [("https://e.com/hub", 301, "Moved", "/end"), ("https://e.com/end", 200, "OK", None)],
        "url string, status int, reason string, location string",
    )
    responses = seeds.select("url", F.lit(302).alias("status"), F.lit("Found").alias("reason"), F.lit("/hub").alias("location")).union(hub)
    dns = small_parts.createDataFrame([("e.com", "93.184.216.34")], "host string, ip string")
    rows, split = run(resolve_redirects(seeds, responses, dns))
    assert len(rows) == ROWS // 3 and split
    assert {(r.url, r.hops, r.success) for r in rows} == {("https://e.com/end", 2, True)}


def test_hot_page(small_parts):
    records = small_parts.range(0, ROWS, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 997).alias("page_id"), F.sha2(F.col("id").cast("string"), 512).alias("title"),
        F.when(F.col("id") % 997 == 5, F.array(F.lit("bad"))).otherwise(F.array().cast("array<string>")).alias("errors"),
    )
    rows, split = run(page_scope(records))
    wanted = {i for i in range(ROWS) if i % 997 == 5}
    bad_pages = {0 if i % 3 == 0 else i % 997 for i in wanted}
    assert split and len(rows) == sum((0 if i % 3 == 0 else i % 997) not in bad_pages for i in range(ROWS))

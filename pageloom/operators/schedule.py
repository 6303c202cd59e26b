"""Send times that keep a delay between requests to the same domain.

Request k of a domain starts at ``max(arrival_k, start_(k-1) + delay)``, which equals
``k * delay + max over j <= k of (arrival_j - j * delay)``: a running maximum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pageloom.functions.urls import domain
from pageloom.operators.robots import effective_delay, with_robots
from pageloom.session import cut_lineage


def _running(window):
    return window.rowsBetween(Window.unboundedPreceding, 0)


def _before(window):
    return window.rowsBetween(Window.unboundedPreceding, -1)


def requests_of(urls: DataFrame, policy: DataFrame, url: str = "url") -> DataFrame:
    """Requests to schedule from ``urls(request_id, url, arrival_us)``: refused URLs are left out.

    The delay is the domain's crawl delay, or the default.
    """
    delay_us = (effective_delay("crawl_delay") * 1_000_000).cast("bigint")
    return with_robots(urls, policy, url).where("allowed").select(
        domain(url).alias("domain"), "request_id", "arrival_us", delay_us.alias("delay_us")
    )


def send_schedule(requests: DataFrame) -> DataFrame:
    """Add ``start_us`` to ``requests(domain, request_id, arrival_us, delay_us)``.

    ``delay_us`` is one value per domain. Running maximum over range partitions, then over one
    summary row per part, so that no task sorts a whole domain.

    Requests without a domain are one domain, as every other value is.

    A range shuffle on (domain, arrival, id) cuts hot domains into parts of even size. The
    parts are written to the shared folder once, since both levels must see the same cut.
    Within a part the rank and maximum are local; a part's summary (row count, maximum)
    gives later parts of the domain their offsets.
    """
    cut = cut_lineage(
        requests.repartitionByRange("domain", "arrival_us", "request_id")
        .withColumn("_part", F.spark_partition_id())
    )
    local = Window.partitionBy("domain", "_part").orderBy("arrival_us", "request_id")
    ranked = (
        cut.withColumn("_rank", F.row_number().over(local))
        .withColumn("_slack", F.max(F.col("arrival_us") - F.col("_rank") * F.col("delay_us")).over(_running(local)))
    )
    parts = Window.partitionBy("domain").orderBy("_part")
    offsets = (
        ranked.groupBy("domain", "_part")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_slack").alias("_top"), F.first("delay_us").alias("_d"))
        .withColumn("_skip", F.coalesce(F.sum("_n").over(_before(parts)), F.lit(0)))
        .withColumn("_floor", F.max(F.col("_top") - F.col("_skip") * F.col("_d")).over(_before(parts)))
        .select("domain", "_part", "_skip", "_floor")
    )
    slack = F.col("_slack") - F.col("_skip") * F.col("delay_us")
    start = (F.col("_skip") + F.col("_rank")) * F.col("delay_us") + F.greatest(slack, F.col("_floor"))
    offsets = offsets.select(F.col("domain").alias("_d"), F.col("_part").alias("_p"), "_skip", "_floor")
    mine = F.col("domain").eqNullSafe(F.col("_d")) & (F.col("_part") == F.col("_p"))
    return ranked.join(offsets, mine).withColumn("start_us", start).drop(
        "_part", "_rank", "_slack", "_skip", "_floor", "_d", "_p"
    )

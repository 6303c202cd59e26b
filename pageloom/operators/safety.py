"""URL safety verdicts over whole tables, with addresses from a lookup table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pageloom.functions.core import join_facts
from pageloom.functions.ips import ip_blocked
from pageloom.functions.urls import REASON_SAFE, literal_address, url_host, url_reason
from pageloom.operators.nets import with_blocked


def host_verdicts(dns: DataFrame, strict: bool = False, nets: DataFrame | None = None) -> DataFrame:
    """One row per host of ``dns(host, ip)``; any blocked address marks the host.

    ``nets`` is a table of networks (see ``with_nets``) that takes the place of the fixed ones.
    """
    if nets is None:
        rows = dns.select("host", "ip", ip_blocked("ip", strict).alias("blocked"))
    else:
        rows = with_blocked(dns.select("host", "ip"), nets, mapped=strict)
    return rows.groupBy(F.lower("host").alias("host")).agg(
        F.min(F.when(F.col("blocked"), F.col("ip"))).alias("blocked_ip"),
        F.lit(True).alias("resolved"),
    )


def check_urls(
    urls: DataFrame, dns: DataFrame, url: str = "url", strict: bool = False, nets: DataFrame | None = None
) -> DataFrame:
    """Add ``is_safe`` and ``reason``. ``dns`` is reduced to one row per host before the join.

    With a table of ``nets``, hosts that are addresses themselves are looked up in it as well.
    """
    hosted = urls.withColumn("_host", url_host(url))
    if nets is not None:
        literals = hosted.select(F.col("_host").alias("host"), literal_address(F.col("_host")).alias("ip"))
        # what a table of addresses says of a host that is one itself doesn't count
        dns = dns.select("host", "ip").where(literal_address(F.lower("host")).isNull()).union(
            literals.where("ip is not null").distinct())
    hosts = host_verdicts(dns, strict, nets).withColumnRenamed("host", "_host")
    reason = url_reason(url, F.col("resolved"), F.col("blocked_ip"), strict, nets is not None)
    return (
        join_facts(hosted, hosts, "_host")
        .withColumn("reason", reason)
        .withColumn("is_safe", F.col("reason") == REASON_SAFE)
        .drop("_host", "blocked_ip", "resolved")
    )

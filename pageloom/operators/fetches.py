"""Outcomes of fetches: classification, redirects, retries, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.functions.core import col, join_facts, one_per_key
from pageloom.functions.nodes import clean_text
from pageloom.functions.urls import REASON_SAFE, domain, hostname, join_url, url_reason
from pageloom.operators.dom import parse_html
from pageloom.operators.robots import is_allowed, sorted_rules, with_robots
from pageloom.operators.safety import check_urls, host_verdicts
from pageloom.session import cut_lineage

# Status codes and messages of an outcome.
REDIRECT_CODES = [301, 302, 303, 307, 308]
TRANSIENT_CODES = [429, 500, 502, 503, 504]
TRANSIENT_WORDS = ["failed", "timeout"]
MSG_UNSAFE = "Safety violation: %s"
MSG_ROBOTS = "Access to '%s' is restricted by site robots.txt policy."
MSG_REQUEST = "Request failed: %s"
MSG_STATUS = "HTTP %d: %s"
MSG_REDIRECTS = "Too many redirects (exceeded limit of %d)"
MSG_NO_LOCATION = "Redirect response missing Location header."

FETCH_VIEW = ["url", "status_code", "success", "clean_text", "error_message", "elapsed_seconds"]


def fetch_outcome(log: DataFrame) -> DataFrame:
    """Classify a fetch log ``(url, status, reason, safety_reason, allowed, request_error)``.

    Checks in order: unsafe URL (400), refused by robots (403), failed request (500), then the
    response itself. Rows get ``status_code``, ``success`` and ``error_message``.
    """
    unsafe = F.col("safety_reason") != REASON_SAFE
    refused = ~F.col("allowed")
    failed = F.col("request_error").isNotNull()
    ok = F.col("status") == 200
    return log.select(
        *[c for c in log.columns if c not in ("status", "reason", "safety_reason", "allowed", "request_error")],
        F.when(unsafe, 400).when(refused, 403).when(failed, 500).otherwise(F.col("status")).alias("status_code"),
        F.when(unsafe | refused | failed, False).otherwise(F.coalesce(ok, F.lit(False))).alias("success"),
        F.when(unsafe, F.format_string(MSG_UNSAFE, "safety_reason"))
        .when(refused, F.format_string(MSG_ROBOTS, "url"))
        .when(failed, F.format_string(MSG_REQUEST, "request_error"))
        .when(~ok, F.format_string(MSG_STATUS, "status", "reason"))
        .alias("error_message"),
    )


def _sites(log: DataFrame, dns: DataFrame, policy: DataFrame | None) -> DataFrame:
    """One row per domain of the log: address verdict and robots policy."""
    hosts = host_verdicts(dns).withColumnRenamed("host", "_host")
    sites = (
        log.select(domain("url").alias("_domain")).distinct()
        .withColumn("_host", hostname(F.col("_domain"))).join(hosts, "_host", "left").drop("_host")
    )
    if policy is None:
        policy = log.sparkSession.createDataFrame([], "domain string, mode string, rules array<struct<path:string,allow:boolean>>")
    rules = policy.select(F.col("domain").alias("_domain"), "mode", sorted_rules(F.col("rules")).alias("rules"))
    return sites.join(rules, "_domain", "left")


def fetch_results(log: DataFrame, dns: DataFrame, policy: DataFrame | None = None) -> DataFrame:
    """Results of recorded fetches, safety and robots included.

    ``log(url, status, reason, html, request_error, elapsed_seconds, headers)`` plus any other
    columns, which stay. Without a ``policy`` robots are ignored. Only pages that count as
    fetched are parsed: the others reach the parser as NULL. What is known of a site is
    joined up first, one row per domain, so that the rows with the HTML move at most once,
    and not at all when the site table turns out small enough to broadcast.
    """
    sites = _sites(log, dns, policy)
    gated = join_facts(log.withColumn("_domain", domain("url")), sites, "_domain").withColumns({
        "safety_reason": url_reason("url", F.col("resolved"), F.col("blocked_ip")),
        "allowed": is_allowed("url", F.col("mode"), F.col("rules")),
    }).drop(*sites.columns)
    sent = (F.col("safety_reason") == REASON_SAFE) & F.col("allowed")
    answered = sent & F.col("request_error").isNull()
    timed = gated.withColumns({
        "elapsed_seconds": F.when(sent, F.col("elapsed_seconds")).otherwise(F.lit(0.0)),
        "headers": F.when(answered, F.col("headers")).otherwise(F.create_map().cast("map<string,string>")),
    })
    done = fetch_outcome(timed)
    return (
        done.withColumn("_dom", parse_html(F.when(F.col("success"), F.col("html"))))
        .withColumn("raw_html", F.when(F.col("success"), F.col("html")).otherwise(""))
        .withColumn("clean_text", clean_text("_dom"))
        .drop("_dom", "html")
    )


def fetch_view(results: DataFrame) -> DataFrame:
    """What a caller of a fetch sees: no raw HTML, no headers."""
    return results.select(*FETCH_VIEW)


def is_transient(status: Column | str, error: Column | str) -> Column:
    message = F.lower(F.coalesce(col(error), F.lit("")))
    by_word = message.contains(TRANSIENT_WORDS[0])
    for word in TRANSIENT_WORDS[1:]:
        by_word = by_word | message.contains(word)
    return F.coalesce(col(status).isin(TRANSIENT_CODES), F.lit(False)) | by_word


def resolve_redirects(
    seeds: DataFrame, responses: DataFrame, dns: DataFrame, max_redirects: int = 5, policy: DataFrame | None = None
) -> DataFrame:
    """Follow recorded redirects from ``seeds(url)`` over ``responses(url, status, reason, location)``.

    Each hop must be safe, and allowed by the robots ``policy`` if there is one.
    Every URL that can be met is checked once and kept in the shared folder, so a hop is one
    join on the URL with a table of one row per URL. A finished seed keeps a join key of its own that matches nothing:
    the keys stay spread over all partitions, where NULL would put them into one.
    """
    # a URL that was answered more than once counts once: the answer with the least status
    once = one_per_key(responses.select("url", "status", "reason", "location"), "url", F.col("status").isNull())
    recorded = once.select(
        "url", "status", "reason",
        F.when(F.coalesce("location", F.lit("")) != "", join_url("url", "location")).alias("target"),
    )
    met = (
        seeds.select("url").union(recorded.select("url"))
        .union(recorded.where(F.col("target").isNotNull()).select("target")).distinct()
    )
    checked = check_urls(met, dns).select("url", "is_safe", F.col("reason").alias("verdict"))
    if policy is None:
        checked = checked.withColumn("allowed", F.lit(True))
    else:
        checked = with_robots(checked, policy).drop("crawl_delay")
    nodes = cut_lineage(checked.join(recorded, "url", "left").withColumnRenamed("url", "_at"))
    chain = seeds.select("url").distinct().select(
        F.col("url").alias("start_url"), "url",
        F.lit(0).alias("hops"), F.lit(False).alias("done"),
        F.lit(None).cast("int").alias("status_code"), F.lit(None).cast("string").alias("error_message"),
    )
    redirect = F.col("status").isin(REDIRECT_CODES)
    code = (
        F.when(~F.col("is_safe"), 400)
        .when(~F.col("allowed"), 403)
        .when(F.col("status").isNull(), 500)
        .when(redirect & (F.col("hops") >= max_redirects), 400)
        .when(redirect & F.col("target").isNotNull(), None)
        .otherwise(F.col("status"))
    )
    message = (
        F.when(~F.col("is_safe"), F.format_string(MSG_UNSAFE, "verdict"))
        .when(~F.col("allowed"), F.format_string(MSG_ROBOTS, "url"))
        .when(F.col("status").isNull(), F.lit(MSG_REQUEST % "no response recorded"))
        .when(redirect & (F.col("hops") >= max_redirects), F.lit(MSG_REDIRECTS % max_redirects))
        .when(redirect & F.col("target").isNull(), F.lit(MSG_NO_LOCATION))
        .when(~redirect & (F.col("status") != 200), F.format_string(MSG_STATUS, "status", "reason"))
    )
    for _ in range(max_redirects + 1):
        at = F.when(F.col("done"), F.concat(F.lit("\x00"), "start_url")).otherwise(F.col("url"))
        step = chain.withColumn("_at", at).join(nodes, "_at", "left")
        moved = F.col("new_code").isNull() & ~F.col("done")
        chain = step.withColumns({"new_code": F.when(~F.col("done"), code), "new_message": message}).select(
            "start_url",
            F.when(moved, F.col("target")).otherwise(F.col("url")).alias("url"),
            (F.col("hops") + moved.cast("int")).alias("hops"),
            (F.col("done") | ~moved).alias("done"),
            F.coalesce("status_code", "new_code").alias("status_code"),
            F.when(F.col("done"), F.col("error_message")).otherwise(F.col("new_message")).alias("error_message"),
        )
    return chain.select(
        "start_url", "url", "hops", "status_code",
        (F.col("status_code") == 200).alias("success"), "error_message",
    )


def fetch_followed(
    seeds: DataFrame, responses: DataFrame, dns: DataFrame, policy: DataFrame | None = None, max_redirects: int = 5
) -> DataFrame:
    """Whole fetches of ``seeds(url)``: redirects followed, each hop checked, the last page parsed.

    ``responses(url, status, reason, location, html)``. The chains move narrow rows; of the HTML
    only pages that end some chain meet a join, and each is parsed once for all its chains.
    """
    chains = cut_lineage(resolve_redirects(seeds, responses, dns, max_redirects, policy))
    ends = chains.where("success").select("url").distinct()
    answers = responses.where("status = 200").select("url", "status", "reason", "location", "html")
    pages = one_per_key(answers.join(ends, "url", "left_semi"), "url")  # the answer that the chain met
    parsed = pages.withColumn("_dom", parse_html("html")).select(
        "url", F.col("html").alias("raw_html"), clean_text("_dom").alias("clean_text"))
    blank = {c: F.coalesce(c, F.lit("")) for c in ("raw_html", "clean_text")}
    return join_facts(chains, parsed, "url").withColumns(blank)


def resolve_retries(attempts: DataFrame, keys: list[str], max_retries: int = 3) -> DataFrame:
    """The attempt that counts, per key, of ``attempts(attempt, status_code, error_message)``.

    Attempts are numbered from 1. The first success, the first failure that is not transient,
    or the last allowed attempt ends the loop. Of attempts with one number the least status
    counts, then the least message. Only aggregates, so hot keys combine early.
    """
    success = F.col("status_code") == 200
    final = success | ~is_transient("status_code", "error_message") | (F.col("attempt") == max_retries)
    row = F.struct("attempt", "status_code", "error_message")
    # without a final attempt the latest counts; equal numbers are told apart by the row itself
    latest = F.struct((-F.col("attempt")).alias("back"), row.alias("row"))
    return (
        attempts.where(F.col("attempt") <= max_retries)
        .groupBy(*keys)
        .agg(F.min(F.when(final, row)).alias("ended"), F.min(latest).alias("latest"))
        .select(*keys, F.coalesce(F.col("ended"), F.col("latest.row")).alias("r"))
        .select(*keys, "r.attempt", "r.status_code", (F.col("r.status_code") == 200).alias("success"),
                "r.error_message")
    )


def backoff_waits(retry_delay: float = 1.0) -> Column:
    """Wait after attempt ``attempt`` (from 1): the delay, doubled each time."""
    return F.lit(retry_delay) * F.pow(F.lit(2.0), F.col("attempt") - 1)


def backoff_total(resolved: DataFrame, retry_delay: float = 1.0) -> DataFrame:
    """Seconds waited before the attempt that counts: the sum of the doubling delays."""
    total = F.lit(retry_delay) * (F.pow(F.lit(2.0), F.col("attempt") - 1) - 1)
    return resolved.withColumn("waited_seconds", total)

"""Robots files as tables: rules, permission, delay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pageloom.functions.core import col, join_facts, let, one_per_key
from pageloom.functions.text import strip
from pageloom.functions.urls import domain, split_url, unsplit_url

# Fixed value: the delay used where robots give none.
DEFAULT_DELAY = 1.0

_LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def unquote(c: Column) -> Column:
    """Percent-decode; a percent sign that starts no code stays."""
    safe = F.regexp_replace(F.replace(c, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), c)


def quote(c: Column) -> Column:
    """Percent-encode all but letters, digits and ``_.-~/``."""
    out = F.url_encode(c)
    for found, wanted in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(found), F.lit(wanted))
    return out


def robots_groups(robots: DataFrame) -> DataFrame:
    """Agent groups of ``robots(domain, status, body)``, for bodies served with 200.

    One row per group that has a rule: ``group_no``, ``agents``, ``rules`` in file order and
    ``crawl_delay``. A group starts at an agent line that follows no agent line; a rule
    counts when the last agent or empty line before it is an agent line. Windows and
    groups span the lines of one file, which arrived as one value.
    """
    lines = robots.where(F.col("status") == 200).select(
        "domain", F.posexplode(F.split("body", _LINE_END)).alias("line_no", "line")
    )
    content = strip(F.regexp_extract("line", "^([^#]*)", 1))
    key = F.lower(strip(F.regexp_extract("content", "^([^:]*):", 1)))
    value = unquote(strip(F.regexp_extract("content", "(?s)^[^:]*:(.*)$", 1)))
    kind = (
        F.when(F.col("line") == "", "end")
        .when(F.col("key") == "user-agent", "agent")
        .when(F.col("key").isin("allow", "disallow", "crawl-delay", "request-rate"), "rule")
    )
    by_line = Window.partitionBy("domain").orderBy("line_no")
    so_far = by_line.rowsBetween(Window.unboundedPreceding, 0)
    starts = (F.col("kind") == "agent") & (F.coalesce(F.lag("kind").over(by_line), F.lit("end")) != "agent")
    marked = (
        lines.withColumn("content", content)
        .withColumns({"key": key, "value": value})
        .withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .withColumns({
            "starts": starts.cast("int"),
            "opened": F.last(F.when(F.col("kind") != "rule", F.col("kind")), ignorenulls=True).over(so_far),
        })
        .withColumn("group_no", F.sum("starts").over(so_far))
        .where((F.col("kind") != "end") & (F.col("opened") == "agent"))
    )
    is_path = F.col("key").isin("allow", "disallow")
    path = F.struct(
        "line_no",
        quote(unsplit_url(split_url("value"))).alias("path"),
        ((F.col("key") == "allow") | (F.col("value") == "")).alias("allow"),
    )
    agent = F.struct("line_no", F.col("value").alias("agent"))
    delay = F.when((F.col("key") == "crawl-delay") & F.col("value").rlike("^[0-9]+$"), F.col("value"))
    return (
        marked.groupBy("domain", "group_no")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("kind") == "agent", agent))).alias("agents"),
            F.array_sort(F.collect_list(F.when(is_path, path))).alias("rules"),
            F.max_by(delay, F.when(delay.isNotNull(), F.col("line_no"))).try_cast("int").alias("crawl_delay"),
            F.count(F.when(F.col("kind") == "rule", 1)).alias("n_rules"),
        )
        .where("n_rules > 0")
        .select(
            "domain", "group_no",
            F.transform("agents", lambda a: a["agent"]).alias("agents"),
            F.transform("rules", lambda r: F.struct(r["path"].alias("path"), r["allow"].alias("allow"))).alias("rules"),
            "crawl_delay",
        )
    )


def _one_file(robots: DataFrame) -> DataFrame:
    """A domain's files count once: the least status first, a network error last."""
    return one_per_key(robots, "domain", F.col("status").isNull())


def robots_rules(robots: DataFrame) -> DataFrame:
    """One row per rule: domain, group, agents, ``rule_no`` from 0, path, allow, delay.

    A domain has one file: of several rows the one that ``robots_policy`` reads.
    """
    return robots_groups(_one_file(robots)).select(
        "domain", "group_no", "agents", "crawl_delay", F.posexplode("rules").alias("rule_no", "rule")
    ).select("domain", "group_no", "agents", "rule_no", "rule.path", "rule.allow", "crawl_delay")


def robots_policy(robots: DataFrame, agent: str) -> DataFrame:
    """One row per domain: ``mode`` (rules, allow or deny), our ``rules``, ``crawl_delay``.

    ``agent`` is our user agent, such as ``name/1.0``. Our group is the first that names us,
    else the first for all agents. Status 404 and network errors (NULL) allow; any other
    status but 200 denies, as does ``is_safe = false`` where the table has that column.
    """
    robots = _one_file(robots)
    token = agent.split("/")[0].lower()
    group = F.struct("rules", "crawl_delay")
    for_all = F.array_contains("agents", "*")
    named = F.exists("agents", lambda a: F.lit(token).contains(F.lower(a)))
    chosen = (
        robots_groups(robots).groupBy("domain")
        .agg(
            F.min_by(group, F.when(~for_all & named, F.col("group_no"))).alias("ours"),
            F.min_by(group, F.when(for_all, F.col("group_no"))).alias("any"),
        )
        .select("domain", F.coalesce("ours", "any").alias("g"))
    )
    unsafe = ~F.col("is_safe") if "is_safe" in robots.columns else F.lit(False)
    mode = (
        F.when(unsafe, "deny")
        .when(F.col("status") == 200, "rules")
        .when(F.col("status").isNull() | (F.col("status") == 404), "allow")
        .otherwise("deny")
    )
    files = robots.select("domain", mode.alias("mode"))
    ruled = F.col("mode") == "rules"
    return files.join(chosen, "domain", "left").select(
        "domain", "mode", F.when(ruled, F.col("g.rules")).alias("rules"),
        F.when(ruled, F.col("g.crawl_delay")).alias("crawl_delay"),
    )


def robots_path(url: Column | str) -> Column:
    """The part of a URL that rules are compared with."""
    tail = let(
        split_url(unquote(col(url))),
        lambda p: unsplit_url(p.withField("scheme", F.lit("")).withField("netloc", F.lit(""))),
    )
    return let(quote(tail), lambda t: F.when(t == "", F.lit("/")).otherwise(t))


def sorted_rules(rules: Column) -> Column:
    """Rules in file order as a struct of ``paths``, ascending and distinct, their least rule numbers
    ``nos`` with ``allows``, and the distinct ``lengths`` of paths."""
    numbered = F.transform(rules, lambda r, k: F.struct(r["path"].alias("path"), k.alias("no"), r["allow"].alias("allow")))

    def table(rows: Column) -> Column:
        field = lambda name: F.transform(rows, lambda r: r[name])
        return F.struct(
            field("path").alias("paths"), field("no").alias("nos"), field("allow").alias("allows"),
            F.array_sort(F.array_distinct(F.transform(rows, lambda r: F.length(r["path"])))).alias("lengths"),
        )

    least_of_each = lambda rows: F.filter(
        rows, lambda r, k: F.coalesce(F.get(rows, k - 1)["path"] != r["path"], F.lit(True)))
    return let(let(F.array_sort(numbered), least_of_each), table)


def _place(paths: Column, wanted: Column) -> Column:
    """Place of a text in an ascending array by halving, or where it would be."""
    rounds = F.ceil(F.log2(F.size(paths) + 1)).cast("int")
    ends = F.struct(F.lit(0).alias("lo"), F.size(paths).alias("hi"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["lo"] + at["hi"], 1)
        below = F.coalesce(F.get(paths, middle) < wanted, F.lit(False))
        open_ = at["lo"] < at["hi"]
        return F.struct(
            F.when(open_ & below, middle + 1).otherwise(at["lo"]).alias("lo"),
            F.when(open_ & ~below, middle).otherwise(at["hi"]).alias("hi"),
        )

    return F.aggregate(F.sequence(F.lit(0), rounds), ends, halve, lambda at: at["lo"])


def first_rule(path: Column, table: Column) -> Column:
    """``allow`` of the first rule in file order whose path starts ``path``; NULL if none does.

    Each length that a rule's path has gives one prefix to look for, found by halving: the time
    grows with the lengths and the logarithm of the rules, not with the rules.
    """
    def found(prefix: Column) -> Column:
        return let(_place(table["paths"], prefix), lambda at: F.when(
            F.get(table["paths"], at) == prefix,
            F.struct(F.get(table["nos"], at).alias("no"), F.get(table["allows"], at).alias("allow"))))

    short = F.filter(table["lengths"], lambda n: n <= F.length(path))
    hits = F.transform(short, lambda n: let(F.substring(path, F.lit(1), n), found))
    return F.array_min(F.filter(hits, lambda h: h.isNotNull()))["allow"]


def is_allowed(url: Column | str, mode: Column, table: Column) -> Column:
    """Whether a policy row lets us fetch a URL, its rules sorted; a domain without a row does."""
    decided = let(robots_path(url), lambda path: F.coalesce(first_rule(path, table), F.lit(True)))
    return F.when(mode == "deny", False).when(mode == "rules", decided).otherwise(True)


def with_robots(urls: DataFrame, policy: DataFrame, url: str = "url") -> DataFrame:
    """Add ``allowed`` and ``crawl_delay``.

    The policy has one row per domain with its rules in an array, sorted once, so a URL meets one
    row, not one per rule; the first rule whose path starts the URL's decides.
    """
    rules = policy.select(F.col("domain").alias("_domain"), "mode", sorted_rules(F.col("rules")).alias("_table"), "crawl_delay")
    joined = join_facts(urls.withColumn("_domain", domain(url)), rules, "_domain")
    return joined.withColumn("allowed", is_allowed(url, F.col("mode"), F.col("_table"))).drop("_domain", "mode", "_table")


def effective_delay(crawl_delay: Column | str = "crawl_delay", default: float = DEFAULT_DELAY) -> Column:
    """Seconds to keep between two requests to a domain."""
    return F.coalesce(col(crawl_delay).cast("double"), F.lit(default))

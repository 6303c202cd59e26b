"""Next-page links and crawl chains, as joins over a whole corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.functions.core import first, join_facts, one_per_key
from pageloom.functions.nodes import element_text
from pageloom.functions.text import strip
from pageloom.functions.urls import join_url, valid_href
from pageloom.operators.extract import links_of
from pageloom.session import cut_lineage

# What marks a next link, and the bounds of a crawl.
NEXT_TEXTS = ["next", "next >", "next »", ">>", "επόμενη"]
NEXT_WORD = "next"
DEFAULT_PAGES, MOST_PAGES = 3, 20


def _attr(e: Column, name: str) -> Column:
    return F.element_at(e["attrs"], F.lit(name))


def next_url(dom: Column, url: Column) -> Column:
    """Absolute next-page link of a page, or NULL.

    The first ``rel=next`` anchor wins if its href is usable; otherwise the first usable link,
    in document order, with "next" in its class or id, or with one of the known texts.
    """
    rel = first(F.filter(
        dom["els"],
        lambda e: (e["tag"] == "a")
        & F.coalesce(F.array_contains(F.split(_attr(e, "rel"), " "), NEXT_WORD), F.lit(False)),
    ))
    marked = first(F.filter(
        links_of(dom),
        lambda e: valid_href(_attr(e, "href")) & (
            F.lower(F.concat_ws(" ", F.concat_ws(" ", e["classes"]), _attr(e, "id"))).contains(NEXT_WORD)
            | F.lower(element_text(dom["txt"], e)).isin(NEXT_TEXTS)
        ),
    ))
    by_rel = _attr(rel, "href")
    href = F.when(valid_href(by_rel), by_rel).otherwise(_attr(marked, "href"))
    return F.when(href.isNotNull(), join_url(url, strip(href)))


def next_links(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per page with its ``next_url``. The base is the URL that was asked for."""
    return pages.select(*keys, next_url(F.col("dom"), F.col("url")).alias("next_url"))


def _jumps(steps: DataFrame) -> DataFrame:
    """``(url, target)`` twice as far as ``steps(url, target)``: one join of the table with itself."""
    onward = steps.select(F.col("url").alias("target"), F.col("target").alias("_far"))
    return join_facts(steps, onward, "target", "inner").select("url", F.col("_far").alias("target"))


def crawl_chains(seeds: DataFrame, edges: DataFrame, max_pages: int = DEFAULT_PAGES) -> DataFrame:
    """Follow next links from every URL of ``seeds(url)`` at once.

    ``edges(url, success, next_url)`` are pages; repeated URLs count once. A chain ends at ``max_pages``,
    without a next link, at a URL it has met, or at a failed page (which counts as visited).
    The result is one row per visit: seed, page_no from 1, url, success.

    Next links are a function of the URL, so tables of 1, 2, 4, 8 and 16 steps are enough: each
    is the one before joined with itself, and gives every visit so far its successor as many
    pages on. Twenty pages take five joins of the visits, not twenty. In a function's orbit
    nothing new comes after the first repeat, so a chain is the first visit of each URL.
    The tables are written to the shared folder; the loop ends once one is empty.
    """
    if not 1 <= max_pages <= MOST_PAGES:
        raise ValueError(f"max_pages must be between 1 and {MOST_PAGES}")
    # a page that was fetched again counts once: a successful fetch with a link first
    once = cut_lineage(one_per_key(
        edges.select("url", "success", "next_url"), "url", ~F.coalesce("success", F.lit(False)), F.col("next_url").isNull()))
    visits = seeds.select("url").distinct().select(F.col("url").alias("seed"), F.lit(0).alias("_at"), "url")
    # a failed page has no successor
    steps, stride = once.where("success and next_url is not null").select("url", F.col("next_url").alias("target")), 1
    while stride < max_pages:
        moved = F.struct((F.col("_at") + stride).alias("_at"), F.col("target").alias("url"))
        both = F.array(F.struct("_at", "url"), F.when(F.col("target").isNotNull() & (F.col("_at") + stride < max_pages), moved))
        visits = join_facts(visits, steps, "url").select("seed", F.explode(F.array_compact(both)).alias("_v")).select("seed", "_v.*")
        stride *= 2
        if stride < max_pages:
            steps = cut_lineage(_jumps(steps))
            if steps.isEmpty():
                break
    first_met = visits.groupBy("seed", "url").agg(F.min("_at").alias("_at"))
    known = once.select("url", F.col("success").alias("_ok"))
    return join_facts(first_met, known, "url").select(
        "seed", (F.col("_at") + 1).alias("page_no"), "url", F.coalesce("_ok", F.lit(False)).alias("success")
    )


def crawl_records(visits: DataFrame, records: DataFrame) -> DataFrame:
    """Records of all visited pages, keyed by (seed, page_no, item_no).

    ``records(url, item_no, ...)``; a page without records, because its extraction failed or
    found nothing, adds no rows and does not end its chain.
    """
    return visits.where("success").drop("success").join(records, "url", "inner")


def crawl_errors(visits: DataFrame, failed: DataFrame) -> DataFrame:
    """Visited pages whose extraction failed: ``failed(url, error)``, one error each."""
    once = one_per_key(failed.select("url", "error"), "url", F.col("error").isNull())
    return join_facts(visits.where("success").drop("success"), once, "url", "inner")

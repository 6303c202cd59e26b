"""Records out of pages by CSS rules, and links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.functions.core import first, let, let_all
from pageloom.functions.nodes import element_text
from pageloom.functions.selectors import Predicate, following, select, with_selector, with_selectors
from pageloom.functions.text import strip
from pageloom.functions.urls import URL_ATTRIBUTES, join_url

Value = Callable[[Column], Column]


def _read_field(spec: str, txt: Column, base: Column | None) -> tuple[str, Value]:
    """Selector of a field and what is read from the element it finds."""
    selector, is_attr, rest = spec.partition("::attr(")
    attr = rest.rstrip(")")

    def value(e: Column) -> Column:
        if not is_attr:
            return element_text(txt, e)
        raw = F.element_at(e["attrs"], F.lit(attr))
        if base is None or attr.lower() not in URL_ATTRIBUTES:
            return raw
        return let(raw, lambda r: F.when(r != "", join_url(base, r)).otherwise(r))

    return selector, value


def _of_first(found: Column, value: Value) -> Column:
    """``value`` of the first element found, NULL when there is none."""
    return first(F.transform(F.slice(found, 1, 1), value))


def page_records(dom: Column, container: str, fields: dict[str, str], base: Column | None = None) -> Column:
    """Array of record structs, one for each element that matches ``container``.

    Selectors are worked out once per page, before the items are visited. A field's matches
    become an array that says for each place where the next one is, so an item looks its
    own up, however large it is and however deep items nest.
    """
    els, txt = dom["els"], dom["txt"]
    parsed = {name: _read_field(spec, txt, base) for name, spec in fields.items()}
    searched = [name for name, (selector, _) in parsed.items() if selector]

    def records(tests: list[Predicate]) -> Column:
        def with_places(places: list[Column]) -> Column:
            by_name = dict(zip(searched, places))

            def inside(name: str, item: Column) -> Column:
                at = F.get(by_name[name], item["i"])
                return F.when(at <= item["last"], F.array(F.get(els, at)))

            def record(item: Column) -> Column:
                return F.struct(*[
                    (_of_first(inside(name, item), value) if selector else value(item)).alias(name)
                    for name, (selector, value) in parsed.items()
                ])

            return F.transform(F.filter(els, tests[0]), record)

        return let_all([following(F.filter(els, test)) for test in tests[1:]], with_places)

    return with_selectors([container, *[parsed[name][0] for name in searched]], els, records)


def extract_list(
    pages: DataFrame, container: str, fields: dict[str, str], base: str | None = "url",
    keys: tuple[str, ...] = ("page_id", "url"),
) -> DataFrame:
    """Repeated records: keys, ``item_no`` from 0, one string column per field.

    Records are built as an array inside the page row, so that only they, not the page,
    are copied when rows are made of them. The array goes straight into the explode: as a
    column of its own it would be computed again for a filter on its size.
    """
    records = page_records(F.col("dom"), container, fields, F.col(base) if base else None)
    return (
        pages.select(*keys, F.posexplode(records).alias("item_no", "r"))
        .select(*keys, "item_no", *[F.col("r")[name].alias(name) for name in fields])
    )


def extract_single(
    pages: DataFrame, fields: dict[str, str], base: str | None = "url",
    keys: tuple[str, ...] = ("page_id", "url"),
) -> DataFrame:
    """One record per page; NULL where nothing matches."""
    for name, spec in fields.items():
        if not spec:
            raise ValueError(f"field {name!r} needs a selector")
    dom = F.col("dom")

    def value_of(spec: str) -> Column:
        selector, value = _read_field(spec, dom["txt"], F.col(base) if base else None)
        if not selector:  # an attribute of the page itself
            return F.lit(None).cast("string")
        return with_selector(selector, dom["els"], lambda test: _of_first(F.filter(dom["els"], test), value))

    return pages.select(*keys, *[value_of(spec).alias(name) for name, spec in fields.items()])


def links_of(dom: Column) -> Column:
    """All ``a`` elements with an href, as structs in document order."""
    return F.filter(dom["els"], lambda e: (e["tag"] == "a") & F.map_contains_key(e["attrs"], F.lit("href")))


def page_links(pages: DataFrame, base: str = "url", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Every link of a page: ``link_no``, ``href`` as written, ``text``, ``target`` resolved."""
    dom = F.col("dom")
    links = F.transform(
        links_of(dom),
        lambda e: F.struct(
            F.element_at(e["attrs"], F.lit("href")).alias("href"), element_text(dom["txt"], e).alias("text")
        ),
    )
    return (
        pages.select(*keys, F.posexplode(links).alias("link_no", "l"))
        .select(*keys, "link_no", "l.href", "l.text", join_url(F.col(base), F.col("l.href")).alias("target"))
    )


def record_counts(pages: DataFrame, container: str, key: str = "page_id") -> DataFrame:
    """Number of records each page would give, 0 included; counted in the page row."""
    found = select(container, F.col("dom")["els"])
    return pages.select(key, F.size(found).cast("long").alias("record_count"))


def records_per_page(pages: DataFrame, records: DataFrame, key: str = "page_id") -> DataFrame:
    """Number of records of each page, 0 for pages without any, when the records are a table."""
    counts = records.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return pages.select(key).join(counts, key, "left").select(
        key, F.coalesce("n", F.lit(0)).cast("long").alias("record_count")
    )


def rule_rows(specs: DataFrame) -> DataFrame:
    """Field maps ``a=sel,b=sel::attr(x)`` of ``specs(rule_id, container, fields)`` as rows.

    Pieces without ``=`` are ignored; of a repeated name the first place and the last selector stay.
    """
    pairs = F.transform(F.split("fields", ","), lambda p: F.split(p, "=", 2))
    named = F.transform(
        F.filter(pairs, lambda p: F.size(p) == 2),
        lambda p: F.struct(strip(p[0]).alias("name"), strip(p[1]).alias("selector")),
    )
    last_of_each = let(named, lambda ps: F.transform(
        F.array_distinct(F.transform(ps, lambda p: p["name"])),
        lambda n: F.element_at(F.filter(ps, lambda p: p["name"] == n), -1),
    ))
    return specs.select("rule_id", "container", F.posexplode(last_of_each).alias("field_no", "f")).select(
        "rule_id", "container", "f.name", "field_no", "f.selector"
    )


def fields_of(rules: DataFrame, rule_id: str) -> tuple[str, dict[str, str]]:
    """Container and field map of one rule, to build an extraction from (a few rows)."""
    rows = rules.where(F.col("rule_id") == rule_id).orderBy("field_no").collect()
    if not rows:
        raise ValueError(f"no rule {rule_id!r}")
    return rows[0]["container"], {r["name"]: r["selector"] for r in rows}


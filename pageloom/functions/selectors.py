"""CSS selectors as Column predicates over the ``els`` array of a page.

A selector is read once on the driver; what runs on the executors is a plain Spark
expression. Supported: tag, ``*``, ``.class``, ``#id``, ``[a]``, ``[a=v]`` with ``~= |= ^= $=
*=``, ``:first-child``, ``:last-child``, ``:nth-child(n)``, ``:not(simple)``, the descendant,
``>``, ``+`` and ``~`` combinators, and ``,``. Anything else raises ``ValueError``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

from pageloom.functions.core import before, let

Predicate = Callable[[Column], Column]

_NAME = r"-?[_a-zA-Z\u0080-\uffff][\w\-]*"
_SIMPLE = re.compile(
    rf"""(?P<tag>\*|{_NAME}) | \.(?P<cls>{_NAME}) | \#(?P<id>{_NAME})
    | \[\s*(?P<attr>[\w\-:]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?P<value>"[^"]*"|'[^']*'|[^\s\]"']+)\s*)?\]
    | :(?P<pseudo>first-child|last-child) | :nth-child\(\s*(?P<nth>\d+)\s*\)
    | :not\(\s*(?P<inner>[^()]+?)\s*\)""",
    re.X,
)
_COMBINATOR = re.compile(r"\s*([>+~])\s*|(\s+)")


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


def _compound(tests: list[Predicate]) -> Predicate:
    return lambda e: _all([t(e) for t in tests])


def _attr_test(name: str, op: str | None, value: str) -> Predicate:
    name = name.lower()

    def test(e: Column) -> Column:
        have = F.element_at(e["attrs"], F.lit(name))
        want = value
        if name == "type":
            have, want = F.lower(have), value.lower()
        if op is None:
            hit = F.map_contains_key(e["attrs"], F.lit(name))
        elif op == "=":
            hit = have == want
        elif op == "^=":
            hit = have.startswith(want)
        elif op == "$=":
            hit = have.endswith(want)
        elif op == "*=":
            hit = have.contains(want)
        elif op == "|=":
            hit = (have == want) | have.startswith(want + "-")
        elif not want or re.search(r"\s", want):
            hit = F.lit(False)
        else:
            hit = F.array_contains(F.split(have, r"[ \t\r\n\f]"), F.lit(want))
        return F.coalesce(hit, F.lit(False))

    return test


def _simple(m: re.Match) -> Predicate:
    if m["tag"]:
        tag = m["tag"].lower()
        return lambda e: F.lit(True) if tag == "*" else e["tag"] == tag
    if m["cls"]:
        return lambda e: F.array_contains(e["classes"], m["cls"])
    if m["id"]:
        return lambda e: F.coalesce(F.element_at(e["attrs"], F.lit("id")) == m["id"], F.lit(False))
    if m["attr"]:
        value = m["value"] or ""
        return _attr_test(m["attr"], m["op"], value[1:-1] if value[:1] in ("'", '"') else value)
    if m["pseudo"]:
        place = "nth" if m["pseudo"] == "first-child" else "nth_last"
        return lambda e: e[place] == 1
    if m["nth"]:
        return lambda e: e["nth"] == int(m["nth"])
    inner = m["inner"]
    one = _SIMPLE.fullmatch(inner)
    if not one:
        raise ValueError(f"unsupported selector part ':not({inner})'")
    negated = _simple(one)
    return lambda e: ~negated(e)


def _read(selector: str) -> list[list[tuple[str, Predicate]]]:
    """Alternatives; each a list of (combinator before it, compound predicate)."""
    alternatives: list[list[tuple[str, Predicate]]] = []
    for text in re.split(r",(?![^\[]*\])(?![^(]*\))", selector):
        text, at, combinator, steps = text.strip(), 0, "", []
        while at < len(text):
            tests = []
            while m := _SIMPLE.match(text, at):
                if m["tag"] and tests:
                    break
                tests.append(_simple(m))
                at = m.end()
            if not tests:
                break
            steps.append((combinator, _compound(tests)))
            m = _COMBINATOR.match(text, at)
            if not m or m.end() == len(text):
                break
            combinator, at = m[1] or " ", m.end()
        if at < len(text) or not steps:
            raise ValueError(f"unsupported selector {selector!r}")
        alternatives.append(steps)
    return alternatives


def _counts_below(marks: Column) -> Column:
    """From ascending ``marks``, an array with the number of marks below each place, up to the last mark."""
    return F.flatten(F.transform(marks, lambda m, k: F.array_repeat(k, m - before(marks, k, -1))))


def _covered(found: Column) -> Column:
    """For each place of a page, whether an element there lies inside one of ``found``, in document order.

    A sweep: a place is inside if more elements begin before it than have ended before it.
    """
    starts = let(F.transform(found, lambda e: e["i"]), _counts_below)
    ends = let(F.array_sort(F.transform(found, lambda e: e["last"])), _counts_below)
    return F.zip_with(starts, ends, lambda a, b: F.coalesce(a, F.size(found)) > b)


def _first_of_families(found: Column) -> Column:
    """For each parent, at its place plus one, the least rank of its children among ``found``."""
    def spread(firsts: Column) -> Column:
        return F.flatten(F.transform(firsts, lambda x, k: F.concat(
            F.array_repeat(F.lit(None).cast("int"), x["parent"] - F.coalesce(F.get(firsts, k - 1)["parent"], F.lit(-2)) - 1),
            F.array(x["nth"]))))

    ranked = F.array_sort(F.transform(found, lambda e: F.struct(e["parent"].alias("parent"), e["nth"].alias("nth"))))
    return let(let(ranked, lambda rows: F.filter(
        rows, lambda x, k: F.coalesce(F.get(rows, k - 1)["parent"] != x["parent"], F.lit(True)))), spread)


def following(found: Column) -> Column:
    """For each place of a page the place of the next element of ``found`` after it, up to the last one."""
    return let(F.transform(found, lambda e: e["i"]), lambda at: F.flatten(
        F.transform(at, lambda m, k: F.array_repeat(m, m - before(at, k, 0)))))


def with_selector(selector: str, els: Column, body: Callable[[Predicate], Column]) -> Column:
    """``body`` gets a predicate that says whether an element matches the selector.

    What the left side of a descendant or sibling combinator allows is worked out once per
    page, as an array by place, so that each candidate is one look-up: linear in the page.
    """
    def chain(steps: list[tuple[str, Predicate]], done: Callable[[Predicate], Column]) -> Column:
        def step(k: int, allowed: Predicate | None) -> Column:
            combinator, compound = steps[k]

            def go_on(test: Predicate) -> Column:
                if k + 1 == len(steps):
                    return done(test)
                if steps[k + 1][0] in (" ", "~"):
                    by_place = _covered if steps[k + 1][0] == " " else _first_of_families
                    return let(let(F.filter(els, test), by_place), lambda places: link(k + 1, places, None))
                return link(k + 1, None, test)

            return go_on(compound if allowed is None else lambda e: compound(e) & allowed(e))

        def link(k: int, places: Column | None, test: Predicate | None) -> Column:
            combinator = steps[k][0]
            if combinator == " ":
                allowed = lambda e: F.coalesce(F.get(places, e["i"]), F.lit(False))
            elif combinator == "~":
                allowed = lambda e: F.coalesce(F.get(places, e["parent"] + 1) < e["nth"], F.lit(False))
            else:
                place = "parent" if combinator == ">" else "prev"
                allowed = lambda e: F.coalesce(let(F.get(els, e[place]), test), F.lit(False))
            return step(k, allowed)

        return step(0, None)

    def any_of(rest: list, tests: list[Predicate]) -> Column:
        if not rest:
            return body(lambda e: reduce(lambda a, b: a | b, [t(e) for t in tests]))
        return chain(rest[0], lambda test: any_of(rest[1:], [*tests, test]))

    return any_of(_read(selector), [])


def select(selector: str, els: Column) -> Column:
    """All matching elements of a page, in document order."""
    return with_selector(selector, els, lambda test: F.filter(els, test))


def with_selectors(
    selectors: list[str], els: Column, body: Callable[[list[Predicate]], Column]
) -> Column:
    """Like ``with_selector`` for several selectors, all bound before ``body`` runs."""
    def bind(rest: list[str], tests: list[Predicate]) -> Column:
        if not rest:
            return body(tests)
        return with_selector(rest[0], els, lambda test: bind(rest[1:], [*tests, test]))

    return bind(selectors, [])

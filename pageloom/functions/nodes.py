"""Expressions over the ``dom`` column: element text, clean text, sanitized HTML."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pageloom.functions import text
from pageloom.functions.core import col, let
from pageloom.operators.dom import HIDDEN_TEXT_TAGS, MULTI_VALUED, VOID_TAGS

# An attribute goes when its name or its value starts like this.
UNSAFE_ATTRIBUTE = r"(?iU)^(?:on\w|javascript:|data:)"

_ESCAPE, _BREAK = "\x01:", "\x01;"


def element_text(txt: Column, e: Column) -> Column:
    """Stripped text pieces of an element, joined without a separator."""
    own = F.when(e["tag"].isin(HIDDEN_TEXT_TAGS), e["tag"]).otherwise(F.lit(""))
    inside = F.slice(txt, e["t0"] + 1, e["tn"])
    pieces = F.filter(inside, lambda t: (t["kind"] == own) | ((own == "") & (t["kind"] == "cdata")))
    return F.array_join(F.transform(pieces, lambda t: text.strip(t["s"])), "")


def clean_text(dom: Column | str, max_length: int | None = text.MAX_TEXT) -> Column:
    """Readable text of a page without its unsafe tags.

    Texts that only a removed tag kept apart form one run. Runs are joined into one string
    with a break mark, split, stripped, and joined by a blank: linear in the page, and exact
    because the mark's first character is escaped inside texts.
    """
    dom = col(dom)
    shown = F.filter(dom["txt"], lambda t: t["live"] & t["kind"].isin("", "cdata"))
    marked = F.transform(
        shown,
        lambda t: F.concat(
            F.when(t["glued"], F.lit("")).otherwise(F.lit(_BREAK)), F.replace(t["s"], F.lit("\x01"), F.lit(_ESCAPE))
        ),
    )
    runs = F.transform(
        F.split(F.array_join(marked, ""), _BREAK),
        lambda r: text.strip(F.replace(r, F.lit(_ESCAPE), F.lit("\x01"))),
    )
    joined = F.array_join(F.filter(runs, lambda r: r != ""), " ")
    return text.truncate(text.normalize_blanks(text.strip_invisible(joined)), max_length)


def _multi_valued(e: Column, key: Column) -> Column:
    hit = key.isin(MULTI_VALUED["*"])
    for tag, names in MULTI_VALUED.items():
        if tag != "*":
            hit = hit | ((e["tag"] == tag) & key.isin(names))
    return hit


def safe_attributes(e: Column) -> Column:
    """Attributes of an element without handlers, script and data links.

    The value test covers single-valued attributes only, whatever their name.
    """
    return F.map_filter(
        e["attrs"],
        lambda k, v: ~(k.rlike(UNSAFE_ATTRIBUTE) | (v.rlike(UNSAFE_ATTRIBUTE) & ~_multi_valued(e, k))),
    )


def safe_elements(dom: Column | str, remove_images: bool = False) -> Column:
    """Elements that stay after sanitizing, with their attributes cleaned."""
    dom = col(dom)

    def clean(keep: Column) -> Column:
        return F.transform(keep, lambda e: e.withField("attrs", safe_attributes(e)))

    live = F.filter(dom["els"], lambda e: e["live"])
    if not remove_images:
        return clean(live)
    return let(
        _open_images(live),
        lambda imgs: clean(F.filter(live, lambda e: (e["tag"] != "img") & ~_inside(imgs, e["pos"]))),
    )


def _open_images(elements: Column) -> Column:
    """Images with something inside: those left open in the markup. Others are dropped by their tag alone."""
    return F.filter(elements, lambda e: (e["tag"] == "img") & (e["stop"] > e["pos"]))


def _inside(elements: Column, pos: Column) -> Column:
    return F.exists(elements, lambda a: (a["pos"] <= pos) & (a["stop"] >= pos))


def _escape(s: Column) -> Column:
    return F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def _quoted(value: Column) -> Column:
    v = _escape(value)
    double, single = F.instr(v, '"') > 0, F.instr(v, "'") > 0
    return (
        F.when(double & ~single, F.concat(F.lit("'"), v, F.lit("'")))
        .otherwise(F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit("&quot;")), F.lit('"')))
    )


def _start_tag(e: Column) -> Column:
    names = F.array_sort(F.map_keys(e["attrs"]))
    attrs = F.transform(
        names, lambda k: F.concat(F.lit(" "), k, F.lit("="), _quoted(F.element_at(e["attrs"], k)))
    )
    slash = F.when(e["tag"].isin(sorted(VOID_TAGS)) & (e["stop"] == e["pos"]), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("<"), e["tag"], F.array_join(attrs, ""), slash, F.lit(">"))


def _token(at: Column, after: int, order: Column, s: Column) -> Column:
    return F.struct(at.alias("at"), F.lit(after).alias("after"), order.alias("order"), s.alias("s"))


def sanitized_html(dom: Column | str, remove_images: bool = False) -> Column:
    """Page written back as HTML, without unsafe tags and attributes."""
    dom = col(dom)

    def write(els: Column) -> Column:
        starts = F.transform(els, lambda e: _token(e["pos"], 0, F.lit(0), _start_tag(e)))
        closed = F.filter(els, lambda e: ~e["tag"].isin(sorted(VOID_TAGS)) | (e["stop"] > e["pos"]))
        ends = F.transform(
            closed, lambda e: _token(e["stop"], 1, -e["pos"], F.concat(F.lit("</"), e["tag"], F.lit(">")))
        )
        texts = F.transform(
            kept(dom["txt"]),
            lambda t: _token(
                t["pos"], 0, F.lit(0),
                F.when(t["kind"] == "cdata", F.concat(F.lit("<![CDATA["), t["s"], F.lit("]]>")))
                .otherwise(_escape(t["s"])),
            ),
        )
        others = F.transform(
            kept(dom["other"]),
            lambda o: _token(
                o["pos"], 0, F.lit(0),
                F.when(o["kind"] == "comment", F.concat(F.lit("<!--"), o["s"], F.lit("-->")))
                .when(o["kind"] == "doctype", F.concat(F.lit("<!DOCTYPE "), o["s"], F.lit(">\n")))
                .when(o["kind"] == "pi", F.concat(F.lit("<?"), o["s"], F.lit(">")))
                .otherwise(F.concat(F.lit("<?"), o["s"], F.lit("?>"))),
            ),
        )
        tokens = F.array_sort(F.concat(starts, ends, texts, others))
        return F.array_join(F.transform(tokens, lambda t: t["s"]), "")

    def kept(nodes: Column) -> Column:
        live = F.filter(nodes, lambda n: n["live"])
        if not remove_images:
            return live
        return let(_open_images(dom["els"]), lambda found: F.filter(live, lambda n: ~_inside(found, n["pos"])))

    return let(safe_elements(dom, remove_images), write)

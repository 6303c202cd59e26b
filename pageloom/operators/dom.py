"""Parse page HTML once into a node column that Spark expressions can query.

The parse is the only Python step of the engine: an Arrow batch of HTML goes in, a batch
of ``dom`` structs comes out, and everything later stays in the JVM. Elements are numbered
in document order, so the subtree of element ``i`` is the slice ``els[i .. last]`` and its
texts are the slice ``txt[t0 .. t0 + tn)``.
"""

from __future__ import annotations

import gc
import re
from collections import Counter
from collections.abc import Iterator
from html.entities import name2codepoint
from html.parser import HTMLParser
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from pageloom.functions.core import col
from pageloom.session import ship_by_value

ship_by_value(__name__)

# Tags removed with their content.
UNSAFE_TAGS = [
    "script", "style", "iframe", "object", "embed", "applet",
    "noscript", "form", "svg", "canvas", "meta", "link",
]
# Elements that never have content.
VOID_TAGS = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen "
    "link menuitem meta nextid param source spacer track wbr".split()
)
# Elements whose own strings are not page text.
HIDDEN_TEXT_TAGS = ["rt", "rp", "style", "script", "template"]
# Elements in which blank text is kept as written.
KEEP_BLANK_TAGS = frozenset(["pre", "textarea"])
# Attributes that hold several blank-separated values, by tag.
MULTI_VALUED = {
    "*": ["class", "accesskey", "dropzone"],
    "a": ["rel", "rev"], "link": ["rel", "rev"], "td": ["headers"], "th": ["headers"],
    "form": ["accept-charset"], "object": ["archive"], "area": ["rel"], "icon": ["sizes"],
    "iframe": ["sandbox"], "output": ["for"],
}

DOM_SCHEMA = (
    "struct<"
    "els:array<struct<i:int,last:int,parent:int,prev:int,nth:int,nth_last:int,pos:int,stop:int,"
    "t0:int,tn:int,live:boolean,tag:string,classes:array<string>,attrs:map<string,string>>>,"
    "txt:array<struct<pos:int,live:boolean,glued:boolean,kind:string,s:string>>,"
    "other:array<struct<pos:int,live:boolean,kind:string,s:string>>>"
)

_INT, _BOOL, _STR = pa.int32(), pa.bool_(), pa.string()
_EL_FIELDS = [
    *((name, _INT) for name in ("i", "last", "parent", "prev", "nth", "nth_last", "pos", "stop", "t0", "tn")),
    ("live", _BOOL), ("tag", _STR), ("classes", pa.list_(_STR)), ("attrs", pa.map_(_STR, _STR)),
]
_TXT_FIELDS = [("pos", _INT), ("live", _BOOL), ("glued", _BOOL), ("kind", _STR), ("s", _STR)]
_OTHER_FIELDS = [("pos", _INT), ("live", _BOOL), ("kind", _STR), ("s", _STR)]
_I, _LAST, _, _, _NTH, _NTH_LAST, _, _STOP, _T0, _TN, _LIVE, _TAG, _, _ = range(14)

_RUN_PAGES, _RUN_BYTES = 128, 1 << 20  # pages parsed before their nodes are handed on
_ASCII_BLANKS = " \n\t\f\r"
_UNSAFE = frozenset(UNSAFE_TAGS)
_HIDDEN = frozenset(HIDDEN_TEXT_TAGS)
_MULTI = {tag: frozenset([*MULTI_VALUED["*"], *names]) for tag, names in MULTI_VALUED.items()}
_WORDS = re.compile(r"\S+")
# What windows-1252 leaves undefined, written by page authors as numbers.
_UNDEFINED_1252 = frozenset((0x81, 0x8D, 0x8F, 0x90, 0x9D))


def _number_to_char(ref: str) -> str:
    """Character of a numeric reference; below 256 it is read as windows-1252."""
    code = int(ref[1:], 16) if ref[:1] in "xX" else int(ref)
    if code < 256 and code not in _UNDEFINED_1252:
        return bytes([code]).decode("windows-1252")
    try:
        return chr(code)
    except (ValueError, OverflowError):
        return "\ufffd"


class _PageReader(HTMLParser):
    """Turns one page's markup events into rows of elements, texts and other nodes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.els: list[list] = []
        self.txt: list[tuple] = []
        self.other: list[tuple] = []
        self.pos = 0
        self.open: list[list] = []  # rows of open elements, outermost first
        self.open_tags: Counter = Counter()
        self.closed_voids: Counter = Counter()
        self.families: dict[int, list[list]] = {}  # parent -> rows of its children
        self.unsafe_depth = self.keep_depth = 0
        self.hidden: list[list] = []
        self.pieces: list[str] = []
        self.broken = True  # live markup lies between here and the last live text

    def updatepos(self, i, j):  # line numbers are not needed
        return j

    def _flush(self) -> None:
        if not self.pieces:
            return
        s = "".join(self.pieces)
        self.pieces = []
        self._text(self.hidden[-1][_TAG] if self.hidden else "", s)

    def _squash(self, s: str) -> str:
        if self.keep_depth or s.strip(_ASCII_BLANKS):
            return s
        return "\n" if "\n" in s else " "

    def _text(self, kind: str, s: str) -> None:
        live = not self.unsafe_depth
        self.txt.append((self.pos, live, live and not self.broken, kind, self._squash(s)))
        self.pos += 1
        if live:
            self.broken = False

    def _other(self, kind: str, s: str) -> None:
        self._flush()
        live = not self.unsafe_depth
        self.other.append((self.pos, live, kind, self._squash(s)))
        self.pos += 1
        self.broken = self.broken or live

    def _push(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._flush()
        if tag in _UNSAFE:
            self.unsafe_depth += 1
        if tag in KEEP_BLANK_TAGS:
            self.keep_depth += 1
        live = not self.unsafe_depth
        if live:
            self.broken = True
        values: dict[str, str] = {}
        classes: list[str] = []
        if attrs:
            multi = _MULTI.get(tag, _MULTI["*"])
            for key, value in attrs:
                if key in multi and value:
                    words = _WORDS.findall(value)
                    value = " ".join(words)
                    if key == "class":
                        classes = words
                values[key] = value or ""
        i = len(self.els)
        parent = self.open[-1][_I] if self.open else -1
        family = self.families.setdefault(parent, [])
        row = [
            i, i, parent, family[-1][_I] if family else -1, len(family) + 1, 0,
            self.pos, self.pos, len(self.txt), 0, live, tag, classes, values,
        ]
        self.pos += 1
        family.append(row)
        self.els.append(row)
        self.open.append(row)
        self.open_tags[tag] += 1
        if tag in _HIDDEN:
            self.hidden.append(row)

    def _pop(self) -> str:
        row = self.open.pop()
        tag = row[_TAG]
        self.open_tags[tag] -= 1
        row[_LAST] = len(self.els) - 1
        row[_STOP] = self.pos - 1
        row[_TN] = len(self.txt) - row[_T0]
        if row[_LIVE]:
            self.broken = True
        if tag in _UNSAFE:
            self.unsafe_depth -= 1
        if tag in KEEP_BLANK_TAGS:
            self.keep_depth -= 1
        if self.hidden and self.hidden[-1] is row:
            self.hidden.pop()
        return tag

    def _close(self, tag: str) -> None:
        self._flush()
        if self.open_tags[tag]:
            while self._pop() != tag:
                pass

    def finish(self) -> None:
        self.close()
        self._flush()
        while self.open:
            self._pop()
        for family in self.families.values():
            n = len(family)
            for row in family:
                row[_NTH_LAST] = n - row[_NTH] + 1

    # markup events

    def handle_starttag(self, tag, attrs):
        self._push(tag, attrs)
        if tag in VOID_TAGS:
            self._pop()
            self.closed_voids[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self._push(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.closed_voids[tag]:
            self.closed_voids[tag] -= 1
        else:
            self._close(tag)

    def handle_data(self, data):
        self.pieces.append(data)

    def handle_charref(self, name):
        self.pieces.append(_number_to_char(name))

    def handle_entityref(self, name):
        code = name2codepoint.get(name)
        self.pieces.append("&" + name if code is None else chr(code))

    def handle_comment(self, data):
        self._other("comment", data)

    def handle_decl(self, decl):
        self._other("doctype", decl[len("DOCTYPE "):])

    def handle_pi(self, data):
        self._other("pi", data)

    def unknown_decl(self, data):
        if data.upper().startswith("CDATA["):
            self._flush()
            self.broken = self.broken or not self.unsafe_depth
            self._text("cdata", data[len("CDATA["):])
            self.broken = self.broken or not self.unsafe_depth
        else:
            self._other("decl", data)


def _list_array(pages: list[list], fields: list[tuple[str, pa.DataType]]) -> pa.Array:
    """Rows of all pages as one list-of-struct array, built column by column."""
    rows = [row for page in pages for row in page]
    columns = list(zip(*rows)) or [()] * len(fields)
    arrays = []
    for (name, kind), values in zip(fields, columns):
        if pa.types.is_map(kind):
            arrays.append(pa.MapArray.from_arrays(
                _ends(values),
                pa.array([k for v in values for k in v], pa.string()),
                pa.array([x for v in values for x in v.values()], pa.string()),
            ))
        elif pa.types.is_list(kind):
            arrays.append(pa.ListArray.from_arrays(
                _ends(values), pa.array([x for v in values for x in v], pa.string())
            ))
        else:
            arrays.append(pa.array(values, kind))
    return pa.ListArray.from_arrays(_ends(pages), pa.StructArray.from_arrays(arrays, [n for n, _ in fields]))


def _ends(groups) -> pa.Array:
    return pa.array(list(accumulate(map(len, groups), initial=0)), pa.int32())


def _read_page(html: str) -> _PageReader | None:
    reader = _PageReader()
    try:
        reader.feed(html)
        reader.finish()
    except AssertionError:  # markup the parser refuses
        return None
    return reader


def _read_pages(html: list[str | None]) -> pa.Array:
    pages = [_read_page(page or "") for page in html]
    return pa.StructArray.from_arrays(
        [
            _list_array([p.els if p else [] for p in pages], _EL_FIELDS),
            _list_array([p.txt if p else [] for p in pages], _TXT_FIELDS),
            _list_array([p.other if p else [] for p in pages], _OTHER_FIELDS),
        ],
        ["els", "txt", "other"],
        mask=pa.array([p is None for p in pages], pa.bool_()),
    )


def _runs(html: pa.Array) -> Iterator[pa.Array]:
    """Runs of whole pages: of ``_RUN_PAGES`` and ``_RUN_BYTES`` at most, or one page."""
    stops = np.cumsum(pc.fill_null(pc.binary_length(html), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = done = 0
    while at < len(html):
        stop = int(np.searchsorted(stops, done + _RUN_BYTES, side="right"))
        stop = min(max(stop, at + 1), at + _RUN_PAGES, len(html))
        yield html.slice(at, stop - at)
        at, done = stop, int(stops[stop - 1])


def _read_batch(html: pa.Array) -> Iterator[pa.Array]:
    """Parse run by run and hand each on at once, so that few nodes live at a time, whatever a batch holds."""
    for run in _runs(html):
        gc.disable()  # node rows hold no cycles; collection passes would cost a third of the time
        try:
            dom = _read_pages(run.to_pylist())
        finally:
            gc.enable()
        yield dom
        del dom


def parse_html(html: Column | str) -> Column:
    """``dom`` column of an HTML column; NULL for markup the parser refuses."""
    @F.arrow_udf(DOM_SCHEMA)
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from _read_batch(batch)

    # Marked so that the optimizer never parses twice by moving the call into a filter.
    return parse.asNondeterministic()(col(html))


def with_dom(pages: DataFrame, html: str = "html", dom: str = "dom") -> DataFrame:
    """Add the node column. Filter pages before this step; drop ``html`` after it if unused."""
    return pages.withColumn(dom, parse_html(html))


def page_elements(pages: DataFrame) -> DataFrame:
    """One row per element of every page, with its place in the tree."""
    e = F.col("e")
    return (
        pages.select("page_id", F.explode("dom.els").alias("e"))
        .select("page_id", e.i.alias("element_no"), e.parent.alias("parent_no"), e.tag.alias("tag"),
                e.classes.alias("classes"), e.attrs.alias("attrs"))
    )

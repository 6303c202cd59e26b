"""The charset of a saved page, and its text: one look at the bytes of each file.

Checked in order: a byte-order mark, the charset of a recorded header, a ``meta`` tag among the
first bytes, then the bytes themselves. Bytes that are UTF-8 are taken as that; else each
candidate that can decode them is judged by the letters that it gives.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from pageloom.functions.core import col
from pageloom.session import ship_by_value

ship_by_value(__name__)

# Byte-order marks, how far a meta tag is looked for, labels that mean another charset.
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"),
         (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
META_BYTES = 1024
SAME_AS = {"iso8859-1": "cp1252", "latin-1": "cp1252", "ascii": "cp1252", "shift_jis": "cp932", "gb2312": "gb18030", "gbk": "gb18030", "euc_kr": "cp949",
           "iso8859-9": "cp1254"}
#: Charsets that bytes are judged by, in order of preference among equals.
CANDIDATES = ("cp1252", "cp1251", "iso8859-7", "cp1250", "cp932", "euc_jp", "gb18030", "big5", "cp949")
JUDGED_BYTES = 65_536
FALLBACK = "cp1252"

DECODED = "struct<charset: string, found_by: string, html: string>"

_META = re.compile(rb"<meta[^>]*?charset\s*=\s*[\"']?\s*([\w.:+-]+)", re.I)
_HEADER = re.compile(r"charset\s*=\s*[\"']?\s*([\w.:+-]+)", re.I)


def known(label: str) -> str | None:
    """Codec of a charset label; NULL for one that isn't known."""
    try:
        info = codecs.lookup(label.strip())
    except (LookupError, ValueError):
        return None
    if not getattr(info, "_is_text_encoding", True):
        return None
    return SAME_AS.get(info.name, info.name)


def _script(c: str) -> str:
    """First word of a letter's name; those that are written together count as one script."""
    name = unicodedata.name(c, "?").split()[0].split("-")[0]
    return "EAST" if name in ("CJK", "HIRAGANA", "KATAKANA") else name


def _liking(text: str) -> float:
    """How much a text looks like writing: share of its letters beyond ASCII that stand beside one of their own
    script and in the middle or at the start of a word, less what no page would hold."""
    counts: Counter = Counter()
    before = " "
    for c in text:
        if c >= "\x80":
            kind = unicodedata.category(c)
            if kind[0] == "L":
                script, name = _script(c), unicodedata.name(c, "?")
                counts["letter"] += 1
                beside = before.isalpha() and (before < "\x80" if script == "LATIN" else _script(before) == script)
                # a capital inside a word, or a rare script for single letters, speaks against the charset
                counts["good"] += beside and not (kind == "Lu" and before.islower())
                counts["bad"] += kind == "Lu" and before.islower()
                counts["kana"] += name.startswith(("HIRAGANA", "KATAKANA"))
                counts["half"] += "HALFWIDTH" in name
            else:
                counts["odd"] += kind in ("Cc", "Cn", "Co", "So", "Sm", "Sc", "Sk")
        before = c
    total = max(counts["letter"] + counts["odd"], 1)
    return (counts["good"] + 0.5 * counts["kana"] - 2 * counts["bad"] - 2 * counts["odd"] - 2 * counts["half"]) / total


def judged(content: bytes) -> str:
    """Charset by the bytes: UTF-8 if they are, else the candidate with the likeliest letters."""
    try:
        content.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        pass
    part, best = content[:JUDGED_BYTES], (float("-inf"), FALLBACK)
    for name in CANDIDATES:
        try:
            # the end of the part may cut a character
            text = codecs.getincrementaldecoder(name)("strict").decode(part, final=len(part) == len(content))
        except UnicodeDecodeError:
            continue
        score = _liking(text)
        if score > best[0] + 1e-9:
            best = (score, name)
    return best[1]


def decoded(content: bytes | None, header: str | None) -> tuple[str | None, str | None, str | None]:
    """Charset, what it was found by, and the text; bytes that the charset doesn't have become U+FFFD."""
    if content is None:
        return None, None, None
    content = bytes(content)
    for mark, name in MARKS:
        if content.startswith(mark):
            return name, "mark", content[len(mark):].decode(name, "replace")
    found = _HEADER.search(header or "")
    name = known(found[1]) if found else None
    if name:
        return name, "header", content.decode(name, "replace")
    meta = _META.search(content[:META_BYTES])
    name = known(meta[1].decode("ascii", "replace")) if meta else None
    if name:
        # bytes in which a tag could be read aren't UTF-16
        name = "utf-8" if name.startswith(("utf-16", "utf-32")) else name
        return name, "meta", content.decode(name, "replace")
    name = judged(content)
    return name, "bytes", content.decode(name, "replace")


def decode_page(content: Column | str, header: Column | str) -> Column:
    """``struct<charset, found_by, html>`` of the bytes of a page and the content type that its server named, or NULL."""

    def run(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for contents, headers in columns:
            rows = [decoded(c.as_py(), h.as_py()) for c, h in zip(contents, headers)]
            yield pa.StructArray.from_arrays(
                [pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["charset", "found_by", "html"])

    run.__annotations__ = {"columns": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return arrow_udf(run, returnType=DECODED).asNondeterministic()(col(content), col(header))

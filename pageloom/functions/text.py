"""Text expressions: blanks, invisible characters, length caps, card masking."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pageloom.functions.core import col, let

# The characters str.strip() treats as blank.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Invisible characters, the card pattern, its mask, the cut marker, the cap.
INVISIBLE = r"[\u200B-\u200D\uFEFF\u0000-\u0008\u000B\u000C\u000E-\u001F]"
CARD = r"\b(?:\d[ -]*?){13,16}\b"
CARD_MASK = "[REDACTED_CREDIT_CARD]"
CUT_MARK = "... [TRUNCATED]"
MAX_TEXT = 100_000


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(BLANKS))


def is_blank(c: Column | str) -> Column:
    """True for NULL, empty and all-blank text."""
    return strip(F.coalesce(col(c), F.lit(""))) == ""


def strip_invisible(c: Column | str) -> Column:
    return F.regexp_replace(col(c), INVISIBLE, "")


def normalize_blanks(c: Column | str) -> Column:
    one_blank = F.regexp_replace(col(c), r"[ \t]+", " ")
    return strip(F.regexp_replace(one_blank, r"\n+", "\n"))


def truncate(c: Column | str, max_length: int | None = MAX_TEXT) -> Column:
    if not max_length:
        return col(c)
    return _cut(col(c), max_length, CUT_MARK)


def _cut(c: Column, n: int, mark: str) -> Column:
    return let(c, lambda t: F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n)), F.lit(mark))).otherwise(t))


def preview(c: Column | str, n: int = 500) -> Column:
    """First ``n`` characters, with dots where something was cut."""
    return _cut(col(c), n, "...")


def redact_cards(c: Column | str) -> Column:
    """Mask runs of 13 to 16 digits, blanks and dashes between them allowed."""
    return F.regexp_replace(col(c), "(?U)" + CARD, CARD_MASK)


def model_text(c: Column | str, max_length: int = MAX_TEXT) -> Column:
    """The part of a text that is given to a model."""
    return F.left(col(c), F.lit(max_length))

"""Secrets in texts, with DataFrame functions only.

Three fixed kinds are found by pattern. The fourth, ``entropy``, looks at every long string: a
window slides over it, and as one character enters and one leaves, the sum of ``c * log2(c)`` over
the counts of characters is brought up to date from the counts of these two; the Shannon entropy
of the window follows from it. Each class of characters has its own threshold, and a run of hex characters between separators
has that of hex strings in whatever string it is; strings of the allow-list stay silent.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.functions.core import let

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run is taken from its first character or not at all, so that the patterns are tried once per run.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")
LEAST_ASSIGNED = 8

WINDOW = 20
CANDIDATE = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}"
#: Character classes, narrowest first, and the bits per character that a window of one must reach.
CLASSES = (("^[0-9a-fA-F]+$", 3.0), ("^[A-Za-z0-9+/=]+$", 3.8), ("^[A-Za-z0-9_-]+$", 3.8), ("", 3.8))
#: Each character of a hex run of a window at least that separators, or the ends of the string, set apart from words.
#: What follows the first four groups of a UUID belongs to an identifier and is judged with its whole string.
HEX_RUN = r"(?:(?<![A-Za-z0-9])(?<![0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-)(?=[0-9a-fA-F]{20,}(?![A-Za-z0-9]))|(?!^)\G)[0-9a-fA-F]"
#: Strings that are never reported for their entropy: words joined by separators, and UUIDs.
ALLOWED = (
    r"^[-_/+=]*[A-Za-z][-_/+=A-Za-z]*$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9=_/+-]+$",
)

SPANS = "array<struct<start: int, kind: int, end: int>>"


#: Lengths summed one after the other; longer lists are summed block by block.
_RUN = 256


def _none() -> Column:
    return F.array().cast(SPANS)


def _running(lengths: Column) -> Column:
    """Sums of a list that isn't empty, up to and with each element: within blocks, from the sum of the blocks before."""

    def sums(block: Column, first: Column) -> Column:
        empty = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"] + n).alias("out"))
        return F.aggregate(block, empty, step, lambda acc: acc["out"])

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, n: acc + n))
        return let(sums(totals, F.lit(0)), lambda ends: F.flatten(
            F.transform(blocks, lambda b, k: sums(b, F.coalesce(F.get(ends, k - 1), F.lit(0))))))

    places = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _RUN).cast("int"))
    return let(F.transform(places, lambda b: F.slice(lengths, b * _RUN + 1, F.lit(_RUN))), joined)


def _places(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans of the matches of a pattern: the texts between them say where they are."""

    def spans(gaps: Column) -> Column:
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(gaps) - 1), hits, lambda g, h: F.struct(
            F.char_length(g).alias("gap"), F.char_length(h).alias("hit")))

        def placed(pairs: Column) -> Column:
            ends = let(F.transform(pairs, lambda p: p["gap"] + p["hit"]), _running)
            return F.zip_with(pairs, ends, lambda p, end: F.struct(
                (end - p["hit"]).alias("start"), F.lit(kind).alias("kind"), end.alias("end")))

        found = let(sizes, placed)
        return F.when(F.size(gaps) < 2, _none()).otherwise(keep(found) if keep else found)

    return let(F.split(text, pattern, -1), spans)


def _assigned(text: Column) -> Column:
    def long_enough(found: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
        marked = F.zip_with(found, values, lambda s, v: F.when(F.char_length(v) >= LEAST_ASSIGNED, s))
        return F.filter(marked, lambda s: s.isNotNull())

    return _places(text, ASSIGN, 0, long_enough)


def _weight(count: Column) -> Column:
    """``c * log2(c)``, from a constant table."""
    return F.get(F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)]), count)


def hot_window(string: Column, least: Column) -> Column:
    """``struct<first, last>``: starts of the first and last window whose entropy reaches its threshold, null if none does.

    The threshold is ``least``, that of the string's class, or that of hex strings for a window in a
    hex run (``HEX_RUN``) with a letter in it: digits alone are mostly a number. ``hex`` and ``digits`` say
    how many of a run and of digits came last.
    """

    def scan(codes: Column, runs: Column) -> Column:
        empty = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("hex"), F.lit(0).alias("digits"),
                         F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))

        def step(acc: Column, i: Column) -> Column:
            entering, full = F.get(codes, i), i >= WINDOW
            # the characters of the window before, and the one that enters
            near = F.slice(codes, F.greatest(i - WINDOW, F.lit(0)) + 1, F.least(i, F.lit(WINDOW)) + 1)
            number = lambda code: F.size(F.filter(near, lambda c: c == code))
            plus = let(number(entering), lambda n: _weight(n) - _weight(n - 1))
            minus = F.when(full, let(number(F.get(codes, i - WINDOW)), lambda n: _weight(n) - _weight(n - 1))).otherwise(F.lit(0.0))
            digit = entering.between(ord("0"), ord("9"))
            in_hex = F.get(runs, i) == "!"
            return F.struct((acc["sum"] + plus - minus).alias("sum"),
                            F.when(in_hex, acc["hex"] + 1).otherwise(F.lit(0)).alias("hex"),
                            F.when(digit, acc["digits"] + 1).otherwise(F.lit(0)).alias("digits"), acc["first"].alias("first"), acc["last"].alias("last"), i.alias("i"))

        def judged(acc: Column, i: Column) -> Column:
            return let(step(acc, i), lambda now: F.struct(
                now["sum"].alias("sum"), now["hex"].alias("hex"), now["digits"].alias("digits"),
                F.when(hot(now), F.coalesce(now["first"], now["i"] - (WINDOW - 1))).otherwise(now["first"]).alias("first"),
                F.when(hot(now), now["i"] - (WINDOW - 1)).otherwise(now["last"]).alias("last")))

        def hot(now: Column) -> Column:
            in_hex = (now["hex"] >= WINDOW) & (now["digits"] < WINDOW)
            bits = F.when(in_hex, F.least(F.lit(CLASSES[0][1]), least)).otherwise(least)
            return (now["i"] >= WINDOW - 1) & (F.lit(math.log2(WINDOW)) - now["sum"] / WINDOW >= bits)

        places = F.sequence(F.lit(0), F.size(codes) - 1)
        return F.aggregate(places, empty, judged, lambda acc: F.when(acc["first"].isNotNull(), F.struct(acc["first"].alias("first"), acc["last"].alias("last"))))

    marked = F.split(F.regexp_replace(string, HEX_RUN, "!"), "")  # of the same length
    return let(F.transform(F.split(string, ""), lambda c: F.ascii(c)), lambda codes: let(marked, lambda runs: scan(codes, runs)))


def _random(text: Column) -> Column:
    """Spans of strings whose windows are as mixed as random ones."""

    def windows(found: Column) -> Column:
        strings = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
        least = lambda s: F.coalesce(*[F.when(s.rlike(p), F.lit(bits)) for p, bits in CLASSES])
        allowed = lambda s: F.array_contains(F.array(*[s.rlike(p) for p in ALLOWED]), True)

        def judged(span: Column, s: Column) -> Column:
            mixed = let(least(s), lambda bits: hot_window(s, bits))
            return let(F.when(~allowed(s), mixed), lambda w: F.when(w.isNotNull(), F.struct(
                (span["start"] + w["first"]).alias("start"), F.lit(3).alias("kind"), (span["start"] + w["last"] + WINDOW).alias("end"))))

        return F.filter(F.zip_with(found, strings, judged), lambda s: s.isNotNull())

    return _places(text, CANDIDATE, 3, windows)


def secret_spans(text: Column | str = "text") -> Column:
    """All spans of a text, ordered by start, then kind: ``array<struct<start, kind, end>>``.

    ``kind`` is a place in ``KINDS``; places in the text count code points, the end isn't part of
    the span. An ``assign`` span is the whole match, name and value. A null text has no spans.
    """
    whole = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return let(whole, lambda t: F.array_sort(F.concat(
        _assigned(t), _places(t, ACCESS, 1), _places(t, HEX, 2), _random(t))))


def written(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy)`` for each row of ``docs(doc_id, text)``.

    Null and empty texts have no spans; repeated rows each get their line; other columns aren't read.
    """
    found = docs.select("doc_id", secret_spans(F.col("text").cast("string")).alias("found"))

    def number(kind: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{KINDS[kind]}")

    base = F.filter("found", lambda s: s["kind"] < 3)
    return found.select("doc_id", *map(number, range(3)), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"), number(3))

"""Words of whole Arrow batches of texts, found and hashed with numpy; runs inside Spark tasks.

A text is taken as its UTF-8 bytes. A byte table says which bytes belong to words and lowers
A-Z; word hashes are polynomials over the lowered bytes modulo 2^64, so that any slice is
hashed from two prefix sums. Memory is bounded by working on runs of whole texts of
``CHUNK_BYTES`` at most (one text, if it is longer).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pageloom.session import ship_by_value

ship_by_value(__name__)

CHUNK_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def byte_table(is_word) -> np.ndarray:
    """Lowered byte plus 1 for each byte of a word, 0 for separators. ``is_word`` is asked about lowered bytes."""
    low = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
    return np.array([b + 1 if is_word(b) else 0 for b in low], dtype=np.uint16)


def spaced_words() -> np.ndarray:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lowered."""
    return byte_table(lambda b: b != 32 and not 9 <= b <= 13)


def plain_words() -> np.ndarray:
    """Words of digits, a-z and everything beyond ASCII, A-Z lowered."""
    return byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Texts(NamedTuple):
    """Bytes of some texts, one after the other, and where each begins."""

    first_row: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def text_chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Runs of whole texts; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64, count=n + 1, offset=8 * column.offset)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), n, row + 200_000)
        yield Texts(row, data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row])
        row = stop


class Words(NamedTuple):
    """Words in order: byte slices, row within the chunk, and 64-bit hash."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray


class Hasher:
    """Powers of the base, grown as chunks need them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums of ``data[i] * base^i``; data of any unsigned type."""
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(data * self.up[:len(data)], dtype=np.uint64, out=out[1:])
        return out

    def slices(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start])


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of ``inside`` that stays within a row."""
    n = len(inside)
    edge = np.zeros(n + 1, np.bool_)
    edge[1:n] = inside[1:] != inside[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    if not n or not len(cuts):
        none = np.empty(0, np.int64)
        return none, none, none
    start, end = cuts[:-1], cuts[1:]
    keep = inside[start]
    start, end = start[keep], end[keep]
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def words_of(texts: Texts, table: np.ndarray, hasher: Hasher) -> Words:
    low = table[texts.data]
    start, end, row = spans(low != 0, texts.offsets)
    return Words(start, end, row, hasher.slices(hasher.sums(low), start, end))


def word_counts(words: Words, rows: int) -> np.ndarray:
    return np.bincount(words.row, minlength=rows)


def text_udf(make, returns: str):
    """Arrow UDF over a text column. ``make()`` runs once per task and gives a function of a ``Texts`` run
    that returns an Arrow array with one value per text.

    It counts as non-deterministic, so that the optimizer never copies it into a filter and runs it twice.
    """
    from pyspark.sql.functions import arrow_udf

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        each = make()
        for column in columns:
            parts = [each(texts) for texts in text_chunks(column)]
            if not parts:
                parts = [each(Texts(0, np.empty(0, np.uint8), np.zeros(1, np.int64)))]
            yield pa.concat_arrays(parts)

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, returnType=returns).asNondeterministic()


class HashIndex:
    """Rank of 64-bit hashes within a sorted table, through buckets of their top bits; -1 where absent."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        bits = max(4, int(len(hashes)).bit_length() + 2)
        self.drop = np.uint64(64 - bits)
        top = (hashes >> self.drop).astype(np.int64)
        sizes = np.bincount(top, minlength=1 << bits)
        self.first = (np.cumsum(sizes) - sizes).astype(np.int64)
        self.depth = int(sizes.max()) if len(hashes) else 0

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        at = self.first[(h >> self.drop).astype(np.int64)]
        for _ in range(self.depth):
            same = self.hashes[np.minimum(at, len(self.hashes) - 1)] == h
            out = np.where(same, at, out)
            at = at + 1
        return np.minimum(out, len(self.hashes) - 1)

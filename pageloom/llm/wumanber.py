"""Benchmark passages in documents: Wu-Manber search for many word windows at once.

The symbols are words. A window of ``WINDOW`` item words (or a whole shorter item) is a test
string. For each length there is a shift table over hashed blocks of ``BLOCK`` words: how far a
search may move on, given the block that ends at its position. Where the shift is zero the
block's hash names a bucket of windows with that suffix; their words are compared, first by
hash and then byte by byte. All cursors of a run of texts move together, one table look-up a step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.llm.words import Hasher, Texts, mix, plain_words, text_chunks, text_udf, words_of
from pageloom.session import ship_by_value

ship_by_value(__name__)

WINDOW = 10
BLOCK = 2
TABLE_BITS = 20
STRETCH = 64
#: Bytes of item text whose windows are searched in one pass (their tables go to every task); more items take more passes.
PASS_BYTES = 16 << 20

HITS = "struct<n_words: bigint, covered: array<int>, items: array<string>>"


class Patterns:
    """The windows of one length: shift table, and windows in the order of their suffix hash."""

    def __init__(self, length: int, windows: dict[bytes, tuple[np.ndarray, list[int]]]) -> None:
        self.length, self.block = length, min(BLOCK, length)
        self.texts = list(windows)
        self.owners = [windows[t][1] for t in self.texts]
        self.hashes = np.array([windows[t][0] for t in self.texts], np.uint64).reshape(-1, length)
        self.shift = np.full(1 << TABLE_BITS, length - self.block + 1, np.uint8)
        for end in range(self.block - 1, length):
            blocks = self.block_hash(self.hashes.reshape(-1), np.arange(len(self.texts)) * length + end)
            np.minimum.at(self.shift, self.slot(blocks), length - 1 - end)
        suffix = self.block_hash(self.hashes.reshape(-1), np.arange(len(self.texts)) * length + length - 1)
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    def block_hash(self, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = hashes[ends]
        for back in range(1, self.block):
            out = mix(out + hashes[ends - back] * np.uint64(2 * back + 1))
        return out

    @staticmethod
    def slot(blocks: np.ndarray) -> np.ndarray:
        return (blocks >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def occurrences(self, hashes: np.ndarray, row: np.ndarray, counts: np.ndarray):
        """Yield (last word, window) index arrays of hash-equal windows in rows of ``counts`` words."""
        stops = np.cumsum(counts)
        first = stops - counts + self.length - 1  # a window ends here at the earliest
        stretches = np.maximum(-(-(stops - first) // STRETCH), 0)
        at = np.repeat(first, stretches) + STRETCH * (np.arange(stretches.sum()) - np.repeat(np.cumsum(stretches) - stretches, stretches))
        end = np.minimum(at + STRETCH, np.repeat(stops, stretches))
        while len(at):
            blocks = self.block_hash(hashes, at)
            step = self.shift[self.slot(blocks)].astype(np.int64)
            stopped = np.flatnonzero(step == 0)
            if len(stopped):
                yield from self.compared(hashes, at[stopped], blocks[stopped])
            at = at + np.maximum(step, 1)
            going = at < end
            at, end = at[going], end[going]

    def compared(self, hashes, ends, blocks):
        lo, hi = np.searchsorted(self.suffix, blocks, "left"), np.searchsorted(self.suffix, blocks, "right")
        many = np.cumsum(hi - lo)
        cut = 0
        while cut < len(ends):  # buckets are opened in runs of bounded size
            stop = max(int(np.searchsorted(many, (many[cut - 1] if cut else 0) + 200_000, "right")), cut + 1)
            size = (hi - lo)[cut:stop]
            where = np.repeat(ends[cut:stop], size)
            window = self.order[np.repeat(lo[cut:stop], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
            for back in range(self.length):
                same = hashes[where - back] == self.hashes[window, self.length - 1 - back]
                where, window = where[same], window[same]
            if len(where):
                yield where, window
            cut = stop


def item_patterns(items: list[tuple[str | None, str | None]]) -> list[Patterns]:
    """Test strings of benchmark items, one group per window length."""
    by_length: dict[int, dict] = {}
    table, hasher = plain_words(), Hasher()
    for chunk in text_chunks(pa.array([t for _, t in items], pa.string())):
        words = words_of(chunk, table, hasher)
        low = (table[chunk.data] - 1).astype(np.uint8).tobytes()
        counts = np.bincount(words.row, minlength=chunk.rows)
        for row, (stop, count) in enumerate(zip(np.cumsum(counts).tolist(), counts.tolist())):
            length = min(count, WINDOW)
            for i in range(stop - count, stop - length + 1) if length else ():
                text = b" ".join(low[words.start[k]:words.end[k]] for k in range(i, i + length))
                known = by_length.setdefault(length, {}).setdefault(text, (words.hash[i:i + length], []))
                known[1].append(items[chunk.first_row + row][0])
    return [Patterns(n, windows) for n, windows in sorted(by_length.items())]


def search(texts: Texts, table: np.ndarray, hasher: Hasher, groups: list[Patterns]) -> pa.StructArray:
    """``HITS`` of each text; ``covered`` holds start, end of runs of hit words, one after the other."""
    words = words_of(texts, table, hasher)
    counts = np.bincount(words.row, minlength=texts.rows)
    edges = np.zeros(len(words.row) + 1, np.int64)
    found: list[set] = [set() for _ in range(texts.rows)]
    low = (table[texts.data] - 1).astype(np.uint8)
    for group in groups:
        for last, window in group.occurrences(words.hash, words.row, counts):
            for e, w in zip(last.tolist(), window.tolist()):
                s = e - group.length + 1
                if b" ".join(low[words.start[k]:words.end[k]].tobytes() for k in range(s, e + 1)) == group.texts[w]:
                    edges[s] += 1
                    edges[e + 1] -= 1
                    found[words.row[s]].update(i for i in group.owners[w] if i is not None)
    hit = np.cumsum(edges[:-1]) > 0
    first = np.cumsum(counts) - counts
    bounds = np.append(first, len(hit))
    covered: list[list[int]] = [[] for _ in range(texts.rows)]
    if hit.any():
        flip = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8)))
        for s, e in zip(flip[::2].tolist(), flip[1::2].tolist()):
            row = int(words.row[s])
            while s < e:  # a run may go on into the next text
                stop = min(e, int(bounds[row + 1]))
                if stop > s:
                    covered[row] += [s - int(first[row]), stop - int(first[row])]
                    s = stop
                row += 1
    return pa.StructArray.from_arrays(
        [pa.array(counts, pa.int64()), pa.array(covered, pa.list_(pa.int32())),
         pa.array([sorted(f) for f in found], pa.list_(pa.string()))], ["n_words", "covered", "items"])


def _searcher(spark: SparkSession, items: list):
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(item_patterns(items)))

    def make():
        table, hasher, groups = plain_words(), Hasher(), cloudpickle.loads(shared.value)
        return lambda texts: search(texts, table, hasher, groups)

    return text_udf(make, HITS)


def contamination(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words, n_hit, n_items, items_sha256, contaminated`` to each row of ``docs``.

    ``items(item_id, text)`` are the benchmark, ids of any type that has a text. Words are lower-cased digits, a-z and anything
    beyond ASCII; a document word inside an occurrence of a window is hit. Null and empty texts
    have no words; items without words match nothing; an item without an id marks words but
    isn't listed; repeated items count once. Columns of ``docs`` with the names of the results
    are replaced, all others are kept. The windows go to every task in passes of at most
    ``PASS_BYTES`` of item text each, all in one stage over the documents.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("text is not null")
    # a pass is named by a hash of the item, so that items are split evenly and none is left out
    bytes_ = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-2 * bytes_ // PASS_BYTES)) if bytes_ > PASS_BYTES else 1
    names = []
    out = docs
    for i in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i) if passes > 1 else items
        search_ = _searcher(spark, [tuple(r) for r in part.distinct().collect()])
        names.append(f"_hits_{i}")
        out = out.withColumn(names[-1], search_(F.col(text).cast("string")))
    if passes == 1:
        covered, found = F.col("_hits_0.covered"), F.col("_hits_0.items")
    else:
        covered = _united(F.concat(*[F.col(f"{n}.covered") for n in names]))
        found = F.array_distinct(F.concat(*[F.col(f"{n}.items") for n in names]))
    out = out.withColumn("_found", F.struct(covered.alias("covered"), found.alias("items")))
    c = F.col("_found.covered")
    ends = F.aggregate(F.transform(c, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    results = {
        "n_words": F.col("_hits_0.n_words"),
        "n_hit": ends,
        "n_items": F.size("_found.items").cast("bigint"),
        "items_sha256": F.sha2(F.array_join(F.array_sort("_found.items"), ","), 256),
        "contaminated": F.size(c) > 0,
    }
    return out.select(*[f"`{c}`" for c in docs.columns if c not in results], *[v.alias(k) for k, v in results.items()])


def _united(flat):
    """Disjoint runs of words from runs (start, end, start, end, ...) that may overlap."""
    runs = F.array_sort(F.transform(F.sequence(F.lit(0), F.greatest(F.size(flat) / 2 - 1, F.lit(0)).cast("int")), lambda i: F.struct(F.get(flat, (2 * i).cast("int")).alias("s"), F.get(flat, (2 * i + 1).cast("int")).alias("e"))))
    empty = F.array().cast("array<int>")
    joined = F.aggregate(
        F.when(F.size(flat) > 0, runs).otherwise(F.array().cast("array<struct<s: int, e: int>>")), empty,
        lambda a, r: F.when((F.size(a) > 0) & (F.element_at(a, -1) >= r.s),
                            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.greatest(F.element_at(a, -1), r.e))))
        .otherwise(F.concat(a, F.array(r.s, r.e))))
    return joined

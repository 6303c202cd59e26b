"""Language of a text: known words first, shorter and shorter character n-grams for the others.

A model holds, per language, log frequencies of words and of n-grams of 4, 3, 2 and 1
characters (a word counts with a blank at each end). A word of the model adds its log
frequencies. In any other word each position takes the longest n-gram there that the model
knows, and the word adds the mean over its positions. The language with the largest sum wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from pageloom.llm.tables import saved
from pageloom.llm.words import HashIndex, Hasher, Texts, spans, text_chunks, text_udf
from pageloom.session import ship_by_value

ship_by_value(__name__)

LONGEST = 4
#: Documents of each language that a model is learned from, chosen by a hash of the id.
SAMPLE_DOCS = 4000
#: Entries a model keeps, most frequent first: words (key 0), n-grams by their length.
ENTRIES = {0: 200_000, 4: 100_000, 3: 50_000, 2: 20_000, 1: 5_000}
#: Words that count towards the certainty of a prediction, at most.
EVIDENCE = 12
UNKNOWN = "und"

PREDICTION = "struct<lang: string, score: double>"


class Letters:
    """Which code points are letters, asked once per code point."""

    def __init__(self) -> None:
        self.known = np.zeros(0x110000, np.int8)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        there = np.flatnonzero(np.bincount(codes)) if len(codes) else []
        for c in there:
            if not self.known[c]:
                self.known[c] = 1 if chr(c).isalpha() else 2
        return self.known[codes] == 1


class Lowered:
    """Lower-case code points of some texts, with a blank for everything but letters and around each text."""

    def __init__(self, texts: Texts, letters: Letters, hasher: Hasher) -> None:
        raw = texts.data.tobytes()
        at = texts.offsets.tolist()
        rows = [raw[a:b].decode("utf-8", "replace").lower() for a, b in zip(at, at[1:])]
        codes = np.frombuffer(("\n" + "\n".join(rows) + "\n").encode("utf-32-le", "replace"), np.uint32)
        inside = letters(codes)
        offsets = np.r_[0, 1 + np.cumsum([len(r) + 1 for r in rows])].astype(np.int64)
        offsets[-1] = len(codes)
        self.start, self.end, self.row = spans(inside, offsets)
        self.sums = hasher.sums(np.where(inside, codes, np.uint32(32)))
        self.rows = len(rows)
        self.hash = hasher.slices(self.sums, self.start, self.end)
        self.hasher = hasher

    def positions(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start of each n-gram position of the padded words, and the word it is in."""
        counts = np.maximum(self.end[words] - self.start[words] - 1, 1)
        word = np.repeat(words, counts)
        return self.start[word] - 1 + np.arange(len(word)) - np.repeat(np.cumsum(counts) - counts, counts), word

    def grams(self, at: np.ndarray, n: int) -> np.ndarray:
        return self.hasher.slices(self.sums, at, at + n)


class Model:
    """Log frequencies: for each n (0 for words) sorted hashes and a row of values per hash."""

    def __init__(self, languages: list[str], tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """``tables[n]``: hashes, counts per language, total of each language."""
        self.languages = languages
        self.entries = {}
        for n, (hashes, counts, totals) in tables.items():
            order = np.argsort(hashes)
            smooth = 0.5
            values = np.log((counts + smooth) / (totals + smooth * (len(hashes) + 1)))
            self.entries[n] = (hashes[order], values[order])

    def predictor(self):
        letters, hasher = Letters(), Hasher()
        index = {n: HashIndex(h) for n, (h, _) in self.entries.items()}
        names = np.array([*self.languages, UNKNOWN], dtype=object)

        def predict(texts: Texts) -> pa.StructArray:
            t = Lowered(texts, letters, hasher)
            sums = np.zeros((t.rows, len(self.languages)))

            def add(rows, values, weights=None):
                for k in range(sums.shape[1]):
                    v = values[:, k] if weights is None else values[:, k] * weights
                    sums[:, k] += np.bincount(rows, weights=v, minlength=t.rows)

            at = index[0].find(t.hash) if self.languages else np.empty(0, np.int64)
            known = at >= 0
            if self.languages and len(at):
                add(t.row[known], self.entries[0][1][at[known]])
                start, word = t.positions(np.flatnonzero(~known))
                share = 1 / np.maximum(t.end[word] - t.start[word] - 1, 1)
                for n in range(LONGEST, 0, -1):
                    fits = start + n <= t.end[word] + 1
                    found = np.full(len(start), -1, np.int64)
                    found[fits] = index[n].find(t.grams(start[fits], n))
                    hit = found >= 0
                    add(t.row[word[hit]], self.entries[n][1][found[hit]], share[hit])
                    start, word, share = start[~hit], word[~hit], share[~hit]
            n_words = np.bincount(t.row, minlength=t.rows)
            best = np.full(t.rows, len(self.languages))
            score = np.zeros(t.rows)
            if self.languages:
                mean = sums / np.maximum(n_words, 1)[:, None] * np.minimum(n_words, EVIDENCE)[:, None]
                odds = np.exp(mean - mean.max(axis=1, keepdims=True))
                best = np.where(n_words > 0, mean.argmax(axis=1), best)
                score = np.where(n_words > 0, 1 / odds.sum(axis=1), 0.0)
            return pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score)], ["lang", "score"])

        return predict


def _counts(docs: DataFrame) -> DataFrame:
    """``(lang, n, hash, count)`` of the words and n-grams of ``docs(lang, text)``, combined per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, hasher = Letters(), Hasher()
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for texts in text_chunks(batch.column(1)):
                t = Lowered(texts, letters, hasher)
                own = langs[texts.first_row:texts.first_row + texts.rows]
                start, word = t.positions(np.arange(len(t.hash)))
                for lang in sorted(set(own)):
                    mine = np.array([x == lang for x in own])
                    for n in ENTRIES:
                        if n:
                            fits = mine[t.row[word]] & (start + n <= t.end[word] + 1)
                            hashes = t.grams(start[fits], n)
                        else:
                            hashes = t.hash[mine[t.row]]
                        keys, counts = np.unique(hashes, return_counts=True)
                        yield pa.RecordBatch.from_arrays([
                            pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), n), pa.int32()),
                            pa.array(keys.astype(np.int64)), pa.array(counts, pa.int64())], ["lang", "n", "hash", "count"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, n int, hash bigint, count bigint").groupBy(
        "lang", "n", "hash").agg(F.sum("count").alias("count"))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from ``docs(doc_id, lang, text)``; rows without language or text teach nothing.

    A language with more than ``sample_docs`` documents is learned from about that many, taken
    by a hash of the id. What reaches the driver is bounded by ``ENTRIES`` and the languages.
    """
    spark = docs.sparkSession
    docs = docs.where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], {})
    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample_docs / sizes[lang]))).otherwise(share)
    chosen = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1_000_000)) < share * 1_000_000
    counts = saved(_counts(docs.where(chosen)), "grams")
    totals = {(r.lang, r.n): r.t for r in counts.groupBy("lang", "n").agg(F.sum("count").alias("t")).collect()}
    each = [F.sum(F.when(F.col("lang") == lang, F.col("count")).otherwise(0)).alias(f"c{i}") for i, lang in enumerate(languages)]
    rows = saved(counts.groupBy("n", "hash").agg(F.sum("count").alias("total"), *each), "gram_rows")
    tables = {}
    for n, most in ENTRIES.items():
        top = rows.where((F.col("n") == n) & (F.col("total") > 1)).orderBy(F.desc("total"), "hash").limit(most).toArrow()
        tables[n] = (
            top.column("hash").to_numpy().astype(np.uint64),
            np.stack([top.column(f"c{i}").to_numpy() for i in range(len(languages))], axis=1).astype(float).reshape(-1, len(languages)),
            np.array([totals.get((lang, n), 0) for lang in languages], float),
        )
    return Model(languages, tables)


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that no model learns from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predicted(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """``struct<lang, score>`` of a text; ``und`` with score 0 for a null or a text without letters.

    Ties go to the first language by code point.
    """
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
    return text_udf(lambda: cloudpickle.loads(shared.value).predictor(), PREDICTION)(F.col(text).cast("string"))


def languages(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for each row of ``docs(doc_id, text, lang)``.

    Learns from the rows that have a language and aren't held out. Without any such row every
    document is ``und``. Null ids aren't held out and aren't learned from; repeated rows each
    get their line; other columns aren't read.
    """
    rows = docs.select("doc_id", "text", "lang")
    model = learn(rows.where(~held_out() & F.col("doc_id").isNotNull()))
    out = rows.select("doc_id", "text").withColumn("_p", predicted(rows, model))
    return out.select("doc_id", held_out().alias("held_out"), F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))

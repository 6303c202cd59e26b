"""Phrase collocations by Toivonen's method: a sample proposes, one full pass counts, border failures ask for more.

A sample of the documents proposes phrases, closed under parts. The full pass counts every word
and every longer phrase whose first part (all words but the last) and rest (all but the first)
are proposed: that is the proposal and its negative border, as far as they occur. A frequent
phrase that was not proposed is a border failure. It may lead to frequent phrases that were not
counted, so another pass counts the phrases that the frequent ones allow and the first pass did
not, and takes every phrase it counts as frequent where longer ones are decided. All words were
counted by the full pass, so by induction over its length no frequent phrase is missed after
that, whatever the sample proposed: the set is closed.

Most phrases of the border are rare, so each pass reads its texts twice. At first phrases are
hashed to places, and only how often each place occurs is shuffled, two or three bytes a phrase. A
phrase can't be frequent if all phrases of its place together are not, and only the others are
spelled out and counted.

What tasks know of a proposal is one bit per hashed phrase in a table of at most ``1 << MOST_BITS``
bits, whatever the input's size, and so is what they know of frequent places. Phrases that share a
bit with a proposed one, or a place with others, are counted for nothing; no result depends on a
hash. Phrases themselves are told apart by their words, and counted within a task before they are
shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from pageloom.functions.core import join_facts
from pageloom.llm.tables import saved
from pageloom.llm.words import Hasher, Texts, byte_table, mix, spans, text_chunks
from pageloom.session import ship_by_value

ship_by_value(__name__)

LONGEST = 5
LEAST_COUNT = 100
#: Phrases returned for each language.
BEST = 2000
#: One document of so many, by a hash of its id, is in the sample.
SAMPLE_SHARE = 8
#: A phrase is proposed at this share of its expected count in the sample, so that few frequent ones are missed.
SAMPLE_SLACK = 0.5
#: Size of a table of phrases, as a power of two: sixteen bits a phrase, 32 KB at least and 16 MB at most.
LEAST_BITS, MOST_BITS = 18, 27
NO_LANGUAGE = "und"
_BUCKET = 15  # bits of a place within one bitmap of 4 KB
_RANKED = 50_000  # phrases ranked within one task
_CHUNK = 1 << 20  # bytes of text counted at once, or one text
_PLACES = 1.5  # places that phrases are hashed to, for as many bytes of text as a frequent one has occurrences; so few rare ones share a frequent place
_HELD = 1 << 21  # hashed phrases of a task that are counted at once

_PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_WORD = byte_table(lambda b: b not in b" \t" + _PIECE_ENDS)
_PIECE_END = np.isin(np.arange(256), list(_PIECE_ENDS))
_STEP = np.uint64(0xD6E8FEB86659FD93)


class Running:
    """Words of some texts in order: where they are, their language, and whether the next word goes on in the same piece."""

    def __init__(self, texts: Texts, langs: list[str], hasher: Hasher) -> None:
        low = _WORD[texts.data]
        self.start, self.end, self.row = spans(low != 0, texts.offsets)
        self.lowered = np.where(low > 0, low - 1, texts.data).astype(np.uint8)
        word = hasher.slices(hasher.sums(low), self.start, self.end)
        piece = np.cumsum(_PIECE_END[texts.data])[self.start] if len(self.start) else self.start
        self.linked = (self.row[1:] == self.row[:-1]) & (piece[1:] == piece[:-1])
        names = sorted(set(langs))
        code = {name: i for i, name in enumerate(names)}
        self.names, self.lang = names, np.array([code[x] for x in langs], np.int64)[self.row]
        own = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") for x in names], np.uint64)
        self.word, self.first = word, mix(word ^ own[self.lang]) if names else word

    def lengths(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: whether a phrase starts at a word, and the hash of that phrase."""
        n, h = len(self.start), self.first
        whole = np.ones(n, np.bool_)
        for k in range(1, longest + 1):
            if k > 1:
                whole = whole.copy()
                whole[max(n - k + 1, 0):] = False
                m = max(n - k + 1, 0)
                whole[:m] &= self.linked[k - 2:k - 2 + m]
                h = h.copy()
                h[:m] = mix(h[:m] * _STEP + self.word[k - 1:k - 1 + m])
            yield k, whole, h

    def words(self) -> tuple[np.ndarray, pa.Array]:
        """Code of each word, and the words by code; equal codes are equal words."""
        cuts = np.stack([self.start, self.end], axis=1).ravel().astype(np.int64)
        strips = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), max(len(cuts) - 1, 0), [None, pa.py_buffer(cuts), pa.py_buffer(self.lowered)])
        found = strips.take(pa.array(np.arange(0, len(cuts), 2))).dictionary_encode()
        return found.indices.to_numpy(), found.dictionary.cast(pa.large_string())


def _place(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = _place(h, len(bits).bit_length() + 2)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _wanted(
    run: Running, lengths: range, known: np.ndarray | None, before: np.ndarray | None, sure: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length the words at which a phrase starts that is to be counted, and the hashes of these phrases.

    Without ``known`` these are all words alone. With it, also longer phrases whose first part and
    rest are known, but not both in ``before``. ``known`` has phrases of up to ``sure`` words; of
    longer ones, and beside ``before``, those that are counted are taken as known.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for k, whole, h in run.lengths(lengths.stop - 1):
        if k == 1:
            take = whole if before is None else np.zeros(len(whole), np.bool_)
        else:
            take = whole.copy()
            take[:-1] &= ok[:-1] & ok[1:]
            if before is not None:
                take[:-1] &= ~(old[:-1] & old[1:])
        if known is not None:
            ok = whole & _has(known, h) if k <= sure else take
            if before is not None:
                old, ok = whole & _has(before, h), ok | take
        at = np.flatnonzero(take) if k in lengths else np.empty(0, np.int64)
        out.append((at, h[at]))
    return out


def _read(table) -> np.ndarray | None:
    """The bits of a broadcast table, if there is one."""
    return None if table is None else np.frombuffer(table.value, np.uint8)


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[Running]:
    """The texts of batches ``(lang, text)`` by bounded runs; runs without words are left out."""
    hasher = Hasher()
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for texts in text_chunks(batch.column(1), _CHUNK):
            words = Running(texts, langs[texts.first_row:texts.first_row + texts.rows], hasher)
            if len(words.start):
                yield words


def _counts(docs: DataFrame, lengths: range, often, known=None, before=None, sure: int = LONGEST) -> DataFrame:
    """``(lang, phrase, f, k)``: occurrences of the phrases to be counted in ``docs(lang, text)``, of some lengths, at the places ``often``.

    ``k`` is the number of words; the row with k = 0 has the number of all words of the language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, kept = (_read(known), _read(before)), _read(often)
        for words in _running(batches):
            names = pa.array(words.names, pa.string())

            def rows(lang: np.ndarray, phrase: pa.Array, f: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [names.take(pa.array(lang)), phrase.cast(pa.string()), pa.array(f)], ["lang", "phrase", "f"])

            if 1 in lengths and before is None:
                n = np.bincount(words.lang, minlength=len(names))
                yield rows(np.arange(len(n)), pa.array([""] * len(n)), n.astype(np.int64))
            wanted = [at[_has(kept, h)] for at, h in _wanted(words, lengths, *tables, sure)]
            if not any(len(at) for at in wanted):
                continue
            code, spelled = words.words()
            code = code.astype(np.int64)
            for k, at in enumerate(wanted, 1):
                if not len(at):
                    continue
                # equal phrases get equal numbers, word by word; numbers stay below the phrases times the words
                key = words.lang[at]
                for j in range(k):
                    _, first, key, f = np.unique(
                        key * len(spelled) + code[at + j], return_index=True, return_inverse=True, return_counts=True)
                found = at[first]
                phrase = pc.binary_join_element_wise(*[spelled.take(pa.array(code[found + j])) for j in range(k)], pa.scalar(" ", pa.large_string()))
                yield rows(words.lang[found], phrase, f.astype(np.int64))

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, phrase string, f bigint")
    k = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).withColumn("k", k)


def _bits_of(places: DataFrame, size: int) -> bytes:
    """A table of ``1 << size`` bits in which those of ``places(place)`` are set."""
    maps = places.groupBy(F.shiftright("place", _BUCKET).alias("at")).agg(
        F.bitmap_construct_agg(F.col("place").bitwiseAND((1 << _BUCKET) - 1)).alias("bits"))
    part = 1 << (_BUCKET - 3)
    out = bytearray(1 << (size - 3))
    for r in maps.collect():
        out[r.at * part:(r.at + 1) * part] = r.bits
    return bytes(out)


def _often(docs: DataFrame, lengths: range, least: int, known=None, before=None, sure: int = LONGEST) -> bytes:
    """Bits of the places that the phrases to be counted in ``docs(lang, text)`` have ``least`` times together, or more.

    Each phrase that is so frequent itself has such a place. There are places in proportion to the
    text, and so many to a group that a group stays small, whatever the input's size.
    """
    size = int(docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    bits = min(max(int(_PLACES * size / max(least, 1)).bit_length(), LEAST_BITS), 48)
    low = min(16, bits - 10)  # a place within its group
    kind = np.min_scalar_type(max(least, 1))

    def grouped(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        place, f = np.unique(np.concatenate(held), return_counts=True)
        group = place >> low
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        ends = np.append(first, len(place))
        cut = lambda a: pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(first), [None, pa.py_buffer(ends * a.itemsize), pa.py_buffer(a)]).cast(pa.binary())
        # a count that is enough alone needs no more
        yield pa.RecordBatch.from_arrays(
            [pa.array(group[first]), cut((place & ((1 << low) - 1)).astype(np.uint16)), cut(np.minimum(f, least).astype(kind))],
            ["group", "places", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held, n = (_read(known), _read(before)), [], 0
        for words in _running(batches):
            for at, h in _wanted(words, lengths, *tables, sure):
                held.append(_place(h, bits))
                n += len(at)
            if n >= _HELD:
                yield from grouped(held)
                held, n = [], 0
        if n:
            yield from grouped(held)

    def enough(key: tuple, table: pa.Table) -> pa.Table:
        joined = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        # sums of whole numbers far below 2^53
        total = np.bincount(joined("places", np.uint16), joined("counts", kind), 1 << low)
        return pa.table({"place": (key[0].as_py() << low) + np.flatnonzero(total >= least)})

    hashed = docs.select("lang", "text").mapInArrow(run, "group bigint, places binary, counts binary")
    places = saved(hashed.groupBy("group").applyInArrow(enough, "place bigint"), "places")
    table = min(max((64 * places.count()).bit_length(), LEAST_BITS), bits, MOST_BITS)
    return _bits_of(places.select(F.shiftright("place", bits - table).alias("place")), table)


def _frequent(docs: DataFrame, lengths: range, least: int, name: str, known=None, before=None, sure: int = LONGEST) -> DataFrame:
    """Rows of ``_counts`` with ``f >= least``, and those with k = 0."""
    often = docs.sparkSession.sparkContext.broadcast(_often(docs, lengths, least, known, before, sure))
    counted = _counts(docs, lengths, often, known, before, sure)
    out = saved(counted.where((F.col("f") >= least) | (F.col("k") == 0)), name)
    often.destroy()
    return out


def _table_of(phrases: DataFrame) -> bytes:
    """Bits of the places of ``phrases(lang, phrase)``."""
    size = min(max((16 * phrases.count()).bit_length(), LEAST_BITS), MOST_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for texts in text_chunks(batch.column(1)):
                words = Running(texts, langs[texts.first_row:texts.first_row + texts.rows], hasher)
                length = np.bincount(words.row, minlength=texts.rows)
                first = np.cumsum(length) - length
                out = np.zeros(texts.rows, np.int64)
                for k, _, h in words.lengths(LONGEST):
                    mine = np.flatnonzero(length == k)
                    out[mine] = _place(h[first[mine]], size)
                yield pa.RecordBatch.from_arrays([pa.array(out)], ["place"])

    return _bits_of(phrases.select("lang", "phrase").mapInArrow(run, "place bigint"), size)


def _proposal(docs: DataFrame, longest: int, least: int, share: int) -> DataFrame:
    """``(lang, phrase, f, k)`` that may be frequent, as a sample of the documents has it.

    Its words, then pairs of them, then longer phrases of such pairs. Phrases of the greatest
    length would decide nothing.
    """
    context = docs.sparkSession.sparkContext
    often = max(2, int(SAMPLE_SLACK * least / share))
    sample = saved(docs.where(F.pmod(F.xxhash64(F.lit("phrases"), "doc_id"), F.lit(share)) == 0).select("lang", "text"), "sample")
    found = _frequent(sample, range(1, 2), often, "proposed").where("k > 0")
    for lengths in (range(2, 3), range(3, longest)):
        known = context.broadcast(_table_of(found))
        found = found.union(_frequent(sample, lengths, often, "proposed", known, sure=lengths.start - 1))
        known.destroy()
    return found


def frequent_phrases(docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, share: int = SAMPLE_SHARE) -> DataFrame:
    """``(lang, phrase, f, k)`` of all phrases of ``docs(doc_id, lang, text)`` with ``f >= least``, exact counts.

    Rows with k = 0 hold the number of words of a language.
    """
    context = docs.sparkSession.sparkContext
    proposed = _proposal(docs, longest, least, share)
    first = context.broadcast(_table_of(proposed))
    lengths = range(1, longest + 1)
    found = _frequent(docs, lengths, least, "frequent", first)
    # a phrase of the greatest length leads to no other
    leading = found.where(F.col("k").between(1, longest - 1))
    if leading.join(proposed, ["lang", "phrase"], "left_anti").isEmpty():
        return found
    second = context.broadcast(_table_of(leading))
    return found.union(_frequent(docs, lengths, least, "frequent", second, first))


def _key(lang: str, phrase: Column | str) -> Column:
    """Language and phrase as one text, that of no other pair."""
    return F.concat(F.length(lang).cast("string"), F.lit(":"), F.col(lang), phrase if isinstance(phrase, Column) else F.col(phrase))


def _scored(found: DataFrame) -> DataFrame:
    """``(lang, phrase, a, l, r, n, score)`` of the phrases of two words and more, by their lowest-scoring cut."""
    facts = found.where("k > 0").select(_key("lang", "phrase").alias("id"), F.col("f").alias("part_f"))
    cands = found.where("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"))
    words = F.split("phrase", " ")
    join = lambda first, count: F.array_join(F.slice(words, first, count), " ")
    cuts = cands.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _key("lang", join(F.lit(1), F.col("cut"))).alias("id"),
                       _key("lang", join(F.col("cut") + 1, F.col("k") - F.col("cut"))).alias("rest"))
    cuts = join_facts(cuts, facts, "id", "inner").select("lang", "phrase", "a", "cut", F.col("rest").alias("id"), F.col("part_f").alias("l"))
    cuts = join_facts(cuts, facts, "id", "inner").withColumnRenamed("part_f", "r").drop("id")
    totals = found.where("k = 0").select("lang", F.col("f").alias("n"))
    cuts = join_facts(cuts, totals, "lang", "inner")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    # a * n stays below 38 digits, and div is exact
    score = F.call_function("div", (F.lit(1000).cast("decimal(4,0)") * wide("a")) * wide("n"), wide("l") * wide("r"))
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("b"))
    return best.select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")


def _open(found: DataFrame) -> DataFrame:
    """Keys of the phrases that a longer one with the same count holds.

    A longer phrase with the same count holds one that is longer by a word and has it too.
    """
    words = F.split("phrase", " ")
    parts = F.array(F.array_join(F.slice(words, 1, F.col("k") - 1), " "), F.array_join(F.slice(words, 2, F.col("k") - 1), " "))
    held = found.where("k > 2").select("lang", F.explode(parts).alias("part"), "f")
    return held.groupBy(_key("lang", "part").alias("id")).agg(F.max("f").alias("longer_f"))


def _ranked(rows: DataFrame, best: int) -> DataFrame:
    """First ``best`` rows of each language with their rank, as a knock-out of groups of bounded size."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    groups = rows.count() // _RANKED + 1
    while groups > 1:
        w = Window.partitionBy("lang", "_g").orderBy(*order)
        rows = rows.withColumn("_g", F.pmod(F.xxhash64("phrase"), F.lit(groups))).withColumn("rank", F.row_number().over(w))
        rows = rows.where(F.col("rank") <= best).drop("_g", "rank")
        groups //= max(2, _RANKED // best)
    w = Window.partitionBy("lang").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= best)


def collocations(docs: DataFrame, least: int = LEAST_COUNT, best: int = BEST, share: int = SAMPLE_SHARE) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the best phrases of each language of ``docs(doc_id, lang, text)``.

    Null texts are empty, a null language is ``und``. Every row counts, repeated ones too; ids
    only choose the sample and may be null; other columns aren't read. Ties go by ``a``, then
    by the phrase's bytes. No document, or no frequent phrase, gives no row.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = frequent_phrases(texts, least, share=share)
    rows = _scored(found).withColumn("id", _key("lang", "phrase"))
    rows = saved(join_facts(rows, _open(found), "id").where("longer_f is null or 100 * longer_f < 100 * a"), "scored")
    return _ranked(rows.drop("id", "longer_f"), best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Token ids of whole documents in binary files, document boundaries in Elias-Fano form.

A file holds the ids of consecutive documents, one after the other, in the narrowest unsigned
type of the vocabulary, and two monotone sequences: where each document begins, and the document
ids. A sequence of n values below u takes about ``2 + log2(u / n)`` bits a value: ``low_bits`` of
each value are packed, the rest is a bit vector with one 1 per value, and the place of every
``SAMPLE``-th 1 lets ``select`` return any value without a table of 64-bit offsets.
"""

from __future__ import annotations

import itertools
import json
import re
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pageloom.llm.tables import saved
from pageloom.llm.words import Texts, text_chunks
from pageloom.session import scratch_path, ship_by_value

ship_by_value(__name__)

MAGIC = b"EFTOKID1"
SAMPLE = 64
FILE_IDS = 8 << 20
END_ID = 0
#: Distinct pieces of text whose ids a worker process remembers.
MEMORY_PIECES = 1_000_000
LATIN_WORD = re.compile(" ?[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")


class EliasFano:
    """A sequence of non-decreasing, non-negative integers with random access."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        top = int(values[-1]) if n else 0
        low_bits = max((top // n).bit_length() - 1, 0) if n else 0
        rest = values & np.uint64((1 << low_bits) - 1)
        bits = ((rest[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        vector = np.zeros(64 * ((int(ones[-1]) if n else 0) // 64 + 1), np.uint8)
        vector[ones] = 1
        return cls(n, low_bits, np.packbits(bits.reshape(-1), bitorder="little"),
                   np.packbits(vector, bitorder="little").view("<u8"), ones[::SAMPLE].astype("<u4"))

    def select(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th 1 of the bit vector."""
        at = self.samples[k // SAMPLE].astype(np.int64)
        left = (k % SAMPLE).astype(np.int64)
        word = at >> 6
        shift = (at & 63).astype(np.uint64)
        bits = (self.high[word] >> shift) << shift
        while True:
            ones = np.bitwise_count(bits).astype(np.int64)
            on = left >= ones
            if not on.any():
                break
            left = np.where(on, left - ones, left)
            word = np.where(on, word + 1, word)
            bits = np.where(on, self.high[np.minimum(word, len(self.high) - 1)], bits)
        seen = np.cumsum((bits[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), axis=1, dtype=np.int64)
        return (word << 6) + (seen > left[:, None]).argmax(axis=1)

    def get(self, k: np.ndarray) -> np.ndarray:
        """Values number ``k``, in runs of bounded memory."""
        out = np.empty(len(k), np.int64)
        for a in range(0, len(k), 8192):
            part = np.asarray(k[a:a + 8192], np.int64)
            value = (self.select(part) - part) << self.low_bits
            for bit in range(self.low_bits):
                place = part * self.low_bits + bit
                value |= ((self.low[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(np.int64) << bit
            out[a:a + 8192] = value
        return out

    def parts(self) -> tuple[list[int], list[bytes]]:
        """Numbers for the header, and the three byte sections."""
        return [self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)], [
            self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]

    @classmethod
    def read(cls, numbers: list[int], data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low_bits, n_low, n_high, n_samples = numbers
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, "<u8", n_high, at + n_low)
        samples = np.frombuffer(data, "<u4", n_samples, at + n_low + 8 * n_high)
        return cls(n, low_bits, low, high, samples), at + n_low + 8 * n_high + 4 * n_samples


def file_bytes(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One file. ``doc_ids`` in ascending order, nulls first; ids of all documents in that order."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    starts, starts_parts = EliasFano.of(np.r_[0, np.cumsum(counts)]).parts()
    names, names_parts = EliasFano.of(known.astype(np.uint64) - np.uint64(base % (1 << 64))).parts()
    head = np.array([ids.dtype.itemsize, len(ids), base, *starts, *names], "<i8").tobytes()
    return b"".join([MAGIC, head, ids.tobytes(), *starts_parts, *names_parts])


class TokenFile:
    """A file's documents: ``ids(k)`` and ``doc_id(k)`` by their number in the file."""

    def __init__(self, data: bytes) -> None:
        if data[:len(MAGIC)] != MAGIC:
            raise ValueError("not a token id file")
        view = memoryview(data)
        head = np.frombuffer(view, "<i8", 13, len(MAGIC)).tolist()
        width, n_ids, self.base = head[:3]
        at = len(MAGIC) + 8 * 13
        self.tokens = np.frombuffer(view, f"<u{width}", n_ids, at)
        self.starts, at = EliasFano.read(head[3:8], view, at + width * n_ids)
        self.names, at = EliasFano.read(head[8:13], view, at)
        self.n_docs = self.starts.n - 1
        self.n_null = self.n_docs - self.names.n

    def doc_ids(self) -> list[int | None]:
        known = self.names.get(np.arange(self.names.n)).astype(np.uint64) + np.uint64(self.base % (1 << 64))
        return [None] * self.n_null + known.astype(np.int64).tolist()

    def ids(self, k: int) -> np.ndarray:
        start, stop = self.starts.get(np.array([k, k + 1]))
        return self.tokens[start:stop]


class Encoder:
    """Ids of many texts. The tokenizers library encodes each distinct piece of text once per worker process.

    Pieces begin where the tokenizer's own pattern always begins a token: before a single blank
    between other characters, around a single line feed between others, and between ASCII letters,
    digits and punctuation (but for apostrophes). A text with other white space than ASCII's, with
    information separators or with a special token is one piece, and so is every text if the
    tokenizer isn't a byte-level BPE of that pattern. A piece of Latin letters, with a blank before
    them at most, is one word of the pattern and goes to the library's BPE model directly. Pieces
    are remembered by their bytes, not by a hash of them.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        kind = np.zeros(256, np.uint8)  # 1 letter, 2 digit, 3 punctuation, 4 white space, 0 everything else
        kind[[*range(65, 91), *range(97, 123)]], kind[range(48, 58)], kind[[*range(9, 14), 32]] = 1, 2, 4
        kind[[b for b in range(33, 127) if not kind[b] and b != 39]] = 3
        self.kind = kind
        form = json.loads(self.tokenizer.to_str())
        pre = form["pre_tokenizer"] or {}
        self.cut = (form["normalizer"] is None and form["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel"
                    and pre.get("use_regex") and not pre.get("add_prefix_space"))
        # the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: b if b in own else 256 + sum(x not in own for x in range(b)) for b in range(256)}
        self.forget()

    def forget(self) -> None:
        """Remembered pieces: place of each by its bytes; places say where their ids are in ``flat``."""
        self.place: dict[bytes, int] = {}
        self.flat, self.used = np.empty(1 << 16, self.type), 0
        self.first, self.count = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def whole(self, data: np.ndarray) -> np.ndarray:
        """Bytes that make their text one piece."""
        odd = (data >= 28) & (data <= 31)
        if (data >= 0xC2).any():
            x, y = data[:-1], data[1:]
            z = np.append(data[2:], 0)
            odd[:-1] |= (x == 0xC2) & ((y == 0x85) | (y == 0xA0)) | (x == 0xE1) & (y == 0x9A) & (z == 0x80)
            odd[:-1] |= (x == 0xE2) & ((y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF)) | (y == 0x81) & (z == 0x9F))
            odd[:-1] |= (x == 0xE3) & (y == 0x80) & (z == 0x80)
        raw = data.tobytes()
        for name in self.special:
            at = raw.find(name)
            while at >= 0:
                odd[at] = True
                at = raw.find(name, at + 1)
        return odd

    def pieces(self, texts: Texts) -> np.ndarray:
        """Where pieces begin."""
        data, n = texts.data, len(texts.data)
        kind = self.kind[data]
        begin = np.zeros(n + 1, np.bool_)
        begin[1:n] = (kind[1:] != kind[:-1]) & (kind[1:] % 4 > 0) & (kind[:-1] % 4 > 0)
        lone = np.zeros(n, np.bool_)
        if n > 2:
            lone[1:-1] = (kind[1:-1] == 4) & (kind[:-2] != 4) & (kind[2:] != 4)
        inner = texts.offsets[(texts.offsets > 0) & (texts.offsets < n)]
        lone[inner] = False  # the first of a text, and the last
        lone[inner - 1] = False
        begin[:n] |= lone & ((data == 32) | (data == 10))
        begin[1:] |= lone & (data == 10)
        if not self.cut:
            begin[:] = False
        odd = np.flatnonzero(self.whole(data))
        for row in np.unique(np.searchsorted(texts.offsets, odd, side="right") - 1):
            begin[texts.offsets[row]:texts.offsets[row + 1]] = False
        begin[texts.offsets] = True
        begin[n] = False
        return np.flatnonzero(begin)

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and their number for each text."""
        start = self.pieces(texts)
        cuts = np.append(start, len(texts.data)).astype(np.int64)
        found = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(start), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(texts.data))]).dictionary_encode()
        _, where, data = found.dictionary.buffers()
        ends = np.frombuffer(where, np.int64, len(found.dictionary) + 1).tolist()
        data = data.to_pybytes() if data else b""
        distinct = [data[a:b] for a, b in zip(ends, ends[1:])]
        if len(self.place) > MEMORY_PIECES:
            self.forget()
        at = np.array([self.place.get(p, -1) for p in distinct], np.int64)
        new = np.flatnonzero(at < 0)
        at[new] = len(self.place) + np.arange(len(new))
        self.learn([distinct[i] for i in new.tolist()])
        at = at[found.indices.to_numpy()]
        count = self.count[at]
        total = np.cumsum(count)
        ids = self.flat[np.repeat(self.first[at] - (total - count), count) + np.arange(total[-1] if len(total) else 0)]
        row = np.searchsorted(texts.offsets, start, side="right") - 1
        return ids, np.bincount(row, weights=count, minlength=texts.rows).astype(np.int64)

    def learn(self, new: list[bytes]) -> None:
        """Remember pieces that aren't known, in their order."""
        pieces = [p.decode("utf-8", "replace") for p in new]
        plain = [bool(self.cut and LATIN_WORD.fullmatch(p)) for p in pieces]
        whole = [p for p, one in zip(pieces, plain) if not one]
        encoded = (e.ids for a in range(0, len(whole), 4096) for e in self.tokenizer.encode_batch_fast(whole[a:a + 4096], add_special_tokens=False))
        tokenize, alphabet, blank = self.tokenizer.model.tokenize, self.alphabet, chr(self.alphabet[32])
        spelled = lambda p: p.replace(" ", blank) if p.isascii() else p.encode().decode("latin-1").translate(alphabet)
        ids = [[t.id for t in tokenize(spelled(p))] if one else next(encoded) for p, one in zip(pieces, plain)]
        n, k = len(self.place), len(new)
        count = np.fromiter(map(len, ids), np.int64, k)
        size = int(count.sum())
        self.flat, self.first, self.count = _room(self.flat, self.used + size), _room(self.first, n + k), _room(self.count, n + k)
        self.flat[self.used:self.used + size] = np.fromiter(itertools.chain.from_iterable(ids), self.type, size)
        self.first[n:n + k] = self.used + np.cumsum(count) - count
        self.count[n:n + k] = count
        self.used += size
        self.place.update(zip(new, range(n, n + k)))


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """The array, doubled until it has ``n`` places."""
    if n <= len(a):
        return a
    out = np.empty(max(n, 2 * len(a)), a.dtype)
    out[:len(a)] = a
    return out


def encoder(path: str) -> Encoder:
    """The worker process's encoder; it outlives a task, so that pieces are encoded once per process."""
    kept = sys.modules.setdefault("_pageloom_encoders", types.ModuleType("_pageloom_encoders")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


MANIFEST = "part int, file int, path string, n_docs bigint, n_ids bigint"


def write_tokens(docs: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """Write files below ``folder`` and return their manifest ``(part, file, path, n_docs, n_ids)``.

    ``docs(doc_id, text)`` go into files in ascending order of doc_id, nulls first, equal ids by
    text; a null text is empty. Each document ends with id 0. Files of a task that is lost are
    written again under another name; the manifest lists those that count. Paths may be on any
    file system that pyarrow opens.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    rows = rows.withColumn("tie", tie).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        store, place = fs.FileSystem.from_uri(folder)
        encode = encoder(tokenizer)
        names: list = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held, number = 0, 0

        def flush() -> pa.RecordBatch:
            path = f"{place}/part-{part:05d}-{number:05d}-{attempt}.eftok"
            store.create_dir(place, recursive=True)
            with store.open_output_stream(path) as out:
                out.write(file_bytes(names, np.concatenate(counts), np.concatenate(ids)))
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([path.removeprefix(place)]),
                pa.array([len(names)], pa.int64()), pa.array([held], pa.int64())], ["part", "file", "path", "n_docs", "n_ids"])

        for batch in batches:
            for texts in text_chunks(batch.column(1)):
                flat, count = encode.encode(texts)
                stops = np.cumsum(count)
                ids.append(np.insert(flat, stops, END_ID).astype(encode.type))
                counts.append(count + 1)
                names += batch.column(0).slice(texts.first_row, texts.rows).to_pylist()
                held += len(ids[-1])
                if held >= FILE_IDS:
                    yield flush()
                    names, counts, ids, held, number = [], [], [], 0, number + 1
        if names:
            yield flush()

    manifest = rows.mapInArrow(run, MANIFEST)
    return saved(manifest.withColumn("path", F.concat(F.lit(folder), "path")), "manifest")


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the files, ``ids`` too on demand.

    ``start`` counts the ids of all documents before it; the sums before a file are taken over the
    manifest, which has one row per file.
    """
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    files = files.select("path", "before").repartition(max(manifest.count(), 1), "path")
    more = ", ids array<bigint>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_stream(place) as source:
                    file = TokenFile(source.read())
                starts = file.starts.get(np.arange(file.n_docs + 1))
                tokens = [file.tokens[a:b] for a, b in zip(starts, starts[1:])]
                columns = [
                    pa.array(file.doc_ids(), pa.int64()), pa.array(starts[:-1] + offset, pa.int64()),
                    pa.array(np.diff(starts), pa.int64()),
                    pa.array([zlib.crc32(t.astype("<u4").tobytes()) for t in tokens], pa.int64())]
                if with_ids:
                    columns.append(pa.array([t.astype(np.int64) for t in tokens], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(columns)])

    return files.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + more)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system named, for workers that know no default one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toUri().toString()


def token_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode ``docs(doc_id, text)`` into files in the shared folder and return what they hold per document.

    Repeated rows are documents of their own; an empty table gives an empty result; a text without
    ids holds the end id alone. Other columns aren't read.
    """
    spark = docs.sparkSession
    folder = qualified(spark, scratch_path(spark, "token_ids"))
    return read_tokens(write_tokens(docs, tokenizer, folder))

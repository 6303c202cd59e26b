"""Quality of a text by nearest labelled neighbours in a latent-semantic space.

Terms are byte trigrams of the text as written, hashed to ``BUCKETS`` columns, and a few shares
of the whole text (letters in capitals, marks, distinct and doubled words and so on) cut into steps. Their
damped counts, weighted by how rare the term is and scaled to unit length, are projected on the
``LATENT`` leading directions of the labelled sample (truncated singular value decomposition).
Every document is compared with every labelled vector: cosines come from exact products of
blocks, the ``NEIGHBOURS`` largest vote with their label, weighted by their similarity.

What is broadcast is bounded by ``SAMPLE_DOCS``, ``BUCKETS`` and ``LATENT``, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from pageloom.llm.language import held_out
from pageloom.llm.tables import saved
from pageloom.llm.words import Hasher, Texts, spaced_words, text_udf, words_of
from pageloom.session import ship_by_value

ship_by_value(__name__)

#: Distinct labelled texts that the model is fitted on, half of each label where there are enough, by a hash of the text.
SAMPLE_DOCS = 4000
#: Columns of hashed trigrams.
BUCKETS = 4096
LATENT = 64
NEIGHBOURS = 15
#: Similarities vote with this power, so that the nearest count most.
SHARPNESS = 8
_BLOCK = 64  # documents of a block
_STEPS = 8  # steps of a share
_SHARE_WEIGHT = 3.0  # of a share's term against a trigram's
_SHARES = 8
_BYTES = 1 << 20


def _byte_kinds() -> np.ndarray:
    """0 other, 1 small letter or beyond ASCII, 2 capital, 3 digit, 4 mark, 5 blank, 6 line end."""
    kinds = np.zeros(256, np.uint8)
    kinds[97:123], kinds[128:], kinds[65:91], kinds[48:58] = 1, 1, 2, 3
    kinds[[b for b in range(33, 127) if not chr(b).isalnum()]] = 4
    kinds[[32, 9]], kinds[[10, 11, 12, 13]] = 5, 6
    return kinds


class Terms:
    """Dense term counts of texts, a row each: trigram buckets, then the steps of the shares."""

    width = BUCKETS + _SHARES * _STEPS

    def __init__(self) -> None:
        self.hasher, self.kinds, self.table = Hasher(), _byte_kinds(), spaced_words()

    def _trigrams(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n, rows = len(data), len(offsets) - 1
        out = np.zeros((rows, BUCKETS))
        wide = data.astype(np.uint32)
        # long texts in slices, so that memory doesn't grow with them; the last two bytes of a slice begin the next
        for a in range(0, max(n - 2, 0), _BYTES):
            part = wide[a:a + _BYTES + 2]
            code = (part[:-2] << 16 | part[1:-1] << 8 | part[2:]) * np.uint32(2654435761)
            at = np.arange(a, a + len(code))
            row = np.searchsorted(offsets, at, side="right") - 1
            inside = at + 3 <= offsets[row + 1]
            key = row[inside] * BUCKETS + (code[inside] >> np.uint32(20)).astype(np.int64)
            out += np.bincount(key, minlength=rows * BUCKETS).reshape(rows, BUCKETS)
        return out

    def _shares(self, texts: Texts) -> np.ndarray:
        rows = texts.rows
        size = np.maximum(np.diff(texts.offsets), 1)
        row = np.repeat(np.arange(rows), np.diff(texts.offsets))
        kinds = np.bincount(row * 7 + self.kinds[texts.data], minlength=rows * 7).reshape(rows, 7)
        words = words_of(texts, self.table, self.hasher)
        n_words = np.bincount(words.row, minlength=rows)
        pair = np.stack([words.row.astype(np.uint64), words.hash], axis=1)
        order = np.lexsort((pair[:, 1], pair[:, 0]))
        pair = pair[order]
        new = np.ones(len(pair), np.bool_)
        new[1:] = (pair[1:] != pair[:-1]).any(axis=1)
        distinct = np.bincount(pair[new, 0].astype(np.int64), minlength=rows)
        again = (words.row[1:] == words.row[:-1]) & (words.hash[1:] == words.hash[:-1])
        again = np.bincount(words.row[1:][again], minlength=rows)
        letters = np.maximum(kinds[:, 1] + kinds[:, 2], 1)
        some = np.maximum(n_words, 1)
        return np.stack([
            kinds[:, 2] / letters, kinds[:, 3] / size, np.minimum(4 * kinds[:, 4] / size, 1), np.minimum(4 * kinds[:, 6] / some, 1),
            distinct / some, np.minimum(size / some / 16, 1), np.minimum(np.log1p(n_words) / 12, 1),
            np.minimum(4 * again / some, 1)], axis=1)

    def rows(self, texts: Texts) -> np.ndarray:
        steps = np.minimum((self._shares(texts) * _STEPS).astype(np.int64), _STEPS - 1) + np.arange(_SHARES) * _STEPS
        out = np.zeros((texts.rows, self.width))
        out[:, :BUCKETS] = self._trigrams(texts.data, texts.offsets)
        out[np.arange(texts.rows)[:, None], BUCKETS + steps] = 1
        return out


def _blocks(texts: Texts) -> Iterator[Texts]:
    """The texts in blocks of ``_BLOCK``."""
    for a in range(0, texts.rows, _BLOCK):
        b = min(a + _BLOCK, texts.rows)
        first, last = texts.offsets[a], texts.offsets[b]
        yield Texts(texts.first_row + a, texts.data[first:last], texts.offsets[a:b + 1] - first)


def _damped(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Weighted terms of unit length: trigrams together, and each share's step."""
    x = np.log1p(counts) * rarity
    length = np.sqrt((x[:, :BUCKETS] ** 2).sum(axis=1, keepdims=True))
    x[:, :BUCKETS] /= np.maximum(length, 1e-12)
    x[:, BUCKETS:] *= _SHARE_WEIGHT / _SHARES
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


class Neighbours:
    """A fitted model: rarity of terms, directions, labelled vectors with their label and the weight of their vote."""

    def __init__(self, rarity: np.ndarray, directions: np.ndarray, vectors: np.ndarray, label: np.ndarray, vote: np.ndarray) -> None:
        self.rarity, self.directions, self.vectors, self.label, self.vote = rarity, directions, vectors, label, vote

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_damped(counts, self.rarity) @ self.directions)

    def scores(self, latent: np.ndarray, itself: bool = False) -> np.ndarray:
        """Weighted share of label 1 among the nearest; of equal similarities all vote that reach the last place.

        ``itself``: row i is labelled vector i, which doesn't vote for itself.
        """
        cosine = latent @ self.vectors.T
        if itself:
            np.fill_diagonal(cosine, -np.inf)
        k = min(NEIGHBOURS, len(self.label))
        least = np.partition(cosine, len(self.label) - k, axis=1)[:, len(self.label) - k]
        near = cosine >= least[:, None] - 1e-9
        weight = np.where(near, np.maximum(cosine, 1e-6) ** SHARPNESS * self.vote, 0.0)
        return np.clip((weight @ self.label) / weight.sum(axis=1), 0.0, 1.0)

    def predictor(self):
        terms = Terms()

        def predict(texts: Texts) -> pa.Array:
            parts = [self.scores(self.latent(terms.rows(b))) for b in _blocks(texts)]
            return pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())

        return predict


def _term_lists():
    """UDF: places and counts of the terms of a text."""

    def make():
        terms = Terms()

        def each(texts: Texts) -> pa.Array:
            places, counts, sizes = [], [], []
            for b in _blocks(texts):
                dense = terms.rows(b)
                r, c = np.nonzero(dense)
                places.append(c)
                counts.append(dense[r, c])
                sizes.append(np.bincount(r, minlength=b.rows))
            join = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
            offsets = pa.array(np.r_[0, np.cumsum(join(sizes))], pa.int32())
            return pa.StructArray.from_arrays([
                pa.ListArray.from_arrays(offsets, pa.array(join(places), pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(join(counts), pa.float32()))], ["places", "counts"])

        return each

    return text_udf(make, "struct<places: array<int>, counts: array<float>>")


def leading_directions(x: np.ndarray, most: int, rounds: int = 4) -> np.ndarray:
    """Right singular vectors of the largest singular values, by subspace iteration from a fixed start."""
    rng = np.random.default_rng(1)
    q = rng.standard_normal((x.shape[1], min(most + 16, *x.shape)))
    for _ in range(rounds):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T)[:, :most]


def fit(counts: np.ndarray, label: np.ndarray, shares: dict[int, float] | None = None) -> Neighbours:
    """A model from term counts and 0/1 labels. ``shares``: share of each label among all labelled texts."""
    present = (counts > 0).sum(axis=0)
    rarity = np.log((1 + len(counts)) / (1 + present)) + 0.1
    rarity[BUCKETS:] = 1 / np.log(2)  # a share has exactly one step
    x = _damped(counts, rarity)
    directions = leading_directions(x, LATENT)
    own = {k: max(float((label == k).mean()), 1e-12) for k in (0, 1)}
    shares = shares or own
    # the sample is balanced; votes are weighted back to what is usual, half-way on the logarithm
    vote = np.where(label == 1, np.sqrt(shares.get(1, 0) / own[1]), np.sqrt(shares.get(0, 0) / own[0]))
    return Neighbours(rarity, directions, _unit(x @ directions), label.astype(float), vote)


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Neighbours | float:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``; a constant score if only one label is known, or none.

    Equal texts are one, labelled by their majority (ties: 1). Repeated ids and labels each count.
    """
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", (F.col("quality") > 0).cast("int").alias("label"))
    known = known.groupBy("doc_id").agg(F.avg("label").alias("label"))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    keys = texts.select("doc_id", F.sha2("text", 256).alias("key")).join(known, "doc_id")
    keys = saved(keys.groupBy("key").agg((F.avg("label") >= 0.5).cast("int").alias("label"), F.min("doc_id").alias("doc_id")), "labelled")
    sizes = {r.label: r.n for r in keys.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return float(max(sizes, default=1))
    few = min(sizes, key=lambda k: sizes[k])
    take = {few: min(sizes[few], sample_docs // 2)}
    take[1 - few] = min(sizes[1 - few], sample_docs - take[few])
    chosen = None
    for label, n in sorted(take.items()):
        part = keys.where(F.col("label") == label).orderBy("key").limit(n)
        chosen = part if chosen is None else chosen.union(part)
    chosen = saved(chosen, "sample")
    # at most sample_docs ids: the texts stay where they are; of a repeated id the text with the key is taken
    found = texts.join(F.broadcast(chosen.select("doc_id", "label", "key")), "doc_id").where(F.sha2("text", 256) == F.col("key"))
    rows = found.select("key", "label", _term_lists()(F.col("text")).alias("t")).select("key", "label", "t.places", "t.counts").dropDuplicates(["key"]).toArrow()
    order = np.argsort(np.array(rows.column("key").to_pylist()))
    counts = np.zeros((len(order), Terms.width))
    length = rows.column("places").combine_chunks()
    row = np.repeat(np.arange(len(order)), length.value_lengths().to_numpy(zero_copy_only=False))
    counts[row, length.flatten().to_numpy()] = rows.column("counts").combine_chunks().flatten().to_numpy()
    total = sum(sizes.values())
    return fit(counts[order], rows.column("label").to_numpy()[order], {k: n / total for k, n in sizes.items()})


def qualities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs(doc_id, text)``.

    Learns from labelled documents that aren't held out. Null texts are empty; empty texts have no
    trigrams but the steps of a short text, and so the labels of the shortest texts. With labels of
    one kind only every score is that label, without any it is 1. Repeated rows each get their
    line; null ids aren't held out and teach nothing; other columns aren't read.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    model = learn(rows.where(~held_out()), labels.select("doc_id", "quality"))
    if isinstance(model, float):
        score = F.lit(model)
    else:
        shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
        score = text_udf(lambda: cloudpickle.loads(shared.value).predictor(), "double")(F.col("text"))
    out = rows.withColumn("score", score)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

"""Toxicity as a severity grade: cumulative-link ordinal regression on sparse text features.

Features are the presence of words and of word beginnings of ``PREFIXES`` letters. One weight per
feature is shared by all thresholds: ``P(grade <= k) = sigmoid(threshold_k - sum of weights)``.
The answer is the expected grade.

Labels say toxic or not. The grades 1 to 3 of toxic training documents come from how much
evidence they hold, cut at terciles: the number of features that nearly always mean toxic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from pageloom.llm.language import Letters, Lowered
from pageloom.llm.tables import saved
from pageloom.llm.words import HashIndex, Hasher, Texts, text_udf
from pageloom.session import ship_by_value

ship_by_value(__name__)

PREFIXES = (3, 4, 5)
#: Labelled documents that the model is fitted on, by a hash of the id; half of them are toxic where there are enough.
SAMPLE_DOCS = 8000
#: Features of the model: those that tell toxic from other documents best.
FEATURES = 4096
LEAST_DOCS = 4
#: Least distance of a feature's two document frequencies, in standard errors; among 100,000 features chance reaches 4.5.
LEAST_Z = 5.0
ROUNDS = 300
RIDGE = 1e-3

SEVERITY = "struct<severity: double, p_toxic: double>"


def features_of(texts: Texts, letters: Letters, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of words and word beginnings."""
    t = Lowered(texts, letters, hasher)
    rows, hashes = [t.row], [t.hash]
    for n in PREFIXES:
        long = t.end - t.start >= n
        rows.append(t.row[long])
        hashes.append(t.grams(t.start[long], n) ^ np.uint64(n))  # not the hash of the word that is spelled the same
    return np.concatenate(rows), np.concatenate(hashes)


def _feature_sets(index: np.ndarray | None):
    """UDF: distinct feature hashes of a text, or, with an index, places in it."""

    def make():
        letters, hasher = Letters(), Hasher()
        find = HashIndex(index).find if index is not None and len(index) else None

        def each(texts: Texts) -> pa.Array:
            row, h = features_of(texts, letters, hasher)
            if index is not None:
                at = find(h) if find else np.full(len(h), -1)
                row, h = row[at >= 0], at[at >= 0].astype(np.uint64)
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            new = np.ones(len(h), np.bool_)
            new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
            counts = np.bincount(row[new], minlength=texts.rows)
            return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(h[new].astype(np.int64)))

        return each

    return text_udf(make, "array<bigint>")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, grade: np.ndarray, width: int, grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by gradient descent (Adam) on the likelihood; features in sparse pairs (row, column)."""
    n = len(grade)
    low = np.array([(grade <= k).mean() for k in range(grades - 1)]).clip(0.01, 0.99)
    first = np.log(low / (1 - low))
    # thresholds are kept in order by their steps' logarithms
    p = np.r_[np.zeros(width), first[0], np.log(np.maximum(np.diff(first), 0.1))]
    m, v = np.zeros_like(p), np.zeros_like(p)
    for i in range(1, ROUNDS + 1):
        w, steps = p[:width], np.exp(p[width + 1:])
        theta = p[width] + np.r_[0, np.cumsum(steps)]
        eta = np.bincount(rows, weights=w[cols], minlength=n)
        bounds = np.r_[-np.inf, theta, np.inf]
        hi, lo = sigmoid(bounds[grade + 1] - eta), sigmoid(bounds[grade] - eta)
        hi[grade == grades - 1], lo[grade == 0] = 1.0, 0.0
        mass = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / mass, lo * (1 - lo) / mass
        deta = (dhi - dlo) / n
        dtheta = np.array([(-dhi[grade == k].sum() + dlo[grade == k + 1].sum()) / n for k in range(grades - 1)])
        g = np.r_[np.bincount(cols, weights=deta[rows], minlength=width) + RIDGE * w,
                  dtheta.sum(), steps * np.cumsum(dtheta[::-1])[::-1][1:]]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.1 * (m / (1 - 0.9 ** i)) / (np.sqrt(v / (1 - 0.999 ** i)) + 1e-8)
    return p[:width], p[width] + np.r_[0, np.cumsum(np.exp(p[width + 1:]))]


class Severity:
    """A fitted model: feature hashes in order, their weights, thresholds, and the severity from which a text is called toxic."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, thresholds: np.ndarray, cut: float) -> None:
        self.hashes, self.weights, self.thresholds, self.cut = hashes, weights, thresholds, cut

    def expected(self, eta: np.ndarray) -> np.ndarray:
        """Sum over thresholds of P(grade > k)."""
        return sum((1 - sigmoid(t - eta) for t in self.thresholds), np.zeros(len(eta)))

    def predictor(self):
        letters, hasher = Letters(), Hasher()
        index = HashIndex(self.hashes) if len(self.hashes) else None

        def predict(texts: Texts) -> pa.StructArray:
            eta = np.zeros(texts.rows)
            if index:
                row, h = features_of(texts, letters, hasher)
                at = index.find(h)
                pairs = np.unique(row[at >= 0] * len(self.hashes) + at[at >= 0])
                eta = np.bincount(pairs // len(self.hashes), weights=self.weights[pairs % len(self.hashes)], minlength=texts.rows)
            toxic = 1 - sigmoid(self.thresholds[0] - eta) if len(self.thresholds) else np.zeros(texts.rows)
            return pa.StructArray.from_arrays([pa.array(self.expected(eta)), pa.array(toxic)], ["severity", "p_toxic"])

        return predict


def learn(docs: DataFrame, labels: DataFrame) -> Severity:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    At most about ``SAMPLE_DOCS`` labelled documents are read, toxic ones first; a document with
    several labels counts as toxic if one says so, and of several rows of an id the least text is
    read. Without toxic or without other documents the
    model gives 0 to every text.
    """
    known = saved(labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        (F.max("toxic") > 0).alias("toxic")), "labels")
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Severity(np.empty(0, np.uint64), np.empty(0), np.empty(0), 0.5)
    toxic = min(sizes[True], SAMPLE_DOCS // 2)
    share = F.when(F.col("toxic"), F.lit(toxic / sizes[True])).otherwise(F.lit(min(1.0, (SAMPLE_DOCS - toxic) / sizes[False])))
    sample = known.where(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    # bounded by SAMPLE_DOCS ids: the documents' texts stay where they are, and repeated ids are one row
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(sample), "doc_id")
    chosen = saved(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")), "labelled")
    n = {r.toxic: r.n for r in chosen.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return Severity(np.empty(0, np.uint64), np.empty(0), np.empty(0), 0.5)
    counts = chosen.select("toxic", F.explode(_feature_sets(None)(F.col("text"))).alias("h")).groupBy("h").agg(
        F.count(F.lit(1)).alias("df"), F.count(F.when(F.col("toxic"), 1)).alias("dt"))
    pt, po = F.col("dt") / n[True], (F.col("df") - F.col("dt")) / n[False]
    mean = F.col("df") / (n[True] + n[False])
    z = F.abs(pt - po) / F.sqrt(mean * (1 - mean + 1e-9) * (1 / n[True] + 1 / n[False]))
    top = counts.where(F.col("df") >= LEAST_DOCS).withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "h").limit(FEATURES).toArrow()
    hashes = top.column("h").to_numpy().astype(np.uint64)
    order = np.argsort(hashes)
    hashes = hashes[order]
    sure = (top.column("dt").to_numpy() >= 0.95 * top.column("df").to_numpy())[order]
    rows = chosen.select("doc_id", "toxic", _feature_sets(hashes)(F.col("text")).alias("f")).orderBy("doc_id").toArrow()
    lists = rows.column("f").to_pylist()
    is_toxic = np.array(rows.column("toxic").to_pylist(), np.bool_)
    sizes_ = np.array([len(x) for x in lists])
    r, c = np.repeat(np.arange(len(lists)), sizes_), np.array([i for x in lists for i in x], np.int64)
    evidence = np.bincount(r, weights=sure[c].astype(float), minlength=len(lists))
    cuts = np.quantile(evidence[is_toxic], [1 / 3, 2 / 3])
    grade = np.where(is_toxic, 1 + (evidence[:, None] > cuts).sum(axis=1), 0)
    grade = np.unique(grade, return_inverse=True)[1]
    grades = int(grade.max()) + 1
    weights, thresholds = fit_ordinal(r, c, grade, len(hashes), grades)
    model = Severity(hashes, weights, thresholds, 0.5)
    score = model.expected(np.bincount(r, weights=weights[c], minlength=len(lists)))
    # the cut with the best F1 on the sample, in the middle of the gap above it
    ranked = np.argsort(-score, kind="stable")
    hits = np.cumsum(is_toxic[ranked])
    f1 = 2 * hits / (np.arange(1, len(score) + 1) + is_toxic.sum())
    best = int(f1.argmax())
    below = score[ranked[best + 1]] if best + 1 < len(score) else 0.0
    model.cut = float((score[ranked[best]] + below) / 2)
    return model


def severities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, severity, p_toxic, toxic)`` for each row of ``docs(doc_id, text)``.

    ``severity`` is the expected grade, from 0; ``toxic`` says whether it reaches the model's cut.
    Null and empty texts have no features and are never toxic. Repeated rows each get their line.
    """
    model = learn(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
    udf = text_udf(lambda: cloudpickle.loads(shared.value).predictor(), SEVERITY)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("_s", udf(F.col("text")))
    return rows.select("doc_id", F.col("_s.severity").alias("severity"), F.col("_s.p_toxic").alias("p_toxic"),
                       ((F.col("_s.severity") > model.cut) & (F.trim("text") != "")).alias("toxic"))

"""Whitening of embeddings: principal components by pivoted Cholesky and one-sided Jacobi rotations.

Sums and the centred scatter matrix are added up by Spark, one square matrix of partial sums per
task. On the driver the scatter is factored as ``A = P L L' P'`` (Cholesky with the largest
diagonal entry as pivot), and the columns of ``L`` itself are rotated pair by pair until they
are orthogonal: ``L J = U D``. Then ``A = (P U) D^2 (P U)'``: squared column norms are
eigenvalues and normalised columns are components, without ever forming ``J``.

What the driver holds grows with the square of the dimension only.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pageloom.llm.tables import saved
from pageloom.session import ship_by_value

ship_by_value(__name__)

SCALE, SHIFT = 1024, 100_000
#: Components returned at most.
COMPONENTS = 8
#: Rows of a block of vectors within a task.
BLOCK = 4096
#: Entries whose whole number would not stay below this are not usable (sums of a block stay within 64 bits).
LIMIT = 1 << 50
#: A pivot or column below this share of the largest counts as zero, times the dimension.
TINY = 1e-15


class Fit(NamedTuple):
    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float


def usable(vectors: str = "embedding"):
    """Vector without null, NaN or infinite entries, and with entries that can be scaled."""
    v = F.col(vectors)
    bound = float(LIMIT // SCALE // 2)
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < bound))


def _blocks(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Whole numbers of some vectors, a row each."""
    for at in range(0, len(column), BLOCK):
        flat = column.slice(at, BLOCK).flatten().to_numpy(zero_copy_only=False)
        yield (np.floor(SCALE * flat.astype(np.float64)).astype(np.int64) + SHIFT).reshape(-1, width)


def _offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exact: 64-bit where that is enough, else whole numbers of any size."""
    top = max((abs(s) for s in sums), default=0) + n * (int(np.abs(x).max()) if x.size else 0)
    if top < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (_offsets(x, n, sums) / n).astype(np.float64)


def _sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object)
        for batch in batches:
            for x in _blocks(batch.column(0), width):
                n, total = n + len(x), total + x.sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, width), pa.int32()),
             pa.array([Decimal(n), *map(Decimal, total.tolist())], pa.decimal128(38, 0))], ["i", "s"])

    found = rows.select("embedding").mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s"))
    by_place = {r.i: int(r.s) for r in found.collect()}
    return by_place.get(-1, 0), [by_place.get(i, 0) for i in range(width)]


def _summed_products(rows: DataFrame, column: str, width: int, block) -> np.ndarray:
    """Sum over rows of the outer product of ``block(values)`` with itself; one triangle per task is shuffled."""
    up = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for d in block(batch.column(0)):
                total += d.T @ d
        yield pa.RecordBatch.from_arrays(
            [pa.array(up[0], pa.int32()), pa.array(up[1], pa.int32()), pa.array(total[up])], ["i", "j", "s"])

    found = rows.select(column).mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros((width, width))
    i, j = found.column("i").to_numpy(), found.column("j").to_numpy()
    out[i, j] = out[j, i] = found.column("s").to_numpy()
    return out


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``L`` (one column per rank) and the pivot order with ``a[order][:, order] = L L'``; stops at the numerical rank."""
    n = len(a)
    order, diagonal = np.arange(n), a.diagonal().copy()
    lower = np.zeros((n, n))
    floor = TINY * n * max(diagonal.max(initial=0.0), 0.0)
    for k in range(n):
        p = k + int(np.argmax(diagonal[k:]))
        if diagonal[p] <= floor:
            return lower[:, :k], order
        order[[k, p]], diagonal[[k, p]], lower[[k, p]] = order[[p, k]], diagonal[[p, k]], lower[[p, k]]
        lower[k, k] = np.sqrt(diagonal[k])
        rest = order[k + 1:]
        lower[k + 1:, k] = (a[rest, order[k]] - lower[k + 1:, :k] @ lower[k, :k]) / lower[k, k]
        diagonal[k + 1:] -= lower[k + 1:, k] ** 2
    return lower, order


def _tournament(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of ``n`` columns in rounds of pairs that don't meet, as in a round-robin tournament."""
    seats = list(range(n)) + [-1] * (n % 2)
    half = len(seats) // 2
    for _ in range(len(seats) - 1):
        pairs = [(min(x, y), max(x, y)) for x, y in zip(seats[:half], reversed(seats[half:])) if x >= 0 and y >= 0]
        if pairs:
            yield np.array([p for p, _ in pairs]), np.array([q for _, q in pairs])
        seats = [seats[0], seats[-1], *seats[1:-1]]


def orthogonal_columns(g: np.ndarray, sweeps: int = 40) -> np.ndarray:
    """One-sided Jacobi: plane rotations of column pairs until all columns are orthogonal to working precision."""
    g = g.copy()
    for _ in range(sweeps):
        turned = False
        for p, q in _tournament(g.shape[1]):
            x, y = g[:, p], g[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            turn = np.abs(xy) > TINY * np.sqrt(xx * yy)
            if not turn.any():
                continue
            turned = True
            p, q, x, y = p[turn], q[turn], x[:, turn], y[:, turn]
            zeta = (yy[turn] - xx[turn]) / (2 * xy[turn])
            # the smaller of the two angles that make the pair orthogonal
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            g[:, p], g[:, q] = c * x - s * y, s * x + c * y
        if not turned:
            break
    return g


def principal(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues of a positive semi-definite matrix, falling, and their unit eigenvectors as columns."""
    lower, order = pivoted_cholesky(a)
    g = orthogonal_columns(lower)
    norms = np.sqrt((g * g).sum(axis=0))
    best = np.argsort(-norms, kind="stable")[:most]
    vectors = np.zeros((len(a), len(best)))
    vectors[order] = g[:, best] / norms[best]
    return norms[best] ** 2, vectors


def fit(rows: DataFrame, width: int, components: int = COMPONENTS) -> Fit:
    """Components of ``rows(embedding)``, all usable and ``width`` long."""
    n, sums = _sums(rows, width)
    if not n:
        return Fit(0, sums, np.empty(0), np.empty((width, 0)), 0.0)

    def centred(column: pa.Array) -> Iterator[np.ndarray]:
        for x in _blocks(column, width):
            yield _centred(x, n, sums)

    scatter = _summed_products(rows, "embedding", width, centred)
    values, vectors = principal(scatter / n, components)
    return Fit(n, sums, values, vectors, float(np.trace(scatter) / n))


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row per usable vector of ``vectors(vec_id, embedding)`` and component: ``vec_id, component, n,
    deviation, whitened, explained, identity_error, deviation_text``.

    Vectors that are null, empty, or hold null or non-finite entries are left out, as are entries of
    2^39 and more in size. All vectors should have one length; of several, the most frequent
    (of these the longest) counts and others are left out. There are as many components as the
    scatter's rank if that is below ``components``: none, and so no rows, if all vectors are equal
    or there is none. Repeated rows and ids are each fitted and returned; null ids stay null; other
    columns aren't read. ``deviation`` is NULL beyond 64 bits; ``deviation_text`` has all digits always.
    """
    rows = vectors.select("vec_id", "embedding").where(usable())
    lengths = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    usual = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    width = usual.d if usual else 1
    rows = rows.where(F.size("embedding") == width)
    model = fit(rows, width, components)
    turn = model.components / np.sqrt(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in _blocks(batch.column(1), width):
                off = _offsets(x, model.n, model.sums)
                if off.size and off.dtype != object and int(np.abs(off).max()) ** 2 * width >= 1 << 63:
                    off = off.astype(object)
                deviation = (off * off).sum(axis=1).tolist()
                values = (off / model.n).astype(np.float64) @ turn
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(x)),
                    pa.array([v if v < 1 << 63 else None for v in deviation], pa.int64()),
                    pa.array([str(v) for v in deviation], pa.string()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * turn.shape[1], pa.int32()), pa.array(values.ravel())),
                ], ["vec_id", "deviation", "deviation_text", "w"])
                at += len(x)

    id_type = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, deviation bigint, deviation_text string, w array<double>"
    out = saved(rows.mapInArrow(run, schema), "whitened")
    k = turn.shape[1]

    def whole(column: pa.Array) -> Iterator[np.ndarray]:
        for at in range(0, len(column), BLOCK):
            yield column.slice(at, BLOCK).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)

    error = 0.0
    if k:
        error = float(np.abs(_summed_products(out, "w", k, whole) / model.n - np.eye(k)).max())
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues]).cast("array<double>")
    return out.select("vec_id", "deviation", "deviation_text", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"), "deviation_text")

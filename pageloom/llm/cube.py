"""Mix sources to target weights by balanced sampling: the cube method.

Every document of a source is due ``target / source size`` times. Whole times are taken at
once; the fraction left is an inclusion probability. The flight phase moves three undecided
probabilities at a time along the null space of two constraints, the sum of sizes and the
number of documents, until one of them is 0 or 1. Blocks of a source fly in parallel; the two
documents at most that a block leaves undecided meet in the next level until each source is one
block. Then the last two are landed, together with a reserve of about ``RESERVE`` documents of
the source that stayed out of the flight, so that the taken words come near to the target.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pageloom.llm.tables import saved
from pageloom.session import ship_by_value

ship_by_value(__name__)

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Undecided documents of a block, on average.
BLOCK_ROWS = 4_000
#: Documents of a source (half of them at most) that are left for the landing.
RESERVE = 64
WORD = r"[^\x20\x09-\x0D]+"
EDGE = 1e-9


def text_size(text: Column | str = "text") -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size, target)`` from ``sizes(source, size)``: one row per source.

    Sources in code point order, null last, weigh 5, 2, 1, repeating, and share the total of all
    sizes. A target stops at three times its source's size; what is over goes to the others by
    weight. That is the least level at which ``sum of min(3 * size, level * weight)`` reaches the
    total, found with running sums over the sources in the order in which they stop.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.pmod(F.col("_rank") - 1, F.lit(len(WEIGHTS))).cast("int") + 1)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = per_source.withColumn("_rank", F.row_number().over(by_name)).withColumn("_weight", weight)
    ranked = ranked.withColumn("_cap", MOST_REPEATS * F.col("source_size"))
    # one row per source: the windows without a key hold as many rows as there are sources
    stop_order = Window.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    before = stop_order.rowsBetween(Window.unboundedPreceding, -1)
    after = stop_order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    level = left / F.sum("_weight").over(after)
    leveled = ranked.withColumn("_level", level).withColumn("_open", F.col("_level") <= F.col("_cap") / F.col("_weight"))
    final = F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("_weight"), "_rank", "_level"))).over(everything)["_level"]
    share = F.least(F.col("_cap").cast("double"), F.coalesce(final, F.lit(float("inf"))) * F.col("_weight"))
    return leveled.select("source", "source_size", share.alias("target"))


def fly(size: np.ndarray, chance: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Flight phase: chances moved to 0 or 1 but for two at most; sums of chance and of size * chance stay."""
    chance = chance.copy()
    draws = random.random(len(size) + 2).tolist()
    sizes, p = size.tolist(), chance.tolist()
    held: list[int] = []
    for i in range(len(sizes)):
        if not EDGE < p[i] < 1 - EDGE:
            p[i] = round(p[i])
            continue
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
        if u == (0, 0, 0):
            u = (1, -1, 0)
        top = low = float("inf")  # how far the three may move along u and against it
        for k, v in zip(held, u):
            if v > 0:
                top, low = min(top, (1 - p[k]) / v), min(low, p[k] / v)
            elif v < 0:
                top, low = min(top, p[k] / -v), min(low, (1 - p[k]) / -v)
        step = top if draws[i] * (top + low) < low else -low
        rest = []
        for k, v in zip(held, u):
            p[k] += step * v
            if EDGE < p[k] < 1 - EDGE:
                rest.append(k)
            else:
                p[k] = round(p[k])
        held = rest
    return np.array(p, float)


def land(size: np.ndarray, free: np.ndarray, short: float) -> np.ndarray:
    """Which of the undecided documents (``~free``, two at most) and the reserve (``free``) to take, for sizes that sum up nearest to ``short``.

    For each choice of the undecided ones the reserve fills the rest, larger documents first.
    """
    rest, reserve = np.flatnonzero(~free), np.flatnonzero(free)
    reserve = reserve[np.argsort(-size[reserve], kind="stable")]
    best, best_error = np.zeros(len(size)), float("inf")
    for choice in range(1 << len(rest)):
        taken = np.zeros(len(size))
        taken[rest] = [choice >> k & 1 for k in range(len(rest))]
        left = short - float((size * taken).sum())
        for k in reserve.tolist():
            if abs(left - size[k]) < abs(left):
                taken[k], left = 1.0, left - size[k]
        if abs(left) < best_error:
            best, best_error = taken, abs(left)
    return best


def _flown(rows: DataFrame) -> DataFrame:
    """Rows of a level after the flight of their blocks, ``(source, block)``."""
    columns = [c for c in rows.columns if c != "block"]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("key", "ascending"), ("tie", "ascending")])  # small documents last: they are the ones to land
        seed = zlib.crc32(repr([k.as_py() for k in key]).encode())
        chance = fly(table.column("size").to_numpy(), table.column("chance").to_numpy(), np.random.default_rng(seed))
        at = table.schema.get_field_index("chance")
        return table.set_column(at, "chance", pa.array(chance)).select(columns)

    return rows.groupBy("source", "block").applyInArrow(run, ", ".join(f"{c} {t}" for c, t in rows.select(columns).dtypes))


def sampled(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of ``rows(source, key, tie, size, source_size, target)`` with ``times``: how often each is taken.

    ``key`` and ``tie`` put rows of a source in an order that doesn't depend on partitions; rows
    equal in all of it are interchangeable. Sources of any number of rows are cut into blocks.
    """
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    due = F.when(F.col("size") > 0, due).otherwise(F.least(due, F.lit(float(MOST_REPEATS))))
    base = F.floor(due + EDGE)
    rows = rows.withColumn("base", base.cast("bigint")).withColumn(
        "chance", F.greatest(due - base, F.lit(0.0)))
    rows = saved(rows, "cube_rows")
    open_ = (F.col("chance") > EDGE) & (F.col("chance") < 1 - EDGE)
    draw = F.pmod(F.xxhash64(F.lit("reserve"), "key", "tie"), F.lit(1_000_000)) / 1_000_000
    current = saved(_counted(rows).withColumn("free", open_ & (draw < F.least(F.lit(0.5), RESERVE / F.col("_n")))), "cube_rows")
    reserve = current.where("free").drop("_n")
    current = current.where("not free")
    decided = []
    level = 0
    while True:
        wide = current.withColumn("block", F.pmod(F.xxhash64("key", "tie", F.lit(level)), F.ceil(F.col("_n") / block_rows).cast("int"))).drop("_n")
        flown = saved(_flown(wide), f"cube_level_{level}")
        decided.append(flown.where(~open_))
        current, level = _counted(flown.where(open_)), level + 1
        if current.where(F.col("_n") > block_rows).isEmpty():
            break
    done = decided[0]
    for more in decided[1:]:
        done = done.unionByName(more)
    taken = done.groupBy("source").agg(F.sum(F.col("size") * (F.col("base") + F.col("chance"))).alias("_taken"))
    ends = _landed(current.drop("_n").unionByName(reserve), taken)
    return done.unionByName(ends).withColumn("times", (F.col("base") + F.round("chance")).cast("bigint")).drop("base", "chance", "free")


def _counted(rows: DataFrame) -> DataFrame:
    """Rows with the number of rows of their source, ``_n``."""
    per_source = rows.groupBy(F.col("source").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(saved(per_source, "counts"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def _landed(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """Undecided and reserved rows (``free``) with their chance decided: a bounded number per source."""
    columns = rows.columns
    wide = rows.join(taken.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    wide = wide.withColumn("_taken", F.coalesce("_taken", F.lit(0.0)))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("key", "ascending"), ("tie", "ascending")])
        size, base, chance = (table.column(c).to_numpy().astype(float) for c in ("size", "base", "chance"))
        free = table.column("free").to_numpy()
        seed = zlib.crc32(repr(key[0].as_py()).encode())
        chance[~free] = fly(size[~free], chance[~free], np.random.default_rng(seed))
        last = free | (chance > EDGE) & (chance < 1 - EDGE)
        short = table.column("target")[0].as_py() - table.column("_taken")[0].as_py() - float((size * base).sum() + (size * chance)[~last].sum())
        chance[last] = land(size[last], free[last], short)
        return table.set_column(table.schema.get_field_index("chance"), "chance", pa.array(chance)).select(columns)

    return wide.groupBy("source").applyInArrow(run, ", ".join(f"{c} {t}" for c, t in rows.dtypes))


def mixed(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for each row of ``docs(doc_id, text, source)``.

    ``taken`` are the words that the mix takes of the document, repeats counted; never more than
    three times its size. A null text has size 0; a null source is a source of its own, the last;
    an empty table gives an empty result. Repeated rows are rows of their own. Runs agree, however
    the table is partitioned. Other columns aren't read.
    """
    rows = with_targets(docs.select("doc_id", "source", text_size().alias("size")))
    out = sampled(rows.withColumn("key", F.xxhash64("doc_id")).withColumn("tie", F.col("doc_id")))
    return out.select(F.col("tie").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def with_targets(sizes: DataFrame) -> DataFrame:
    """``sizes(source, size, ...)`` with ``source_size`` and ``target`` of each row's source."""
    sizes = saved(sizes, "sizes")
    facts = saved(source_targets(sizes), "targets").withColumnRenamed("source", "_s")
    return sizes.join(facts, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents: rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``.

    Equal rows are told apart by number only, and share the times that they are taken together.
    """
    plain = [F.to_json(c) if t.startswith(("map", "variant")) else F.col(f"`{c}`") for c, t in docs.dtypes]
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(*plain).alias("tie"), "source", text_size().alias("size"))
    chosen = sampled(with_targets(rows.select("source", "size", "tie")).withColumn("key", F.col("tie")))
    copies = saved(chosen.groupBy("tie").agg(F.sum("times").cast("int").alias("copies")).where("copies > 0"), "copies")
    numbered = rows.select("row", "tie").withColumn("_k", F.row_number().over(Window.partitionBy("tie").orderBy(F.lit(1)))).where("_k = 1")
    taken = numbered.join(copies, "tie")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_k")).select("row.*")

"""Small Column helpers shared by the other modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``.

    A lambda variable is bound to the computed value, so an array that is scanned inside
    another lambda is not rebuilt for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_all(values: list[Column], body: Callable[[list[Column]], Column]) -> Column:
    """``let`` for several values."""
    def bind(done: list[Column]) -> Column:
        if len(done) == len(values):
            return body(done)
        return let(values[len(done)], lambda v: bind([*done, v]))

    return bind([])


def before(array: Column, k: Column, default: int) -> Column:
    """Element before place ``k``; ``default`` before the first."""
    return F.coalesce(F.get(array, k - 1), F.lit(default))


def is_json(text: Column) -> Column:
    """The whole text is one JSON value.

    The parser stops after the first value. A text that goes on after it breaks as the only
    element of a list, or as the only field of an object, or gives the list a second element.
    """
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    field = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.coalesce((F.size(listed) == 1) & field.isNotNull(), F.lit(False))


def one_per_key(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key: the least by ``order``, then by the other columns. Combines before its shuffle."""
    rest = [c for c in rows.columns if c != key]
    ranks = [o.alias(f"_{i}") for i, o in enumerate(order)]
    return rows.groupBy(key).agg(F.min(F.struct(*ranks, *rest)).alias("_row")).select(key, *[f"_row.{c}" for c in rest])


def first(array: Column) -> Column:
    """First element, NULL for an empty array."""
    return F.get(array, F.lit(0))


def join_facts(rows: DataFrame, facts: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join rows with facts of one row per key, ready for a key that most rows share.

    Adaptive execution splits a hot key only if both sides come straight from a shuffle.
    Facts out of an aggregate are partitioned by the key already and would skip theirs, so
    they get the key as a new expression; shuffling them again costs one row per key.
    """
    fresh = facts.withColumn("_key", F.concat(F.col(key).cast("string"), F.lit(""))).drop(key)
    return rows.withColumn("_key", F.col(key).cast("string")).join(fresh, "_key", how).drop("_key")

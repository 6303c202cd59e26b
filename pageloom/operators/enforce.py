"""Model answers to records: parse, normalise, coerce to a schema, scope of failure."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.functions.core import col, is_json, join_facts, let
from pageloom.functions.text import strip

# Texts read as true and false.
TRUE_TEXTS = ["1", "on", "t", "true", "y", "yes"]
FALSE_TEXTS = ["0", "off", "f", "false", "n", "no"]

SPARK_TYPES = {"str": "string", "int": "bigint", "float": "double", "bool": "boolean", "list[str]": "array<string>"}


def strip_fences(text: Column | str) -> Column:
    """Drop code fence lines around an answer. Only a line feed ends a line."""
    opened = F.regexp_replace(strip(F.coalesce(col(text), F.lit(""))), r"(?md)^\x60{3}json[\s\x1c-\x1f\u0085 ]*", "")
    return strip(F.regexp_replace(opened, r"(?md)\x60{3}$", ""))


def parse_response(text: Column | str) -> Column:
    """VARIANT of a model answer, NULL when it is no JSON."""
    return let(strip_fences(text), lambda t: F.when(is_json(t), F.try_parse_json(t)))


def as_items(value: Column) -> Column:
    """Array of VARIANT: the elements of a list, or the one value itself; NULL for no value."""
    return let(
        value,
        lambda v: F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
        .when(v.isNotNull(), F.array(v)),
    )


def parse_responses(responses: DataFrame, text: str = "text") -> DataFrame:
    """Add ``value`` and ``error`` to a table of answers."""
    return responses.withColumn("value", parse_response(text)).withColumn(
        "error", F.when(F.col("value").isNull(), F.lit("The answer is not valid JSON."))
    )


def normalize_records(parsed: DataFrame, keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per record of each parsed answer, ``item_no`` from 0."""
    return parsed.select(*keys, F.posexplode(as_items(F.col("value"))).alias("item_no", "item"))


def _is_number(kind: Column) -> Column:
    return (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")


def _coerced(v: Column, kind: Column, type_: str) -> Column:
    """Value of a VARIANT read leniently as ``type_``; NULL when it cannot be."""
    text = F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
    number = F.when(_is_number(kind), F.try_variant_get(v, "$", "double"))
    flag = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
    if type_ == "str":
        return text
    if type_ == "int":
        whole = F.when(
            strip(text).rlike(r"^[+-]?[0-9]+(?:_[0-9]+)*(?:\.0+)?$"),
            F.regexp_replace(F.regexp_replace(strip(text), r"\.0+$", ""), "_", "").try_cast("bigint"),
        )
        exact = F.when(kind == "BIGINT", F.try_variant_get(v, "$", "bigint"))
        rounded = F.when(number == F.floor(number), number.try_cast("bigint"))
        return F.coalesce(whole, exact, rounded, flag.cast("bigint"))
    if type_ == "float":
        bare = F.lower(strip(text))
        parsed = (
            F.when(bare.rlike(r"^[+-]?nan$"), F.lit(float("nan")))
            .when(bare.rlike(r"^\+?inf(inity)?$"), F.lit(float("inf")))
            .when(bare.rlike(r"^-inf(inity)?$"), F.lit(float("-inf")))
            .when(
                bare.rlike(r"^[+-]?(?:[0-9]+(?:_[0-9]+)*\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?$"),
                F.regexp_replace(bare, "_", "").try_cast("double"),
            )
        )
        return F.coalesce(parsed, number, flag.cast("double"))
    if type_ == "bool":
        word = F.lower(text)
        return F.coalesce(
            flag,
            F.when(word.isin(TRUE_TEXTS) | (number == 1), F.lit(True)),
            F.when(word.isin(FALSE_TEXTS) | (number == 0), F.lit(False)),
        )
    items = F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
    texts = F.forall(items, lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False)))
    return F.when(texts, F.transform(items, lambda x: F.try_variant_get(x, "$", "string")))


def _members(item: Column) -> Column:
    """Members of an object VARIANT as a map; NULL for any other value."""
    return F.when(
        F.schema_of_variant(item).startswith("OBJECT"), F.try_variant_get(item, "$", "map<string,variant>")
    )


def _checked(members: Column, name: Column | str, type_: str, required: Column, nullable: Column,
             default: Column) -> Column:
    """struct(value, error) of one field of a record."""
    name = F.lit(name) if isinstance(name, str) else name
    null = F.lit(None).cast(SPARK_TYPES[type_])

    def answer(value: Column, error: Column) -> Column:
        return F.struct(value.alias("value"), error.cast("string").alias("error"))

    def given(v: Column) -> Column:
        value = _coerced(v, F.schema_of_variant(v), type_)
        return (
            F.when(F.is_variant_null(v) & nullable, answer(null, F.lit(None)))
            .when(value.isNull(), answer(null, F.concat(name, F.lit(f": not a valid {type_}"))))
            .otherwise(answer(value, F.lit(None)))
        )

    return (
        F.when(F.map_contains_key(members, name), let(F.element_at(members, name), given))
        .when(required, answer(null, F.concat(name, F.lit(": missing"))))
        .otherwise(answer(default, F.lit(None)))
    )


def _default(type_: str, default: str | None) -> Column:
    value = None if default is None else json.loads(default)
    return F.lit(value).cast(SPARK_TYPES[type_])


def checked_record(item: Column, fields: list) -> Column:
    """Struct of a VARIANT record: a typed member per field, and ``errors``.

    ``fields``: the few registry rows of the schema (name, type, required, nullable, default),
    by which the struct is built. Unknown keys of the record are dropped.
    """
    def collect(c: Column) -> Column:
        parts = [c[f"_{i}"] for i in range(len(fields))]
        errors = F.filter(F.array(*[part["error"] for part in parts]), lambda e: e.isNotNull())
        return F.struct(*[part["value"].alias(f["name"]) for part, f in zip(parts, fields)], errors.alias("errors"))

    def check(members: Column) -> Column:
        fields_checked = F.struct(*[
            _checked(members, f["name"], f["type"], F.lit(f["required"]), F.lit(f["nullable"]),
                     _default(f["type"], f["default"])).alias(f"_{i}")
            for i, f in enumerate(fields)
        ])
        refused = F.struct(
            *[F.lit(None).cast(SPARK_TYPES[f["type"]]).alias(f["name"]) for f in fields],
            F.array(F.lit("not an object")).alias("errors"),
        )
        return F.when(members.isNull(), refused).otherwise(let(fields_checked, collect))

    return let(_members(item), check)


def enforce(items: DataFrame, fields: list, keys: tuple[str, ...] = ("page_id", "item_no"),
            item: str = "item") -> DataFrame:
    """Records of one schema from item rows: a typed column per field, and ``errors``."""
    return items.select(*keys, checked_record(F.col(item), fields).alias("_r")).select(*keys, "_r.*")


def enforce_each(items: DataFrame, schema: str = "schema", item: str = "item") -> DataFrame:
    """Records of many schemas in one table: the schema is an array column of the row.

    Adds ``record``, the coerced record as JSON text with the fields in schema order, and
    ``errors``. Each row is done on its own; no shuffle.
    """
    def field(f: Column) -> Column:
        def typed(type_: str) -> Column:
            stored = F.from_json(f["default"], f"struct<v:{SPARK_TYPES[type_]}>")["v"]
            return let(
                _checked(F.col("_m"), f["name"], type_, f["required"], f["nullable"], stored),
                lambda c: F.struct(_json_text(c["value"], type_).alias("json"), c["error"].alias("error")),
            )

        chosen = typed("list[str]")
        for type_ in ("bool", "float", "int", "str"):
            chosen = F.when(f["type"] == type_, typed(type_)).otherwise(chosen)
        return let(chosen, lambda c: F.struct(f["name"].alias("name"), c["json"].alias("json"), c["error"].alias("error")))

    wrapped = F.transform(schema, lambda f: f.withField(
        "default", F.when(f["default"].isNotNull(), F.concat(F.lit('{"v":'), f["default"], F.lit("}")))
    ))
    checked = (
        items.withColumn("_m", _members(F.col(item)))
        .withColumn("_f", F.when(F.col("_m").isNotNull(), F.transform(wrapped, field)))
    )
    errors = F.coalesce(
        F.filter(F.transform("_f", lambda c: c["error"]), lambda e: e.isNotNull()), F.array(F.lit("not an object"))
    )
    member = lambda c: F.concat(_json_text(c["name"], "str"), F.lit(":"), c["json"])
    record = F.concat(F.lit("{"), F.array_join(F.transform("_f", member), ","), F.lit("}"))
    return (
        checked.withColumn("errors", errors)
        .withColumn("record", F.when(F.size("errors") == 0, record))
        .drop("_m", "_f")
    )


def _json_text(value: Column, type_: str) -> Column:
    if type_ == "list[str]":
        text = F.to_json(value)
    else:
        text = F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.when(value.isNull(), F.lit("null")).otherwise(text)


def enforce_pages(parsed: DataFrame, fields: list, keys: tuple[str, ...] = ("page_id",),
                  scope: str = "page", value: str = "value") -> DataFrame:
    """Records of parsed answers, one row each, ``item_no`` from 0.

    With ``scope="page"`` one bad record fails its page, which then gives no rows; with
    ``scope="row"`` bad records stay, marked by ``errors``. The records of an answer are
    checked inside its row, so the page-wide test needs no shuffle.
    """
    if scope not in ("page", "row"):
        raise ValueError("scope must be 'page' or 'row'")
    checked = F.transform(as_items(F.col(value)), lambda x: checked_record(x, fields))
    if scope == "page":
        checked = let(checked, lambda all_: F.when(F.forall(all_, lambda r: F.size(r["errors"]) == 0), all_))
    return parsed.select(*keys, F.posexplode(checked).alias("item_no", "_r")).select(*keys, "item_no", "_r.*")


def failed_pages(parsed: DataFrame, fields: list, keys: tuple[str, ...] = ("page_id",),
                 value: str = "value") -> DataFrame:
    """Pages whose answer cannot be used, with the first error."""
    errors = F.flatten(F.transform(as_items(F.col(value)), lambda x: checked_record(x, fields)["errors"]))
    first_error = F.coalesce(F.col("error"), F.get(errors, F.lit(0)))
    return parsed.select(*keys, first_error.alias("error")).where("error IS NOT NULL")


def page_scope(enforced: DataFrame, page: str = "page_id") -> DataFrame:
    """Page scope for records that are rows already: one bad record fails its page.

    Only the ids of bad pages are joined against the rows.
    """
    bad = enforced.where(F.size("errors") > 0).select(page).distinct()
    return join_facts(enforced, bad, page, "left_anti").drop("errors")


def row_scope(enforced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid records, and the rows set aside with their errors."""
    return enforced.where(F.size("errors") == 0).drop("errors"), enforced.where(F.size("errors") > 0)


def extract_answers(responses: DataFrame, fields: list, keys: tuple[str, ...] = ("page_id",),
                    text: str = "text", scope: str = "page") -> DataFrame:
    """Answers to typed records; answers that are no JSON give no rows."""
    parsed = responses.select(*keys, parse_response(text).alias("value"))
    return enforce_pages(parsed, fields, keys, scope)


def records_json(record: Column | str) -> Column:
    """Records as JSON text."""
    return F.to_json(col(record))


def json_records(text: Column | str) -> Column:
    """JSON text back to records."""
    return F.try_parse_json(col(text))

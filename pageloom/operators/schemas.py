"""Record schemas: presets, field specs, name-to-type maps, and how a request picks one.

A schema is an array of field structs in a column, so that a table may hold another schema
in each row; ``registry`` turns such a column into rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.functions.core import col, is_json, let, one_per_key
from pageloom.functions.text import strip

# Type names with their meaning. A trailing "?" makes a type optional.
TYPE_NAMES = {
    "str": "str", "string": "str", "int": "int", "integer": "int", "float": "float",
    "number": "float", "bool": "bool", "boolean": "bool", "list[str]": "list[str]", "list": "list[str]",
}
OPTIONAL_NAMES = [name + "?" for name in TYPE_NAMES if name != "list"]

# Preset schemas as (name, type, required, nullable, default).
PRESETS = {
    "product": [
        ("title", "str", True, False, None),
        ("price", "float", True, False, None),
        ("currency", "str", False, True, "USD"),
        ("rating", "float", False, True, None),
        ("in_stock", "bool", False, False, True),
        ("description", "str", False, True, None),
        ("url", "str", False, True, None),
    ],
    "article": [
        ("headline", "str", True, False, None),
        ("author", "str", False, True, None),
        ("published_date", "str", False, True, None),
        ("summary", "str", True, False, None),
        ("category", "str", False, True, None),
        ("reading_time_min", "int", False, True, None),
    ],
    "job": [
        ("job_title", "str", True, False, None),
        ("company", "str", True, False, None),
        ("location", "str", True, False, None),
        ("salary", "str", False, True, None),
        ("remote", "bool", False, False, False),
        ("requirements", "list[str]", False, True, None),
    ],
}
# Names a preset can be asked for by.
ALIASES = {
    "product": "product", "products": "product",
    "article": "article", "articles": "article",
    "job": "job", "jobs": "job", "job_posting": "job",
}

FIELD_TYPE = "struct<field_no:int,name:string,type:string,required:boolean,nullable:boolean,default:string>"
SCHEMA_TYPE = f"array<{FIELD_TYPE}>"

_IDENTIFIER = r"^[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}]*$"


def _field(field_no: Column, name: Column, type_: Column, required: Column, nullable: Column, default: Column):
    return F.struct(
        field_no.cast("int").alias("field_no"), name.alias("name"), type_.alias("type"),
        required.alias("required"), nullable.alias("nullable"), default.cast("string").alias("default"),
    )


def _preset_fields(preset: str) -> Column:
    return F.array(*[
        _field(F.lit(no), F.lit(name), F.lit(kind), F.lit(required), F.lit(nullable),
               F.lit(None if default is None else json.dumps(default)))
        for no, (name, kind, required, nullable, default) in enumerate(PRESETS[preset])
    ])


def preset_schema(name: Column | str) -> Column:
    """Fields of the preset asked for by ``name``; NULL when there is none."""
    key = F.lower(strip(col(name)))
    chosen = F.lit(None).cast(SCHEMA_TYPE)
    for preset in PRESETS:
        names = [alias for alias, target in ALIASES.items() if target == preset]
        chosen = F.when(key.isin(names), _preset_fields(preset)).otherwise(chosen)
    return chosen


def _known(type_name: Column) -> Column:
    return type_name.isin([*TYPE_NAMES, *OPTIONAL_NAMES])


def _typed(pairs: Column) -> Column:
    """Field structs from an array of (name, type name) with known type names."""
    types = F.create_map(*[F.lit(x) for pair in TYPE_NAMES.items() for x in pair])

    def field(p: Column, no: Column) -> Column:
        optional = p["type"].endswith("?")
        return _field(no, p["name"], F.element_at(types, F.regexp_replace(p["type"], r"\?$", "")),
                      ~optional, optional, F.lit(None))

    return F.transform(pairs, field)


def _last_of_each(pairs: Column) -> Column:
    """One pair per name, in order of first place, with the last type given."""
    names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
    return F.transform(
        names, lambda n: F.element_at(F.filter(pairs, lambda p: p["name"] == n), -1)
    )


def _pair(name: Column, type_: Column) -> Column:
    return F.struct(name.alias("name"), type_.alias("type"))


def spec_schema(spec: Column | str) -> Column:
    """Fields of ``name:type,name:type?``; an empty array when any part is not valid."""
    parts = F.filter(F.transform(F.split(col(spec), ","), strip), lambda p: p != "")
    pairs = F.transform(
        parts,
        lambda p: _pair(strip(F.regexp_extract(p, "(?s)^([^:]*):", 1)),
                        F.lower(strip(F.regexp_extract(p, "(?s)^[^:]*:(.*)$", 1)))),
    )
    good = lambda p: p["name"].rlike(_IDENTIFIER) & _known(p["type"])
    none = F.array().cast(SCHEMA_TYPE)
    return F.coalesce(
        let(pairs, lambda ps: F.when(F.forall(ps, good), _typed(_last_of_each(ps))).otherwise(none)), none
    )


def map_schema(spec: Column | str) -> Column:
    """Fields of a JSON object of name to type; unknown types become optional text.

    NULL when the text is no JSON object.
    """
    entries = F.map_entries(F.when(is_json(col(spec)), F.from_json(col(spec), "map<string,string>", {"allowSingleQuotes": "false"})))

    def pair(e: Column) -> Column:
        given = F.lower(strip(F.coalesce(e["value"], F.lit(""))))
        return _pair(e["key"], F.when(_known(given), given).otherwise(F.lit("str?")))

    return let(F.transform(entries, pair), lambda ps: _typed(_last_of_each(ps)))


def resolve_schema(spec: Column | str, file_content: Column | None = None) -> Column:
    """struct(source, schema, error) for a schema text.

    In order: preset name, schema file (where ``file_content`` is given and not NULL), JSON
    object, field spec.
    """
    spec = col(spec)
    clean = strip(spec)
    is_json = clean.startswith("{") & clean.endswith("}")
    content = F.lit(None).cast("string") if file_content is None else file_content

    def answer(source: str, schema: Column, error: Column | None = None) -> Column:
        return F.struct(
            F.lit(source).alias("source"), schema.cast(SCHEMA_TYPE).alias("schema"),
            (F.lit(None) if error is None else error).cast("string").alias("error"),
        )

    def pick(found: Column) -> Column:
        nothing = F.lit(None).cast(SCHEMA_TYPE)
        return (
            F.when(spec.isNull(), answer("none", nothing, F.lit("No schema is given.")))
            .when(found["preset"].isNotNull(), answer("preset", found["preset"]))
            .when(content.isNotNull() & (F.size(found["file"]) > 0), answer("file", found["file"]))
            .when(content.isNotNull() & (F.size(found["file"]) == 0),
                  answer("none", nothing, F.lit("The schema has no usable field.")))
            .when(content.isNotNull(),
                  answer("none", nothing, F.format_string("The schema file '%s' holds no JSON object.", clean)))
            .when(is_json & (F.size(found["json"]) > 0), answer("json", found["json"]))
            .when(F.size(found["spec"]) > 0, answer("spec", found["spec"]))
            .otherwise(answer("none", nothing, F.format_string("Unrecognized schema '%s'.", spec)))
        )

    return let(
        F.struct(
            preset_schema(clean).alias("preset"), map_schema(content).alias("file"),
            map_schema(F.when(is_json, clean)).alias("json"), spec_schema(clean).alias("spec"),
        ),
        pick,
    )


def resolve_request(preset: Column | str, fields: Column | str) -> Column:
    """struct(source, schema, error) for a request with a preset name and a field map.

    A preset goes before fields; an unknown preset is refused; neither means no schema.
    """
    preset, fields = col(preset), col(fields)
    nothing = F.lit(None).cast(SCHEMA_TYPE)

    def answer(source: str, schema: Column, error: Column) -> Column:
        return F.struct(F.lit(source).alias("source"), schema.alias("schema"), error.cast("string").alias("error"))

    named = F.coalesce(preset, F.lit("")) != ""
    known = preset_schema(preset)
    return (
        F.when(named & known.isNotNull(), answer("preset", known, F.lit(None)))
        .when(named, answer("none", nothing, F.format_string("Invalid schema_preset '%s'.", preset)))
        .when(F.size(map_schema(fields)) > 0, answer("json", map_schema(fields), F.lit(None)))
        .otherwise(answer("none", nothing, F.lit(None)))
    )


def with_schema_files(specs: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``content`` of the schema file a spec names, from ``files(path, content)``."""
    return specs.withColumn("path", strip("spec")).join(one_per_key(files.select("path", "content"), "path"), "path", "left").drop("path")


def registry(specs: DataFrame, schema: Column | str = "schema", keys: tuple[str, ...] = ("schema_id",)) -> DataFrame:
    """Rows of a schema column or expression: keys and one row per field.

    An expression is best given here as such, so that it is computed only once.
    """
    return specs.select(*keys, F.explode(col(schema)).alias("f")).select(*keys, "f.*")

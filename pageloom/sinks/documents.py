"""One document over many files: read in file order, the parts of a folder are one JSON array or one CSV table.

Records are put in order by a range shuffle and written as text, part by part. A part knows
whether it holds the first or the last record of all, and so which brackets and commas it writes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from pageloom.functions.core import let
from pageloom.session import cut_lineage
from pageloom.sinks.export import float_text

# The indent of a level, and how characters are escaped in JSON texts.
INDENT = "  "
ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def _quoted(text: Column) -> Column:
    def replaced(c: Column, pairs: dict[str, str]) -> Column:
        return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs.items(), c)

    others = {chr(k): f"\\u{k:04x}" for k in range(32) if chr(k) not in ESCAPES}
    plain = replaced(text, ESCAPES)
    shown = F.when(text.rlike("[\\x00-\\x07\\x0b\\x0e-\\x1f]"), replaced(plain, others)).otherwise(plain)
    return F.concat(F.lit('"'), shown, F.lit('"'))


def _block(parts: Column, marks: str, level: int) -> Column:
    """Elements of an object or list on lines of their own."""
    inner, outer = "\n" + INDENT * (level + 1), "\n" + INDENT * level
    filled = F.concat(F.lit(marks[0] + inner), F.array_join(parts, "," + inner), F.lit(outer + marks[1]))
    return F.when(F.size(parts) == 0, F.lit(marks)).otherwise(filled)


def json_value(c: Column, kind: T.DataType, level: int = 0) -> Column:
    """JSON text of a value, indented by two blanks a level; other alphabets stay, NULL is null.

    Structs and maps are objects, their members in order; times are texts.
    """
    if isinstance(kind, T.StructType):
        members = [F.concat(_quoted(F.lit(f.name)), F.lit(": "), json_value(c[f.name], f.dataType, level + 1)) for f in kind.fields]
        text = _block(F.array(*members).cast("array<string>"), "{}", level)
    elif isinstance(kind, T.ArrayType):
        text = let(F.transform(c, lambda x: json_value(x, kind.elementType, level + 1)), lambda parts: _block(parts, "[]", level))
    elif isinstance(kind, T.MapType):
        member = lambda e: F.concat(_quoted(e["key"].cast("string")), F.lit(": "), json_value(e["value"], kind.valueType, level + 1))
        text = let(F.transform(F.map_entries(c), member), lambda parts: _block(parts, "{}", level))
    elif isinstance(kind, T.BooleanType):
        text = F.when(c, "true").otherwise("false")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = F.when(F.isnan(c), "NaN").when(F.abs(c) == float("inf"), F.when(c > 0, "Infinity").otherwise("-Infinity")).otherwise(float_text(c))
    elif isinstance(kind, T.NumericType):
        text = c.cast("string")
    else:
        text = _quoted(c.cast("string"))
    return F.when(c.isNull(), F.lit("null")).otherwise(text)


def write_json_document(records: DataFrame, path: str, order: list[str]) -> None:
    """One JSON array with a record per element, indented by two blanks, over the files of a folder.

    The files in order of their names are the document, with a line feed at its end. Records
    that are equal in ``order`` follow one another in any order. No records give ``[]``.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in records.columns])
    text = F.concat(F.lit(INDENT), json_value(row, records.schema, 1))
    lines = cut_lineage(records.orderBy(*order).select(text.alias("line"), F.monotonically_increasing_id().alias("at")))
    ends = lines.agg(F.min("at").alias("first"), F.max("at").alias("last")).first()
    if ends.first is None:
        lines.sparkSession.createDataFrame([("[]",)], "line string").coalesce(1).write.text(path)
        return
    opened = F.when(F.col("at") == ends.first, F.lit("[\n")).otherwise(F.lit(""))
    closed = F.when(F.col("at") == ends.last, F.lit("\n]")).otherwise(F.lit(","))
    lines.select(F.concat(opened, "line", closed)).write.text(path)


def _csv_cell(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        text = F.when(c, "True").when(~c, "False")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = float_text(c)
    elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        text = F.to_json(c, {"ignoreNullFields": "false"})
    else:
        text = c.cast("string")
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[,"\\r\\n]'), quoted).otherwise(text), F.lit(""))


def _csv_line(cells: list[Column]) -> Column:
    """A row with a single empty cell is quoted, since an empty line is no row."""
    return F.when(cells[0] == "", F.lit('""')).otherwise(cells[0]) if len(cells) == 1 else F.concat_ws(",", *cells)


def write_csv_document(records: DataFrame, path: str, order: list[str]) -> None:
    """One CSV table over the files of a folder: the header is in the first file only.

    Lines end with CR LF; cells with a comma, quote or line end are quoted, NULL is empty, nested
    values are JSON. No records give no text.
    """
    writer = {"lineSep": "\r\n"}
    if records.isEmpty():
        records.sparkSession.createDataFrame([], "line string").coalesce(1).write.options(**writer).text(path)
        return
    names = _csv_line([_csv_cell(F.lit(c), T.StringType()) for c in records.columns])
    head = records.sparkSession.range(1).coalesce(1).select(names.alias("line"))
    cells = [_csv_cell(F.col(f"`{f.name}`"), f.dataType) for f in records.schema.fields]
    head.union(records.orderBy(*order).select(_csv_line(cells).alias("line"))).write.options(**writer).text(path)

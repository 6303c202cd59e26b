"""Sinks: JSON, CSV, Markdown, plain text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# What stands for no records in Markdown.
NO_ROWS_MARKDOWN = "*No data extracted.*"

CSV_OPTIONS = {
    "header": True, "escape": '"', "emptyValue": "", "nullValue": "",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def write_json(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON Lines; NULL members stay, other alphabets are kept as they are."""
    records.write.mode(mode).option("ignoreNullFields", "false").json(path)


def json_array(records: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Records of each key, such as a page, as one JSON array text, in order."""
    fields = [c for c in records.columns if c not in order and c not in key]
    row = F.struct(*order, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("j"))
    grouped = records.groupBy(*key).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    text = F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["j"]), ","), F.lit("]"))
    return grouped.select(*key, text.alias("records"))


def write_csv(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header in each part; quotes are doubled, NULL and empty are bare. No records give empty files."""
    records.write.mode(mode).options(**{**CSV_OPTIONS, "header": not records.isEmpty()}).csv(path)


def read_csv(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(header=True, escape='"', multiLine=True, lineSep="\n").csv(path)


def union_records(parts: list[DataFrame]) -> DataFrame:
    """Records with differing keys under one another; missing values are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def same_keys(parts: list[DataFrame]) -> DataFrame:
    """Records under the columns of the first part; a part with other columns is refused.

    Missing columns are NULL, as a CSV file with a fixed header would have them.
    """
    header = parts[0].columns
    for part in parts[1:]:
        extra = [c for c in part.columns if c not in header]
        if extra:
            raise ValueError(f"records contain fields not in the header: {extra}")
    return union_records(parts).select(*header)


def float_text(c: Column) -> Column:
    """A float as 6.55, 10000000.0, 1e+16 or 2.5e-05: exponents from 1e16 up and below 1e-4."""
    shown, size = c.cast("string"), F.abs(c)
    mantissa = F.regexp_replace(F.regexp_extract(shown, "^([^E]*)", 1), r"\.0$", "")
    power = F.regexp_extract(shown, r"E(-?\d+)$", 1).try_cast("int")
    exponent = F.concat(
        mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"),
        F.when(F.abs(power) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(power).cast("string"),
    )
    digits = F.regexp_replace(shown.try_cast("decimal(38,20)").cast("string"), r"0+$", "")
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    return (
        F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf")
        .when((size >= 1e16) | ((size < 1e-4) & (size > 0)), exponent)
        .when((size >= 1e7) | ((size < 1e-3) & (size > 0)), plain)
        .otherwise(shown)
    )


def _cell(name: str, field: T.StructField) -> Column:
    c = F.col(name)
    if isinstance(field.dataType, T.BooleanType):
        text = F.when(c, "True").otherwise("False")
    elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        text = float_text(c)
    else:
        text = c.cast("string")
    shown = F.when(c.isNull(), F.lit("None")).otherwise(text)
    return F.replace(F.replace(shown, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def _markdown_line(cells: list) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def markdown_rows(records: DataFrame, fields: list[str], keys: list[str] | None = None) -> DataFrame:
    """One table line per record, with the keys beside it."""
    cells = [_cell(name, records.schema[name]) for name in fields]
    return records.select(*(keys or []), _markdown_line(cells).alias("line"))


def markdown_header(fields: list[str]) -> str:
    return f"| {' | '.join(fields)} |\n| {' | '.join('---' for _ in fields)} |"


def write_markdown(records: DataFrame, fields: list[str], path: str, order: list[str] | None = None) -> None:
    """Table as text files; read in file order they form one table, header first.

    An ordered write keeps the order over all files by a range shuffle.
    """
    if records.isEmpty():
        lines = records.sparkSession.createDataFrame([(NO_ROWS_MARKDOWN,)], "line string")
    else:
        head = records.sparkSession.createDataFrame([(markdown_header(fields),)], "line string").coalesce(1)
        ordered = records.orderBy(*order) if order else records
        lines = head.union(markdown_rows(ordered, fields))
    lines.write.text(path)


def write_text(pages: DataFrame, path: str, text: str = "clean_text") -> None:
    """Clean text only, a line break after each page."""
    pages.select(text).write.text(path)


def preview_records(records: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """First records in order."""
    return records.orderBy(*order).limit(n)

"""Queries on record schemas, enforcement, prompts and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.operators.enforce import (
    enforce, enforce_each, extract_answers, json_records, normalize_records, parse_responses, records_json,
)
from pageloom.operators.prompts import (
    EXTRACTION_RULES, NO_CONTENT, QA_RULES, ask_all, extraction_prompts, page_lengths, qa_answers, qa_prompts, qa_requests,
)
from pageloom.operators.schemas import (
    preset_schema, registry, resolve_request, resolve_schema, map_schema, spec_schema, with_schema_files,
)
from pageloom.plans.catalog import Catalog, sql_text, table
from pageloom.plans.crawls import ANSWER, ITEMS_SQL, answers, page_texts
from pageloom.plans.html import clean_text_sql

schemas = Catalog()


def preset_fields(spark: SparkSession, name: str) -> list:
    """The few registry rows of a preset."""
    one = spark.range(1).select(F.lit(name).alias("schema_id"))
    return registry(one, preset_schema("schema_id")).orderBy("field_no").collect()


def spec_fields(spark: SparkSession, spec: str) -> list:
    one = spark.range(1).select(F.lit(spec).alias("schema_id"))
    return registry(one, spec_schema("schema_id")).orderBy("field_no").collect()


# schemas

_NAME = """CASE event_id % 8 WHEN 0 THEN 'product' WHEN 1 THEN ' Products ' WHEN 2 THEN 'ARTICLE' WHEN 3 THEN 'articles'
      WHEN 4 THEN 'job' WHEN 5 THEN 'jobs' WHEN 6 THEN 'job_posting' ELSE 'pizza' END"""

_PRESET_ROWS = """f(preset, field_no, name, type, required, nullable, "default") AS (VALUES
  ('product', 0, 'title', 'str', true, false, NULL), ('product', 1, 'price', 'float', true, false, NULL),
  ('product', 2, 'currency', 'str', false, true, '"USD"'), ('product', 3, 'rating', 'float', false, true, NULL),
  ('product', 4, 'in_stock', 'bool', false, false, 'true'), ('product', 5, 'description', 'str', false, true, NULL),
  ('product', 6, 'url', 'str', false, true, NULL),
  ('article', 0, 'headline', 'str', true, false, NULL), ('article', 1, 'author', 'str', false, true, NULL),
  ('article', 2, 'published_date', 'str', false, true, NULL), ('article', 3, 'summary', 'str', true, false, NULL),
  ('article', 4, 'category', 'str', false, true, NULL), ('article', 5, 'reading_time_min', 'int', false, true, NULL),
  ('job', 0, 'job_title', 'str', true, false, NULL), ('job', 1, 'company', 'str', true, false, NULL),
  ('job', 2, 'location', 'str', true, false, NULL), ('job', 3, 'salary', 'str', false, true, NULL),
  ('job', 4, 'remote', 'bool', false, false, 'false'), ('job', 5, 'requirements', 'list[str]', false, true, NULL))"""


@schemas.query("schema_presets", f"""
WITH {_PRESET_ROWS}, e AS (SELECT event_id, {_NAME} AS asked FROM events)
SELECT event_id AS schema_id, asked, field_no, name, type, required, nullable, "default" FROM e JOIN f ON f.preset =
  CASE WHEN event_id % 8 < 2 THEN 'product' WHEN event_id % 8 < 4 THEN 'article' WHEN event_id % 8 < 7 THEN 'job' END""")
def schema_presets(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "events").select(F.col("event_id").alias("schema_id"), F.expr(_NAME).alias("asked"))
    return registry(asked, preset_schema("asked"), ("schema_id", "asked"))


_SPEC = """CASE event_id % 6 WHEN 0 THEN concat(' a', user_id, ' : STR , b:float?,,a', user_id, ':int') WHEN 1 THEN 'title:str,price'
      WHEN 2 THEN 'a-b:str' WHEN 3 THEN 'x:list?' WHEN 4 THEN concat('x:list[str]?,k', user_id, ':number,_y:boolean?,z:list') ELSE ' ' END"""


@schemas.query("schema_spec_rows", """
WITH e AS (SELECT event_id, user_id FROM events)
SELECT event_id AS schema_id, 0 AS field_no, 'a' || user_id AS name, 'int' AS type, true AS required, false AS nullable FROM e WHERE event_id % 6 = 0
UNION ALL SELECT event_id, 1, 'b', 'float', false, true FROM e WHERE event_id % 6 = 0
UNION ALL SELECT event_id, 0, 'x', 'list[str]', false, true FROM e WHERE event_id % 6 = 4
UNION ALL SELECT event_id, 1, 'k' || user_id, 'float', true, false FROM e WHERE event_id % 6 = 4
UNION ALL SELECT event_id, 2, '_y', 'bool', false, true FROM e WHERE event_id % 6 = 4
UNION ALL SELECT event_id, 3, 'z', 'list[str]', true, false FROM e WHERE event_id % 6 = 4""")
def schema_spec_rows(spark: SparkSession, folder: str) -> DataFrame:
    specs = table(spark, folder, "events").select(F.col("event_id").alias("schema_id"), F.expr(_SPEC).alias("spec"))
    return registry(specs, spec_schema("spec")).drop("default")


_MAP = """CASE event_id % 5 WHEN 0 THEN concat('{"n ', user_id, '": "String", "q": " int? ", "w": "weird", "o": 5}')
      WHEN 1 THEN '[1]' WHEN 2 THEN '{}' WHEN 3 THEN 'a:str' ELSE concat('{"k": "bool", "v', user_id, '": null}') END"""


@schemas.query("schema_map_rows", """
WITH e AS (SELECT event_id, user_id FROM events)
SELECT event_id AS schema_id, 0 AS field_no, 'n ' || user_id AS name, 'str' AS type, true AS required, false AS nullable FROM e WHERE event_id % 5 = 0
UNION ALL SELECT event_id, 1, 'q', 'int', false, true FROM e WHERE event_id % 5 = 0
UNION ALL SELECT event_id, 2, 'w', 'str', false, true FROM e WHERE event_id % 5 = 0
UNION ALL SELECT event_id, 3, 'o', 'str', false, true FROM e WHERE event_id % 5 = 0
UNION ALL SELECT event_id, 0, 'k', 'bool', true, false FROM e WHERE event_id % 5 = 4
UNION ALL SELECT event_id, 1, 'v' || user_id, 'str', false, true FROM e WHERE event_id % 5 = 4""")
def schema_map_rows(spark: SparkSession, folder: str) -> DataFrame:
    specs = table(spark, folder, "events").select(F.col("event_id").alias("schema_id"), F.expr(_MAP).alias("spec"))
    return registry(specs, map_schema("spec")).drop("default")


_ANY = """CASE event_id % 9 WHEN 0 THEN ' Product' WHEN 1 THEN concat('f', user_id, '.json') WHEN 2 THEN concat(' {"a', user_id, '": "int"} ')
      WHEN 3 THEN concat('a', user_id, ':int,b:str?') WHEN 4 THEN 'no_such_boat' WHEN 5 THEN '{"a":' WHEN 6 THEN '{}'
      WHEN 7 THEN NULL ELSE '../harbour/tides.json' END"""


@schemas.query("schema_resolve", f"""
WITH e AS (SELECT event_id, user_id, {_ANY} AS spec, event_id % 9 AS k FROM events),
s AS (SELECT event_id, spec, CASE WHEN k = 0 THEN 'preset' WHEN k = 1 AND user_id % 3 < 2 THEN 'file' WHEN k = 2 THEN 'json'
    WHEN k = 3 THEN 'spec' ELSE 'none' END AS source, user_id, k FROM e)
SELECT event_id AS schema_id, source, CASE source WHEN 'preset' THEN 'title,price,currency,rating,in_stock,description,url'
    WHEN 'file' THEN 'item,cost' WHEN 'json' THEN 'a' || user_id WHEN 'spec' THEN 'a' || user_id || ',b' END AS names,
  CASE WHEN spec IS NULL THEN 'No schema is given.'
    WHEN k = 1 AND user_id % 3 = 2 THEN 'The schema file ''f' || user_id || '.json'' holds no JSON object.'
    WHEN source = 'none' THEN 'Unrecognized schema ''' || spec || '''.' END AS error FROM s""")
def schema_resolve(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    files = events.selectExpr(
        "concat('f', user_id, '.json') AS path",
        """CASE WHEN user_id % 3 = 2 THEN '["x"]' ELSE '{"item": "str", "cost": "float"}' END AS content""",
    ).distinct()
    specs = events.select(F.col("event_id").alias("schema_id"), F.expr(_ANY).alias("spec"))
    resolved = with_schema_files(specs, files).withColumn("r", resolve_schema("spec", F.col("content")))
    names = F.array_join(F.transform("r.schema", lambda f: f["name"]), ",")
    return resolved.select("schema_id", "r.source", names.alias("names"), "r.error")


@schemas.query("schema_request", f"""
WITH e AS (SELECT event_id, user_id, CASE event_id % 4 WHEN 0 THEN 'Jobs ' WHEN 1 THEN 'pizza' WHEN 2 THEN '' END AS preset FROM events)
SELECT event_id AS request_id, CASE event_id % 4 WHEN 0 THEN 'preset' WHEN 1 THEN 'none' WHEN 2 THEN 'json' ELSE 'none' END AS source,
  CASE event_id % 4 WHEN 0 THEN 6 WHEN 2 THEN 1 END AS n_fields,
  CASE event_id % 4 WHEN 1 THEN 'Invalid schema_preset ''pizza''.' END AS error FROM e""")
def schema_request(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "events").selectExpr(
        "event_id AS request_id", "CASE event_id % 4 WHEN 0 THEN 'Jobs ' WHEN 1 THEN 'pizza' WHEN 2 THEN '' END AS preset",
        """CASE WHEN event_id % 4 < 3 THEN concat('{"f', user_id, '": "str"}') END AS fields""",
    ).withColumn("r", resolve_request("preset", "fields"))
    n_fields = F.when(F.col("r.schema").isNotNull(), F.size("r.schema"))
    return asked.select("request_id", "r.source", n_fields.alias("n_fields"), "r.error")


# answers to records

@schemas.query("parse_responses", """
SELECT page_id, CASE WHEN page_id % 11 = 3 THEN NULL WHEN page_id % 5 = 1 THEN 'object' ELSE 'array' END AS shape,
  CASE WHEN page_id % 11 = 3 THEN 'The answer is not valid JSON.' END AS error FROM pages""")
def parsed_responses(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.schema_of_variant("value")
    shape = F.when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object")
    return parse_responses(answers(spark, folder)).select("page_id", shape.alias("shape"), "error")


@schemas.query("normalize_records", f"WITH {ITEMS_SQL} SELECT page_id, item_no, title FROM items")
def normalized_records(spark: SparkSession, folder: str) -> DataFrame:
    items = normalize_records(parse_responses(answers(spark, folder)))
    return items.select("page_id", "item_no", F.try_variant_get("item", "$.title", "string").alias("title"))


# Product records with every kind of value a model may give, by event.
_PRODUCT = """concat('{"title": ', CASE WHEN event_id % 13 = 0 THEN '5' ELSE concat('"t', event_id, '"') END,
    ', "price": ', CASE event_id % 7 WHEN 0 THEN '"$10"' WHEN 1 THEN concat('" ', event_id, '.25 "') WHEN 2 THEN 'true' WHEN 3 THEN '"1e3"' ELSE concat(event_id, '.75') END,
    CASE event_id % 3 WHEN 0 THEN ', "currency": null' WHEN 1 THEN ', "currency": "EUR"' ELSE '' END,
    CASE event_id % 5 WHEN 0 THEN ', "in_stock": "Yes"' WHEN 1 THEN ', "in_stock": 0' WHEN 2 THEN ', "in_stock": "In stock"' WHEN 3 THEN ', "in_stock": null' ELSE '' END,
    ', "extra": [1, {}]}')"""

_PRODUCT_SQL = f"""
WITH r AS (SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN 't' || event_id END AS title,
    CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN event_id + 0.25 WHEN 2 THEN 1.0 WHEN 3 THEN 1000.0 ELSE event_id + 0.75 END::DOUBLE AS price,
    CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'EUR' ELSE 'USD' END AS currency,
    CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 4 THEN true END AS in_stock,
    concat_ws('; ', CASE WHEN event_id % 13 = 0 THEN 'title: not a valid str' END, CASE WHEN event_id % 7 = 0 THEN 'price: not a valid float' END,
      CASE WHEN event_id % 5 IN (2, 3) THEN 'in_stock: not a valid bool' END) AS errors FROM events)"""


def _products(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return events.select("event_id", F.try_parse_json(F.expr(_PRODUCT)).alias("item"))


@schemas.query("enforce_product", _PRODUCT_SQL + """
SELECT event_id, title, price, currency, in_stock, NULL::DOUBLE AS rating, NULL::VARCHAR AS description, NULL::VARCHAR AS url, errors FROM r""")
def enforce_product(spark: SparkSession, folder: str) -> DataFrame:
    records = enforce(_products(spark, folder), preset_fields(spark, "product"), ("event_id",))
    return records.withColumn("errors", F.concat_ws("; ", "errors"))


@schemas.query("enforce_each", r"""
WITH r AS (SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k FROM events)
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '{"k":' || k || '}' WHEN event_id % 4 = 1 THEN '{"k":' || k || '.0,"z":null}'
    WHEN event_id % 4 = 2 AND k < 2 THEN '{"k":' || CASE WHEN k = 1 THEN 'true' ELSE 'false' END || '}' END AS record,
  CASE WHEN event_id % 4 = 2 AND k > 1 THEN 'k: not a valid bool' WHEN event_id % 4 = 3 THEN 'k: not a valid str; w: missing' ELSE '' END AS errors FROM r""")
def enforced_each(spark: SparkSession, folder: str) -> DataFrame:
    spec = F.expr("CASE event_id % 4 WHEN 0 THEN 'k:int' WHEN 1 THEN 'k:float,z:str?' WHEN 2 THEN 'k:bool' ELSE 'k:str,w:int' END")
    items = table(spark, folder, "events").select(
        "event_id", F.try_parse_json("props").alias("item"), spec_schema(spec).alias("schema")
    )
    return enforce_each(items).select("event_id", "record", F.concat_ws("; ", "errors").alias("errors"))


@schemas.query("enforce_events_props", r"""
SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, NULL::VARCHAR[] AS tags, '' AS errors FROM events""")
def enforce_events_props(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "events").select("event_id", F.try_parse_json("props").alias("item"))
    records = enforce(items, spec_fields(spark, "k:int,tags:list[str]?"), ("event_id",))
    return records.withColumn("errors", F.concat_ws("; ", "errors"))


# Each event answers with its own record and that of the following event number.
@schemas.query("enforce_page_scope", _PRODUCT_SQL.replace("FROM events)", "FROM (SELECT event_id FROM events UNION SELECT max(event_id) + 1 FROM events) x)") + """
SELECT a.event_id AS page_id, i AS item_no, CASE i WHEN 0 THEN a.title ELSE b.title END AS title,
  CASE i WHEN 0 THEN a.price ELSE b.price END AS price
FROM r a JOIN r b ON b.event_id = a.event_id + 1 CROSS JOIN (VALUES (0), (1)) n(i) WHERE a.errors = '' AND b.errors = ''""")
def enforce_page_scope(spark: SparkSession, folder: str) -> DataFrame:
    both = f"concat('[', {_PRODUCT}, ',', {_PRODUCT.replace('event_id', '(event_id + 1)')}, ']')"
    responses = table(spark, folder, "events").select(F.col("event_id").alias("page_id"), F.expr(both).alias("text"))
    records = extract_answers(responses, preset_fields(spark, "product"))
    return records.select("page_id", "item_no", "title", "price")


@schemas.query("records_json", r"""
SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || '}' AS records FROM events""")
def records_as_json(spark: SparkSession, folder: str) -> DataFrame:
    parsed = json_records("props")
    return table(spark, folder, "events").select("event_id", records_json(parsed).alias("records"))


@schemas.query("ai_extract", f"""
WITH {ITEMS_SQL}
SELECT page_id, item_no, title, price::DOUBLE AS price, 'USD' AS currency, true AS in_stock, '' AS errors FROM items""")
def ai_extract(spark: SparkSession, folder: str) -> DataFrame:
    records = extract_answers(answers(spark, folder), preset_fields(spark, "product"))
    return records.select(
        "page_id", "item_no", "title", "price", "currency", "in_stock", F.concat_ws("; ", "errors").alias("errors")
    )


# prompts and answers

_GOAL = "All article titles"
_QUESTIONS = ["What is this page about?", "Which names does it mention?"]


@schemas.query("extraction_prompts", f"""
WITH {clean_text_sql()}
SELECT page_id, {sql_text(EXTRACTION_RULES)} || E'\\nGOAL: {_GOAL}\\n\\n<webpage>\\n' || left(clean_text, 100000) || E'\\n</webpage>' AS prompt FROM clean""")
def prompts_for_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extraction_prompts(page_texts(spark, folder), _GOAL)


def _qa_prompt_sql(limit: int) -> str:
    return (
        f"{sql_text(QA_RULES)} || E'\\n<webpage>\\n' || left(clean_text, {limit}) "
        f"|| E'\\n</webpage>\\n\\nQUESTION:\\n' || question"
    )


@schemas.query("qa_prompts", f"""
WITH {clean_text_sql()}, q(question_id, question) AS (VALUES (0, {sql_text(_QUESTIONS[0])}), (1, {sql_text(_QUESTIONS[1])}))
SELECT page_id, question_id, {_qa_prompt_sql(100000)} AS prompt, length(left(clean_text, 100000))::INTEGER AS content_length
FROM clean CROSS JOIN q WHERE trim(clean_text) <> ''""")
def prompts_for_questions(spark: SparkSession, folder: str) -> DataFrame:
    return qa_prompts(ask_all(page_texts(spark, folder), _QUESTIONS))


# One question per event, about the page the event's user looked at; every seventh page is blank.
_BLANK = "CASE WHEN page_id % 7 = 0 THEN E' \\n\\t' ELSE clean_text END"


def _requests(spark: SparkSession, folder: str, facts=lambda texts: texts) -> DataFrame:
    """Questions with the texts of their pages, or what ``facts`` makes of those."""
    texts = page_texts(spark, folder).select(
        "page_id", F.when(F.col("page_id") % 7 == 0, F.lit(" \n\t")).otherwise(F.col("clean_text")).alias("clean_text")
    )
    questions = table(spark, folder, "events").selectExpr(
        "user_id AS page_id", "event_id AS question_id", "concat('What is item ', event_id, '?') AS question"
    )
    return qa_requests(facts(texts), questions)


_REQUESTS_SQL = f"""{clean_text_sql()}, r AS (SELECT c.page_id, e.event_id AS question_id, 'What is item ' || e.event_id || '?' AS question,
    {_BLANK} AS clean_text FROM events e JOIN clean c ON c.page_id = e.user_id)"""


@schemas.query("qa_guard", f"""
WITH {_REQUESTS_SQL}
SELECT page_id, question_id, {_qa_prompt_sql(100000)} AS prompt, length(left(clean_text, 100000))::INTEGER AS content_length
FROM r WHERE page_id % 7 <> 0 AND clean_text <> ''""")
def qa_guard(spark: SparkSession, folder: str) -> DataFrame:
    return qa_prompts(_requests(spark, folder))


@schemas.query("qa_answers", f"""
WITH {_REQUESTS_SQL}, g AS (SELECT *, page_id % 7 = 0 OR clean_text = '' AS blank, question_id % 10 AS k FROM r),
m AS (SELECT *, CASE WHEN blank THEN NULL WHEN k = 1 THEN 'quota' WHEN k = 2 THEN 'No response was recorded.' END AS error_message FROM g)
SELECT page_id, question_id, question, CASE WHEN blank THEN {sql_text(NO_CONTENT)} WHEN error_message IS NOT NULL THEN ''
    ELSE 'It is ' || question_id || '.' END AS answer, 'any-model' AS model,
  CASE WHEN blank THEN 0 ELSE length(left(clean_text, 100000))::INTEGER END AS content_length,
  error_message IS NULL AS success, error_message FROM m""")
def answers_to_questions(spark: SparkSession, folder: str) -> DataFrame:
    responses = table(spark, folder, "events").where("event_id % 10 <> 2").selectExpr(
        "user_id AS page_id", "event_id AS question_id",
        "CASE WHEN event_id % 10 <> 1 THEN concat(' It is ', event_id, '.\\n') END AS text",
        "CASE WHEN event_id % 10 = 1 THEN 'quota' END AS error",
    )
    return qa_answers(_requests(spark, folder, page_lengths), responses, "any-model")

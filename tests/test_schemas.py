import json
import math

import pytest
from pyspark.sql import functions as F

from pageloom.operators.enforce import (
    enforce, enforce_each, enforce_pages, extract_answers, failed_pages, normalize_records, page_scope, parse_responses,
    row_scope, strip_fences,
)
from pageloom.operators.schemas import map_schema, preset_schema, registry, resolve_request, resolve_schema, spec_schema

FENCE = "`" * 3


def fields(spark, expression):
    return registry(spark.range(1).withColumnRenamed("id", "schema_id"), expression).orderBy("field_no").collect()


def test_presets(spark):
    product = fields(spark, preset_schema(F.lit(" Products")))
    assert [f["name"] for f in product] == ["title", "price", "currency", "rating", "in_stock", "description", "url"]
    assert [f["required"] for f in product] == [True, True] + [False] * 5
    assert fields(spark, preset_schema(F.lit("pizza"))) == []


SPECS = [
    ("boat:str,seats:int,full:bool?,fare:float", [("boat", "str", True), ("seats", "int", True), ("full", "bool", False), ("fare", "float", True)]),
    (" a : STRING ,, b:list[str]? ", [("a", "str", True), ("b", "list[str]", False)]), ("a:int,b:str,a:bool", [("a", "bool", True), ("b", "str", True)]),
    ("boat:str,fare", []), ("a-b:str", []), ("1a:str", []), ("a:list?", []), ("a:weird", []), ("", []), ("é_1:int", [("é_1", "int", True)]), ("a:str:x", []),
]


def read_all(spark, cases, schema):
    df = spark.createDataFrame([(spec,) for spec, _ in cases], "spec string").select("spec", schema.alias("s"))
    return {r.spec: [(f.name, f.type, f.required) for f in r.s or []] for r in df.collect()}


def test_spec(spark):
    assert read_all(spark, SPECS, spec_schema("spec")) == dict(SPECS)


MAPS = [
    ('{"seats": "int", "boat": "string", "fare": "float?"}', [("seats", "int", True), ("boat", "str", True), ("fare", "float", False)]),
    ("{'a':'int'}", []), ('{"a":"int"} x}', []), ('{"a":"int"} , {"b":"str"}', []), ('{"a":"int"}, "b": 1', []),
    ('{"x": "weird", "a-b": " Float? ", "n": null, "z": 1}', [("x", "str", False), ("a-b", "float", False), ("n", "str", False), ("z", "str", False)]),
    ("[1]", []), ("nope", []),
]


def test_map(spark):
    assert read_all(spark, MAPS, map_schema("spec")) == dict(MAPS)


RESOLVED = [
    ("product", None, "preset", 7), ("x.json", '{"item":"str","cost":"float"}', "file", 2), ("x.json", None, "none", None), ("x.json", "[1]", "none", None),
    ("x.json", "{}", "none", None), ('{"a":"int"}', None, "json", 1), ("{}", None, "none", None), ("{bad}", None, "none", None), ("a:int,b:str", None, "spec", 2),
    ("no_such_boat", None, "none", None), (None, None, "none", None), ("../harbour/tides.json", None, "none", None),
]


def test_resolution_order(spark):
    df = spark.createDataFrame([case[:2] for case in RESOLVED], "spec string, content string")
    got = [r.r for r in df.select(resolve_schema("spec", F.col("content")).alias("r")).collect()]
    for case, r in zip(RESOLVED, got):
        assert (r.source, r.schema and len(r.schema), r.error is None) == (case[2], case[3], case[3] is not None), case


def test_requests(spark):
    rows = [("job", '{"a":"str"}'), ("../x", None), (None, '{"a":"str"}'), ("", None), (None, "{}")]
    df = spark.createDataFrame(rows, "p string, f string").select(resolve_request("p", "f").alias("r"))
    assert [(r.r.source, r.r.schema and len(r.r.schema), bool(r.r.error)) for r in df.collect()] == [
        ("preset", 6, False), ("none", None, True), ("json", 1, False), ("none", None, False), ("none", None, False)
    ]


VALUES = [
    "a", "12", " 12 ", "12.0", "12.", "12.5", "1_000", "1__0", "+5", "-7", "1e3", "nan", "-inf", "Infinity", "$10", "1,000", "", "yes", "ON", "T", "0", "off", "In stock",
    " yes", "true", 5, 12.0, 12.5, 0, 1, 1.0, 2, -3, True, False, None, [], ["a"], ["a", 1], ["a", None], {"x": 1}, 10 ** 12, 1e20, 0.1, ".5", "5.", "1_0.5", "0x1", "١٢",
]


@pytest.mark.parametrize("spec", ["str", "int", "float", "bool", "list[str]", "str?", "int?", "float?", "bool?", "list[str]?"])
def test_coercion_agrees_with_the_validation_library(spark, spec):
    pydantic = pytest.importorskip("pydantic")
    base = {"str": str, "int": int, "float": float, "bool": bool, "list[str]": list[str]}[spec.rstrip("?")]
    model = pydantic.create_model("M", v=(base | None, None) if spec.endswith("?") else (base, ...))

    def expected(value):
        try:
            got = model.model_validate(value).v
        except pydantic.ValidationError:
            return "refused"
        if isinstance(got, int) and not isinstance(got, bool) and abs(got) >= 2 ** 63:
            return "refused"  # beyond a bigint
        return "nan" if isinstance(got, float) and math.isnan(got) else got

    items = [{"v": v, "other": 1} for v in VALUES] + [{}]
    df = spark.createDataFrame([(i, json.dumps(item)) for i, item in enumerate(items)], "i int, j string")
    got = enforce(df.select("i", F.parse_json("j").alias("item")), fields(spark, spec_schema(F.lit(f"v:{spec}"))), ("i",))
    for r in got.collect():
        value = "nan" if isinstance(r.v, float) and math.isnan(r.v) else r.v
        assert ("refused" if r.errors else value) == expected(items[r.i]), items[r.i]


def test_defaults_and_nulls(spark):
    rows = [(0, '{"title":"a","price":1}'), (1, '{"title":"a","price":1,"currency":null,"in_stock":null}'), (2, '["x"]'), (3, '{"price":"x"}')]
    items = spark.createDataFrame(rows, "i int, j string").select("i", F.parse_json("j").alias("item"))
    got = {r.i: r for r in enforce(items, fields(spark, preset_schema(F.lit("product"))), ("i",)).collect()}
    assert (got[0].currency, got[0].in_stock, got[0].rating, got[0].errors) == ("USD", True, None, [])
    assert (got[1].currency, got[1].errors) == (None, ["in_stock: not a valid bool"])
    assert got[2].errors == ["not an object"]
    assert got[3].errors == ["title: missing", "price: not a valid float"]


def test_many_schemas(spark):
    rows = [('{"a":"x\\"y","b":[1]}', "a:str"), ('{"a":"2"}', "a:int,c:list[str]?"), ('{"a":[]}', "a:list"), ('{"a":1.5}', "a:int"), ("5", "a:int"), ('{"b":"é"}', "b:str,f:float?")]
    df = spark.createDataFrame(rows, "j string, s string").select(F.parse_json("j").alias("item"), spec_schema("s").alias("schema"))
    got = [(r.record and json.loads(r.record), r.errors) for r in enforce_each(df).collect()]
    assert got == [({"a": 'x"y'}, []), ({"a": 2, "c": None}, []), ({"a": []}, []), (None, ["a: not a valid int"]), (None, ["not an object"]), ({"b": "é", "f": None}, [])]


FENCED = [
    (f"{FENCE}json\n[1]\n{FENCE}", "[1]"), (f"{FENCE}\n[1]\n{FENCE}", "[1]"), ("  [1]\n", "[1]"), ("", ""), (None, ""), (f"[1] {FENCE}", "[1]"),
    (f"{FENCE}json[1]{FENCE}", "[1]"), (f"a {FENCE}json\n[1]", f"a {FENCE}json\n[1]"),
]


def test_fences(spark):
    df = spark.createDataFrame(FENCED, "t string, e string").select("t", strip_fences("t").alias("got"))
    assert {r.t: r.got for r in df.collect()} == dict(FENCED)


def answers(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "page_id int, text string")


def test_answers(spark):
    texts = ['[{"title": "Valid Book", "price": 24.99, "in_stock": true}]', '[{"title":"Any Item","price":"$15"}]', "not json",
             '{"title":"One","price":"3"}', '[{"title":"A","price":1},{"title":"B"}]', "[]", ""]
    product = fields(spark, preset_schema(F.lit("product")))
    rows = extract_answers(answers(spark, texts), product).orderBy("page_id", "item_no").collect()
    assert [(r.page_id, r.item_no, r.title, r.price, r.currency) for r in rows] == [(0, 0, "Valid Book", 24.99, "USD"), (3, 0, "One", 3.0, "USD")]
    by_row = extract_answers(answers(spark, texts), product, scope="row")
    assert sorted((r.page_id, r.item_no, bool(r.errors)) for r in by_row.collect()) == [(0, 0, False), (1, 0, True), (3, 0, False), (4, 0, False), (4, 1, True)]
    good, bad = row_scope(by_row)
    assert (good.count(), bad.count()) == (3, 2)
    assert sorted(r.page_id for r in page_scope(by_row).collect()) == [0, 3]
    failed = failed_pages(parse_responses(answers(spark, texts)), product)
    assert {r.page_id: r.error for r in failed.collect()} == {
        1: "price: not a valid float", 2: "The answer is not valid JSON.", 4: "price: missing", 6: "The answer is not valid JSON."
    }
    with pytest.raises(ValueError):
        enforce_pages(parse_responses(answers(spark, texts)), product, scope="all")


def test_answers_without_schema(spark):
    rows = normalize_records(parse_responses(answers(spark, ['[{"title":"Any Item","price":"$15"}]', '{"a":1}', "x"]))).orderBy("page_id").collect()
    assert [(r.page_id, r.item_no, json.loads(r.item.toJson())) for r in rows] == [(0, 0, {"title": "Any Item", "price": "$15"}), (1, 0, {"a": 1})]


def test_an_answer_is_json_as_a_whole(spark):
    cases = {
        '[1,2]': True, '[1,2] trailing': False, '{"a":1} {"a":2}': False, '1, 2': False, '{"a":1}, "b": 2': False, '"x"': True, 'null': True,
        FENCE + 'json\n{"a":1}\n' + FENCE: True, '{"a":1}\n' + FENCE + '\nand more': False, '': False, '] [': False, '1], [2': False, '{"a":[1}': False,
    }
    df = parse_responses(spark.createDataFrame([(t,) for t in cases], "text string"))
    assert {r.text: r.good for r in df.select("text", F.col("value").isNotNull().alias("good")).collect()} == cases

import glob
import json
import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from conftest import column, pages_of
from pageloom.functions.nodes import clean_text
from pageloom.session import scratch_path, shared_dir
from pageloom.sinks.export import (
    json_array, markdown_header, markdown_rows, preview_records, read_csv, same_keys, union_records, write_csv, write_json, write_markdown, write_text,
)
from pageloom.sources.pages import read_html_files, read_text_files, save_dom


def content(path):
    return "".join(open(p, encoding="utf-8", newline="").read() for p in sorted(glob.glob(f"{path}/part-*")))


def items(spark):
    return spark.createDataFrame([("Item 1", "$10"), ("Item 2", "$20")], "name string, price string")


def test_json(spark, tmp_path):
    write_json(spark.createDataFrame([(1, None, "é")], "a int, b string, c string"), str(tmp_path / "j"))
    assert content(tmp_path / "j") == '{"a":1,"b":null,"c":"é"}\n'
    rows = spark.createDataFrame([("p", 1, "b"), ("p", 0, None)], "page string, no int, v string")
    assert json.loads(json_array(rows, ["page"], ["no"]).first().records) == [{"v": None}, {"v": "b"}]


def test_csv_text(spark, tmp_path):
    rows = spark.createDataFrame([('a,"b"', None, ""), ("x\ny", "c\\d", " e ")], "a string, b string, c string")
    write_csv(rows.coalesce(1), str(tmp_path / "c"))
    assert content(tmp_path / "c") == 'a,b,c\n"a,""b""",,\n"x\ny",c\\d, e \n'
    back = read_csv(spark, str(tmp_path / "c"), "a string, b string, c string").collect()
    assert [tuple(r) for r in back] == [('a,"b"', None, None), ("x\ny", "c\\d", " e ")]


def test_csv_keys(spark):
    more = spark.createDataFrame([("Item 3", 5)], "name string, stars int")
    assert [tuple(r) for r in union_records([items(spark), more]).collect()][2] == ("Item 3", None, 5)
    with pytest.raises(ValueError):
        same_keys([items(spark), more])
    assert [tuple(r) for r in same_keys([items(spark), more.select("name")]).collect()][2] == ("Item 3", None)


def test_markdown(spark, tmp_path):
    write_markdown(items(spark), ["name", "price"], str(tmp_path / "m"), order=["name"])
    assert content(tmp_path / "m") == "| name | price |\n| --- | --- |\n| Item 1 | $10 |\n| Item 2 | $20 |\n"
    write_markdown(items(spark).limit(0), ["name"], str(tmp_path / "empty"))
    assert content(tmp_path / "empty") == "*No data extracted.*\n"
    assert markdown_header(["a"]) == "| a |\n| --- |"


def test_markdown_floats(spark):
    values = [6.55, 0.0, 1e7, 1.5e15, 1e16, 2.5e-5, 0.0001, 123456789.125, -1e22, 1e-7, float("nan"), float("inf"), -2.5]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    assert [r.line for r in markdown_rows(df, ["v"], ["i"]).orderBy("i").collect()] == [f"| {v} |" for v in values]


def test_markdown_cells(spark):
    df = spark.createDataFrame([(None, "a|b\nc", True)], "a string, b string, c boolean")
    assert markdown_rows(df, ["a", "b", "c"]).first().line == "| None | a\\|b c | True |"


def test_text_and_preview(spark, tmp_path):
    write_text(spark.createDataFrame([("a\nb",)], "clean_text string"), str(tmp_path / "t"))
    assert content(tmp_path / "t") == "a\nb\n"
    assert [r.id for r in preview_records(spark.range(100), ["id"]).collect()] == [0, 1, 2, 3, 4]


def test_saved_files(spark, tmp_path):
    (tmp_path / "one.html").write_text("<p>é</p>", encoding="utf-8")
    (tmp_path / "schema.txt").write_text('{"a":\n"str"}')
    assert read_html_files(spark, str(tmp_path / "one.html")).first().html == "<p>é</p>"
    (tmp_path / "bad.html").write_bytes(b"<p>\xff</p>")
    assert read_html_files(spark, str(tmp_path / "bad.html")).first().html == "<p>\ufffd</p>"
    assert read_text_files(spark, str(tmp_path / "*.txt")).first().content == '{"a":\n"str"}'


def test_saved_nodes(spark, tmp_path):
    pages = pages_of(spark, [("<p class=a>x<script>y</script>z", "u0"), ("", "u1"), (None, "u2")])
    saved = save_dom(pages.drop("html"), str(tmp_path / "dom"))
    assert column(saved, clean_text("dom")) == ["xz", "", ""]


class _Session:
    """A session whose setting and master can be chosen."""

    def __init__(self, spark, folder, master, context_folder=None):
        self.conf = {"spark.checkpoint.dir": folder}
        get = spark.sparkContext.getCheckpointDir if context_folder is None else (lambda: context_folder or None)
        self.sparkContext = SimpleNamespace(master=master, getCheckpointDir=get, setCheckpointDir=spark.sparkContext.setCheckpointDir)


def test_shared_folder(spark):
    local = shared_dir(_Session(spark, "", "local[2]"))
    assert local == spark.sparkContext.getCheckpointDir() == shared_dir(_Session(spark, "", "local[2]"))
    assert shared_dir(_Session(spark, "/shared/place", "yarn")) == "/shared/place"
    assert scratch_path(_Session(spark, "/shared/place", "yarn"), "x").startswith("/shared/place/x-")
    # a folder that a job gave its context counts as a choice; on a cluster none is made up
    assert shared_dir(_Session(spark, "", "yarn", "/given/place")) == "/given/place"
    with pytest.raises(ValueError):
        shared_dir(_Session(spark, "", "yarn", ""))


@pytest.mark.parametrize("missing", ["public_tokenizers", "pageloom.llm"])
def test_other_queries_stay_without_the_corpus_operators(missing):
    """A fresh interpreter in which one module can't be imported."""
    code = f"""
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == {missing!r} or name.startswith({missing!r} + "."):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
names = set(e.queries())
assert "page_links" in names and set(e.oracle_sql()) <= names
assert not any(n.startswith("op") or n == "pipeline" for n in names), names
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr

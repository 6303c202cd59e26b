"""Documents over several files, charsets of saved pages, and snapshots of the ledger."""

import csv
import datetime
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from pageloom.functions.charsets import decoded
from pageloom.operators.ledger import EVENT_SCHEMA, get_task, ledger_state
from pageloom.operators.snapshots import read_snapshot, refreshed, save_snapshot, snapshot_task
from pageloom.sinks.documents import write_csv_document, write_json_document
from pageloom.sources.pages import decode_files, read_html_files
from test_io import content

RECORDS = [
    {"id": i, "name": name, "price": price, "ok": ok, "tags": tags, "sub": sub, "more": more}
    for i, (name, price, ok, tags, sub, more) in enumerate([
        ('a "b" \\ /', 1.5, True, ["x", None, "é\n"], {"u": 1, "v": None}, {}), (None, None, None, None, None, None),
        ("\x01\x1f\t\r\b\f \x7f", 1e16, False, [], {"u": None, "v": "日本"}, {"": []}),
        ("", -2.5e-07, True, [""], {"u": -3, "v": ""}, {"a\"": None}), ("plain", 10000000.0, False, ["1"], {"u": 2, "v": "w"}, {"z": ["p", "q"]}),
    ])
]
SCHEMA = "id int, name string, price double, ok boolean, tags array<string>, sub struct<u: int, v: string>, more map<string, array<string>>"


def frame(spark, records):
    return spark.createDataFrame([tuple(r.values()) for r in records], SCHEMA)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_json_document_equals_the_library(spark, tmp_path, parts):
    many = [{**r, "id": 10 * k + r["id"]} for k in range(6) for r in RECORDS]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_json_document(frame(spark, many).repartition(4), str(tmp_path / "j"), ["id"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert content(tmp_path / "j") == json.dumps(many, indent=2, ensure_ascii=False) + "\n"


def test_json_document_of_one_and_no_record(spark, tmp_path):
    write_json_document(frame(spark, RECORDS[:1]), str(tmp_path / "one"), ["id"])
    assert json.loads(content(tmp_path / "one")) == RECORDS[:1]
    write_json_document(frame(spark, []), str(tmp_path / "none"), ["id"])
    assert content(tmp_path / "none") == "[]\n"
    odd = spark.createDataFrame([(float("nan"),), (float("-inf"),)], "`a.b` double")
    write_json_document(odd.coalesce(1), str(tmp_path / "odd"), ["`a.b`"])
    assert content(tmp_path / "odd") == '[\n  {\n    "a.b": -Infinity\n  },\n  {\n    "a.b": NaN\n  }\n]\n'


def test_csv_document_equals_the_library(spark, tmp_path):
    rows = [(1, 'a,"b"', None, 6.55, True), (2, " x ", "", 1e16, False), (3, "n\nl", "c\r", 1e-5, None), (4, None, "é;'", None, True)]
    df = spark.createDataFrame(rows, "id int, a string, `b,c` string, d double, e boolean").repartition(3)
    write_csv_document(df, str(tmp_path / "c"), ["id"])
    out = io.StringIO(newline="")
    writer = csv.DictWriter(out, df.columns)
    writer.writeheader()
    writer.writerows(dict(zip(df.columns, r)) for r in rows)
    assert content(tmp_path / "c") == out.getvalue()
    write_csv_document(df.limit(0), str(tmp_path / "none"), ["id"])
    assert content(tmp_path / "none") == ""
    write_csv_document(spark.createDataFrame([("",), ("x",)], "a string"), str(tmp_path / "single"), ["a"])
    assert content(tmp_path / "single") == 'a\r\n""\r\nx\r\n'


# charsets

TEXTS = {
    "cp1251": "Паромы ходят каждый час, кроме воскресенья. Билеты продаются на пристани.",
    "iso8859-7": "Το πλοίο φεύγει κάθε πρωί από το λιμάνι. Επόμενη σελίδα",
    "cp1252": "Die Fähre fährt täglich über den Fluß, außer an Feiertagen – déjà vu, señor!",
    "cp932": "次の船は午後三時に出ます。切符は港で売っています。テスト",
    "euc_jp": "次の船は午後三時に出ます。切符は港で売っています。テスト",
    "utf-8": "Die Fähre – 次の船 – Паром",
}


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_charset_by_bytes_alone(name):
    page = f"<html><title>t</title><body><p>{TEXTS[name]}</p>"
    assert decoded(page.encode(name), None) == (name, "bytes", page)


def test_order_of_evidence():
    text = "<p>Fähre é</p>"
    assert decoded(b"\xef\xbb\xbf" + text.encode(), "text/html; charset=iso-8859-1") == ("utf-8", "mark", text)
    assert decoded(text.encode("utf-16"), None)[::2] == ("utf-16-le", text)
    meta = f'<META http-equiv="Content-Type" content="text/html; charset=windows-1251">{text}'
    assert decoded(meta.encode("latin-1"), "text/html; charset=ISO-8859-1") == ("cp1252", "header", meta)
    page = '<meta charset="shift_jis"><p>日本</p>'
    assert decoded(page.encode("cp932"), "text/html") == ("cp932", "meta", page)
    assert decoded(page.encode("cp932"), "text/html; charset=no-such")[1] == "meta"
    assert decoded(b'<meta charset="utf-16">' + "é".encode(), None)[:2] == ("utf-8", "meta")
    assert decoded(b'<meta charset="base64">plain', None)[:2] == ("utf-8", "bytes")
    assert decoded(b"x" * 2000 + b'<meta charset="cp1251">', None)[1] == "bytes"
    assert decoded(b"", None) == ("utf-8", "bytes", "") and decoded(None, "x") == (None, None, None)
    assert decoded(b"a\xff", "text/html; charset=utf-8")[2] == "a�"


def test_mixed_files(spark, tmp_path):
    for name, text in TEXTS.items():
        (tmp_path / f"{name}.html").write_bytes(f"<p>{text}</p>".encode(name))
    (tmp_path / "bom.html").write_bytes("<p>é</p>".encode("utf-16"))
    got = read_html_files(spark, str(tmp_path / "*.html"), encoding=None).collect()
    assert {r.url.split("/")[-1][:-5]: r.html for r in got} == {**{n: f"<p>{t}</p>" for n, t in TEXTS.items()}, "bom": "<p>é</p>"}
    files = spark.createDataFrame([(1, "u", b"\xe9"), (2, "v", None)], "page_id bigint, url string, content binary")
    headers = spark.createDataFrame([("u", None), ("u", "text/html; charset=cp1250"), ("u", "text/html; charset=cp1250")], "url string, content_type string")
    assert {r.url: (r.charset, r.html) for r in decode_files(files, headers).collect()} == {"u": ("cp1250", "é"), "v": (None, None)}


# snapshots

T0 = datetime.datetime(2024, 1, 1)


def random_events(n, seed):
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        task = rng.choice(["hot", "hot", None, *(f"t{i}" for i in range(25))])
        kind = rng.choices(["create", "update", "delete"], [2, 6, 1])[0]
        out.append((seq, task, kind, rng.choice(["running", "failed"]) if kind == "update" else None, f"u{seq}", rng.randrange(3),
                    rng.choice([None, "[1]"]), rng.choice([None, "e"]), T0 + datetime.timedelta(seconds=seq)))
    return out


def rows(state):
    return sorted((tuple(r) for r in state.collect()), key=str)


def test_snapshots_equal_the_state_of_all_events(spark, tmp_path):
    events = random_events(900, 5)
    all_ = spark.createDataFrame(events, EVENT_SCHEMA).repartition(4)
    path = None
    for step, stop in enumerate([0, 1, 200, 200, 650, 900]):
        path = save_snapshot(all_.where(F.col("seq") < stop), str(tmp_path / f"s{step}"), path)
        state, seen = read_snapshot(spark, path)
        want = ledger_state(all_.where(F.col("seq") < stop))
        assert rows(state.select(*want.columns)) == rows(want)
        assert seen == (stop - 1 if stop else -(1 << 63))


def test_a_refresh_reads_new_events_and_a_get_one_bucket(spark, tmp_path):
    events = str(tmp_path / "events")
    spark.createDataFrame(random_events(400, 6), EVENT_SCHEMA).write.parquet(events)
    stored = spark.read.schema(EVENT_SCHEMA).parquet(events)
    path = save_snapshot(stored.where("seq < 300"), str(tmp_path / "a"))
    state, seen = read_snapshot(spark, path)
    plan = refreshed(state, stored.where(F.col("seq") > seen))._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "/events" in line]
    assert scans and all(f"GreaterThan(seq,{seen})" in line for line in scans)
    task = next(r.task_id for r in state.collect() if r.task_id)
    one = snapshot_task(state, task)
    assert rows(one) == rows(get_task(ledger_state(stored.where("seq < 300")), task))
    scan = next(line for line in one._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line)
    assert "PartitionFilters: [isnotnull(bucket" in scan and "xxhash64" not in scan

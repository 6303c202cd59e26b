"""Queries on the task ledger, batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.operators.crawl import crawl_chains, crawl_records
from pageloom.operators.enforce import normalize_records, parse_responses
from pageloom.operators.ledger import (
    created_tasks, deleted_tasks, finish_events, get_task, ledger_state, list_tasks, start_events, task_view,
)
from pageloom.operators.snapshots import read_snapshot, save_snapshot
from pageloom.plans.catalog import Catalog, table
from pageloom.plans.crawls import ITEMS_SQL, answers
from pageloom.session import scratch_path
from pageloom.streaming.keyed import ledger_state_stream
from pageloom.streaming.run import run_available, stream_table

tasks = Catalog()

# Ledger events out of the event table: the task is the user. A signup creates; a view, click
# or error changes the status; a purchase completes, and every 25th event deletes if it is one.
_EVENT = [
    "event_id AS seq", "concat('task-', user_id) AS task_id",
    "CASE WHEN event_type = 'signup' THEN 'create' WHEN event_type = 'purchase' AND event_id % 25 = 0 THEN 'delete' ELSE 'update' END AS kind",
    "CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'completed' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS status",
    "concat('https://h', user_id % 20, '.example.com/', event_id) AS url",
    "CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS records_count",
    "CASE WHEN event_type IN ('click', 'purchase') THEN concat('[', props, ']') END AS records",
    "CASE WHEN event_type = 'error' THEN concat('error ', event_id) END AS error_message",
]


def _events(events: DataFrame) -> DataFrame:
    return events.selectExpr(*_EVENT, "CAST(ts AS TIMESTAMP) AS at")


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    return _events(table(spark, folder, "events"))


# Step by step over the events of each task: is it live, and since when.
_LEDGER_SQL = f"""
WITH ev AS (SELECT {", ".join(_EVENT)}, ts FROM events),
b AS (SELECT *, coalesce(last_value(CASE WHEN kind <> 'update' THEN kind END IGNORE NULLS) OVER
    (PARTITION BY task_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'delete') = 'create' AS was_live FROM ev),
lives AS (SELECT *, sum(CASE WHEN kind = 'create' AND NOT was_live THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY seq) AS life FROM b),
kept AS (SELECT * FROM lives WHERE (kind = 'create' AND NOT was_live) OR (kind <> 'create' AND was_live)),
final AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) AS back,
    max(life) OVER (PARTITION BY task_id) AS last_life FROM kept),
born AS (SELECT task_id, life, url, ts FROM kept WHERE kind = 'create'),
state AS (SELECT f.task_id, CASE f.kind WHEN 'create' THEN 'pending' ELSE f.status END AS status, born.url,
    CASE f.kind WHEN 'create' THEN 0 ELSE f.records_count END AS records_count,
    CASE f.kind WHEN 'create' THEN NULL ELSE f.records END AS records,
    CASE f.kind WHEN 'create' THEN NULL ELSE f.error_message END AS error_message,
    born.ts AS created_at, f.ts AS updated_at, f.seq AS seq
  FROM final f JOIN born ON born.task_id = f.task_id AND born.life = f.life WHERE f.back = 1 AND f.kind <> 'delete')"""


@tasks.query("ledger_create", _LEDGER_SQL + """
SELECT seq, task_id, url, NOT was_live AS accepted FROM b WHERE kind = 'create'""")
def ledger_create(spark: SparkSession, folder: str) -> DataFrame:
    return created_tasks(_ledger(spark, folder))


@tasks.query("ledger_delete", _LEDGER_SQL + """
SELECT seq, task_id, was_live AS deleted FROM b WHERE kind = 'delete'""")
def ledger_delete(spark: SparkSession, folder: str) -> DataFrame:
    return deleted_tasks(_ledger(spark, folder))


@tasks.query("ledger_snapshot", _LEDGER_SQL + """
SELECT task_id, status, url, records_count, records, error_message, epoch_us(created_at) AS created_us, epoch_us(updated_at) AS updated_us FROM state""")
def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The state in three steps, each from the snapshot before and the events after it."""
    events = _ledger(spark, folder)
    last = events.agg(F.max("seq").alias("seq")).first().seq or 0
    path = None
    for share in (3, 2, 1):
        path = save_snapshot(events.where(F.col("seq") <= last // share), scratch_path(spark, "snapshot"), path)
    current, _ = read_snapshot(spark, path)
    return current.select(
        "task_id", "status", "url", "records_count", "records", "error_message",
        F.unix_micros("created_at").alias("created_us"), F.unix_micros("updated_at").alias("updated_us"),
    )


@tasks.query("ledger_state", _LEDGER_SQL + """
SELECT task_id, status, url, records_count, records, error_message, epoch_us(created_at) AS created_us, epoch_us(updated_at) AS updated_us FROM state""")
def state(spark: SparkSession, folder: str) -> DataFrame:
    current = ledger_state(_ledger(spark, folder))
    return current.select(
        "task_id", "status", "url", "records_count", "records", "error_message",
        F.unix_micros("created_at").alias("created_us"), F.unix_micros("updated_at").alias("updated_us"),
    )


@tasks.query("ledger_get", _LEDGER_SQL + """
SELECT task_id, status, url, records_count, records, error_message FROM state WHERE task_id = 'task-8'""")
def ledger_get(spark: SparkSession, folder: str) -> DataFrame:
    return get_task(ledger_state(_ledger(spark, folder)), "task-8")


@tasks.query("ledger_list", _LEDGER_SQL + """
SELECT task_id, status, url, records_count, error_message FROM state ORDER BY created_at DESC, task_id LIMIT 50""")
def ledger_list(spark: SparkSession, folder: str) -> DataFrame:
    return list_tasks(_ledger(spark, folder)).drop("created_at", "updated_at")


@tasks.query("ledger_records", _LEDGER_SQL + r"""
SELECT task_id, records_count, CASE WHEN records IS NOT NULL THEN json_extract_string(records, '$[0].k')::BIGINT END AS k FROM state""")
def ledger_records(spark: SparkSession, folder: str) -> DataFrame:
    view = task_view(ledger_state(_ledger(spark, folder)))
    return view.select("task_id", "records_count", F.try_variant_get("records", "$[0].k", "bigint").alias("k"))


@tasks.query("ledger_state_stream", _LEDGER_SQL + """
SELECT task_id, status, url, records_count FROM state""")
def state_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "events").schema
    events = _events(stream_table(spark, f"{folder}/events.parquet*", schema))
    changes = run_available(ledger_state_stream(events), "task-status")
    latest = changes.groupBy("task_id").agg(F.max_by(F.struct("status", "url", "records_count", "live"), "seq").alias("r"))
    return latest.where("r.live").select("task_id", "r.status", "r.url", "r.records_count")


@tasks.query("ledger_from_crawl", f"""
WITH RECURSIVE {ITEMS_SQL}, e AS (SELECT p.page_id, p.url, n.url AS next_url FROM pages p LEFT JOIN pages n ON n.page_id = p.page_id + 1),
v AS (SELECT page_id AS task_no, 1 AS page_no, url, next_url FROM e
  UNION ALL SELECT v.task_no, v.page_no + 1, e.url, e.next_url FROM v JOIN e ON e.url = v.next_url WHERE v.page_no < 3),
r AS (SELECT v.task_no, count(*) AS n, '[' || string_agg('{{"title":"' || i.title || '"}}', ',' ORDER BY v.page_no, i.item_no) || ']' AS j
  FROM v JOIN items i ON i.url = v.url GROUP BY v.task_no),
t AS (SELECT page_id AS task_no, 't' || page_id AS task_id, url, page_id % 17 = 5 AS refused FROM pages)
SELECT t.task_no * 3 AS seq, task_id, 'create' AS kind, 'pending' AS status, url, 0 AS records_count, NULL AS records, NULL AS error_message FROM t
UNION ALL SELECT t.task_no * 3 + 1, task_id, 'update', 'running', url, 0, NULL, NULL FROM t
UNION ALL SELECT t.task_no * 3 + 2, task_id, 'update', CASE WHEN refused THEN 'failed' ELSE 'completed' END, url,
  (CASE WHEN refused THEN 0 ELSE coalesce(r.n, 0) END)::INTEGER, CASE WHEN NOT refused THEN coalesce(r.j, '[]') END,
  CASE WHEN refused THEN 'bad schema' END FROM t LEFT JOIN r USING (task_no)""")
def ledger_from_crawl(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    following = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next_url"))
    edges = pages.join(following, "page_id", "left").withColumn("success", F.lit(True))
    visits = crawl_chains(pages.select("url"), edges, max_pages=3)
    items = normalize_records(parse_responses(answers(spark, folder)), ("url",)).select(
        "url", "item_no", F.struct(F.try_variant_get("item", "$.title", "string").alias("title")).alias("record")
    )
    started = pages.select(
        F.col("page_id").alias("task_no"), F.concat(F.lit("t"), "page_id").alias("task_id"), "url",
        F.timestamp_seconds("page_id").alias("at"),
    )
    refused = pages.where("page_id % 17 = 5").select(F.col("url").alias("seed"), F.lit("bad schema").alias("error"))
    finished = finish_events(started, crawl_records(visits, items), refused)
    return start_events(started).union(finished).drop("at")

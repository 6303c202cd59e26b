"""Task ledger as an append-only event table and views of its latest state.

Events: ``seq BIGINT`` (unique, in order), ``task_id``, ``kind`` (create, update, delete),
``status``, ``url``, ``records_count INT``, ``records STRING`` (JSON), ``error_message``, ``at``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pageloom.functions.core import col, join_facts, one_per_key
from pageloom.operators.crawl import DEFAULT_PAGES, crawl_chains, crawl_records
from pageloom.operators.fetches import resolve_retries

EVENT_SCHEMA = (
    "seq bigint, task_id string, kind string, status string, url string, "
    "records_count int, records string, error_message string, at timestamp"
)
# Task states and the length of a task list.
PENDING, RUNNING, COMPLETED, FAILED = "pending", "running", "completed", "failed"
LIST_LIMIT = 50
SEQ_SPAN = 1_000_000


def ledger_state(events: DataFrame, include_records: bool = True, with_seq: bool = False) -> DataFrame:
    """Current row of every live task; without records their column is not even read.

    ``with_seq`` adds the numbers of the create and of the last update, NULL without one.

    After the last delete of a task, the first create begins its life; later creates are
    refused and updates before it hit nothing. The last update in that life overwrites
    status, count, records and error. Made of aggregates that combine before the shuffle,
    and one join with a row per deleted task, so a hot task never sits in one sort.
    """
    deleted = events.where("kind = 'delete'").groupBy("task_id").agg(F.max("seq").alias("_gone"))
    alive = (
        join_facts(events.where("kind <> 'delete'"), deleted, "task_id")
        .where(F.col("_gone").isNull() | (F.col("seq") > F.col("_gone")))
    )
    created = F.col("kind") == "create"
    records = F.col("records") if include_records else F.lit(None).cast("string").alias("records")
    change = F.struct("seq", "status", "records_count", records, "error_message", "at")
    found = alive.groupBy("task_id").agg(
        F.min_by(F.struct("seq", "url", "at"), F.when(created, F.col("seq"))).alias("born"),
        F.max_by(change, F.when(~created, F.col("seq"))).alias("latest"),
    ).where("born IS NOT NULL")
    changed = F.coalesce(F.col("latest.seq") > F.col("born.seq"), F.lit(False))
    return found.select(
        "task_id",
        F.when(changed, F.col("latest.status")).otherwise(PENDING).alias("status"),
        F.col("born.url").alias("url"),
        F.when(changed, F.coalesce("latest.records_count", F.lit(0))).otherwise(0).alias("records_count"),
        F.when(changed, F.col("latest.records")).alias("records"),
        F.when(changed, F.col("latest.error_message")).alias("error_message"),
        F.col("born.at").alias("created_at"),
        F.when(changed, F.col("latest.at")).otherwise(F.col("born.at")).alias("updated_at"),
        *([F.col("born.seq").alias("born_seq"), F.when(changed, F.col("latest.seq")).alias("changed_seq")] if with_seq else []),
    )


def with_liveness(events: DataFrame, span: int = SEQ_SPAN) -> DataFrame:
    """Add ``live``: whether the task existed just before the event.

    That is so when the last create or delete before it was a create. The look-back runs
    within spans of ``seq``, each at most ``span`` rows as ``seq`` is unique; a span's last
    create or delete is handed on through a summary of one row per task and span. Events
    without a task id are those of one task.
    """
    marked = events.withColumns({
        "_span": F.floor(F.col("seq") / span),
        "_mark": F.when(F.col("kind").isin("create", "delete"), F.col("kind")),
    })
    local = Window.partitionBy("task_id", "_span").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("task_id").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    handed = (
        marked.groupBy("task_id", "_span")
        .agg(F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col("seq"))).alias("_end"))
        .withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier))
        .select(F.col("task_id").alias("_task"), F.col("_span").alias("_s"), "_carried")
    )
    mine = F.col("task_id").eqNullSafe(F.col("_task")) & (F.col("_span") == F.col("_s"))
    return (
        marked.withColumn("_near", F.last("_mark", ignorenulls=True).over(local))
        .join(handed, mine)
        .withColumn("live", F.coalesce("_near", "_carried", F.lit("delete")) == "create")
        .drop("_span", "_mark", "_near", "_carried", "_task", "_s")
    )


def created_tasks(events: DataFrame) -> DataFrame:
    """Every create with ``accepted``: false where the task id was taken."""
    return with_liveness(events).where("kind = 'create'").select(
        "seq", "task_id", "url", (~F.col("live")).alias("accepted")
    )


def deleted_tasks(events: DataFrame) -> DataFrame:
    """Every delete with ``deleted``: false where there was no such task."""
    return with_liveness(events).where("kind = 'delete'").select(
        "seq", "task_id", F.col("live").alias("deleted")
    )


def get_task(state: DataFrame, task_id: str) -> DataFrame:
    return state.where(F.col("task_id") == task_id).drop("created_at", "updated_at")


def list_tasks(events: DataFrame, limit: int = LIST_LIMIT, include_records: bool = False) -> DataFrame:
    """Newest tasks first; equal times by id. Records are read only when asked for."""
    state = ledger_state(events, include_records)
    newest = state.orderBy(F.col("created_at").desc(), "task_id").limit(limit)
    return newest if include_records else newest.drop("records")


def _events(rows: DataFrame, step: int, kind: str, status: Column | str, count: Column | int = 0,
            records: Column | None = None, error: Column | None = None) -> DataFrame:
    status = F.lit(status) if isinstance(status, str) else status
    return rows.select(
        (F.col("task_no") * 3 + step).alias("seq"), "task_id", F.lit(kind).alias("kind"), status.alias("status"),
        "url", (F.lit(count) if isinstance(count, int) else count).cast("int").alias("records_count"),
        (F.lit(None) if records is None else records).cast("string").alias("records"),
        (F.lit(None) if error is None else error).cast("string").alias("error_message"), "at",
    )


def start_events(tasks: DataFrame) -> DataFrame:
    """Events of accepted crawls, before they run: ``tasks(task_no, task_id, url, at)``."""
    return _events(tasks, 0, "create", PENDING).union(_events(tasks, 1, "update", RUNNING))


def finish_events(tasks: DataFrame, records: DataFrame, failures: DataFrame | None = None,
                  record: str = "record") -> DataFrame:
    """Completed event of each crawl with its records, or a failed one from ``failures(seed, error)``.

    ``records(seed, page_no, item_no, record)``, the record a struct or a JSON text column. A
    task's records become one JSON text, since that is what its row holds; a crawl visits
    a bounded number of pages. Of several failures of a seed one counts, the least text.
    """
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "item_no", F.col(record).alias("_r"))))
    is_text = dict(records.dtypes)[record] == "string"
    rows = F.transform("_all", lambda r: r["_r"] if is_text else F.to_json(r["_r"]))
    found = records.groupBy(F.col("seed").alias("url")).agg(
        F.count(F.lit(1)).alias("_n"), ordered.alias("_all")
    ).select("url", "_n", F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]")).alias("_json"))
    joined = tasks.join(found, "url", "left")
    if failures is None:
        joined = joined.withColumn("_error", F.lit(None).cast("string"))
    else:
        once = one_per_key(failures.select(F.col("seed").alias("url"), F.col("error").alias("_error")), "url", F.col("_error").isNull())
        joined = join_facts(joined, once, "url")
    ok = F.col("_error").isNull()
    return _events(
        joined, 2, "update", F.when(ok, COMPLETED).otherwise(FAILED),
        F.when(ok, F.coalesce("_n", F.lit(0))).otherwise(0),
        F.when(ok, F.coalesce("_json", F.lit("[]"))), F.col("_error"),
    )


def crawl_events(
    tasks: DataFrame, attempts: DataFrame, links: DataFrame, records: DataFrame, failures: DataFrame | None = None,
    max_pages: int = DEFAULT_PAGES, max_retries: int = 3,
) -> DataFrame:
    """Events of whole crawls, one per row of ``tasks(task_no, task_id, url, at)``, from fetch attempts to records.

    A page counts as fetched if the attempt that ends its retries succeeded, ``attempts(url,
    attempt, status_code, error_message)``; a page without attempts is a failed one. Chains
    follow ``links(url, next_url)`` up to ``max_pages``, or to the first failed page. Pages
    without rows in ``records(url, item_no, record)`` add none and end no chain.
    """
    fetched = resolve_retries(attempts, ["url"], max_retries).select("url", "success")
    edges = join_facts(links.select("url", "next_url"), fetched, "url").withColumn("success", F.coalesce("success", F.lit(False)))
    visits = crawl_chains(tasks.select("url"), edges, max_pages)
    return start_events(tasks).union(finish_events(tasks, crawl_records(visits, records), failures))


def task_view(state: DataFrame) -> DataFrame:
    """State with the records as VARIANT, no times."""
    return state.drop("created_at", "updated_at").withColumn("records", F.try_parse_json(col("records")))

"""Stream forms of the send schedule and the task ledger: one small state per key.

Task states don't depend on the order in which events arrive. Send times can't be taken back:
``send_schedule_stream`` gives them out at once and marks a request that comes after a later one
was sent as ``late``; ``send_schedule_in_order`` holds requests back until no earlier one can come. Bound a batch with the source's own limits (``maxFilesPerTrigger``,
``maxBytesPerTrigger``). The state needs the RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pageloom.session import ship_by_value

ship_by_value(__name__)

ORDERED_SCHEMA = "domain string, request_id bigint, arrival_us bigint, start_us bigint"
SCHEDULE_SCHEMA = "domain string, request_id bigint, arrival_us bigint, start_us bigint, late boolean"
STATUS_SCHEMA = "task_id string, seq bigint, status string, url string, records_count int, live boolean, version bigint"
#: Stands for an event that hasn't been seen.
NEVER = -(1 << 63)


class _SendTimes(StatefulProcessor):
    """State: when the last request of the domain starts, and the last arrival."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "start_us bigint, arrival_us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["arrival_us", "request_id"])
        arrival, delay = batch["arrival_us"].to_numpy(), batch["delay_us"].to_numpy()
        shift = delay.cumsum()
        slack = pd.Series(arrival - shift).cummax()
        newest = NEVER
        if self.last.exists():
            sent, newest = self.last.get()
            slack = slack.clip(lower=sent)
        start = (slack + shift).to_numpy()
        self.last.update((int(start[-1]), max(int(arrival[-1]), newest)))
        yield pd.DataFrame({
            "domain": key[0], "request_id": batch["request_id"].to_numpy(),
            "arrival_us": arrival, "start_us": start, "late": arrival < newest,
        })

    def close(self) -> None:
        pass


def send_schedule_stream(requests: DataFrame) -> DataFrame:
    """Send times of a request stream ``(domain, request_id, arrival_us, delay_us)``.

    Equal to the batch form while no row is ``late``: such a row is sent after all requests of
    its domain that came in earlier batches, so filter on it to treat them otherwise.
    """
    return requests.groupBy("domain").transformWithStateInPandas(
        _SendTimes(), SCHEDULE_SCHEMA, outputMode="Append", timeMode="None"
    )


class _OrderedSendTimes(StatefulProcessor):
    """State: the requests that wait for the watermark, the time at which the first of them may go, and the last start.

    One timer per domain, at the earliest request that waits. When it fires, all requests up to
    the watermark go out in order of arrival: rows that could come before them would be dropped
    by the watermark.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "request_id bigint, arrival_us bigint, delay_us bigint")
        self.wake = handle.getValueState("wake", "at_ms bigint")
        self.last = handle.getValueState("last", "start_us bigint")

    def wake_at(self, arrival_us: int) -> None:
        at, known = arrival_us // 1000 + 1, self.wake.get()[0] if self.wake.exists() else None
        if known is not None and known <= at:
            return
        if known is not None:
            self.handle.deleteTimer(known)
        self.handle.registerTimer(at)
        self.wake.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        for part in rows:
            part = part[part["arrival_us"] > until]  # Spark's own limit for late rows is that of the batch before
            if len(part):
                self.held.appendList(list(zip(part["request_id"].tolist(), part["arrival_us"].tolist(), part["delay_us"].tolist())))
                self.wake_at(int(part["arrival_us"].min()))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = pd.DataFrame(list(self.held.get()), columns=["request_id", "arrival_us", "delay_us"])
        due = waiting["arrival_us"] <= until
        rest, batch = waiting[~due], waiting[due].sort_values(["arrival_us", "request_id"])
        self.held.clear()
        self.wake.clear()
        if len(rest):
            self.held.put(list(zip(rest["request_id"].tolist(), rest["arrival_us"].tolist(), rest["delay_us"].tolist())))
            self.wake_at(int(rest["arrival_us"].min()))
        if not len(batch):
            return
        shift = batch["delay_us"].cumsum()
        slack = (batch["arrival_us"] - shift).cummax()
        if self.last.exists():
            slack = slack.clip(lower=self.last.get()[0])
        start = slack + shift
        self.last.update((int(start.iloc[-1]),))
        yield pd.DataFrame({"domain": key[0], "request_id": batch["request_id"], "arrival_us": batch["arrival_us"], "start_us": start})

    def close(self) -> None:
        pass


def send_schedule_in_order(requests: DataFrame, wait: str = "1 hour") -> DataFrame:
    """Send times of a request stream ``(domain, request_id, arrival_us, delay_us)``, equal to those of the batch form.

    A request goes out when the watermark, the newest arrival of all domains less ``wait``, has
    passed it, so files may come in any order as long as none is older than that. Older requests
    are dropped, and so are arrivals up to 1970, where watermarks begin. The state of a domain holds the
    requests of the last ``wait``; the newest ones go out once a newer request moves the watermark.
    """
    timed = requests.withColumn("at", F.timestamp_micros("arrival_us")).withWatermark("at", wait)
    return timed.groupBy("domain").transformWithStateInPandas(
        _OrderedSendTimes(), ORDERED_SCHEMA, outputMode="Append", timeMode="EventTime"
    )


class _TaskStatus(StatefulProcessor):
    """State: last delete, last update, number of batches; and the creates after that delete.

    All are maxima or sets, so that any order of arrival leads to the same state. One row out
    per micro-batch.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.marks = handle.getValueState("marks", "version bigint, gone bigint, seq bigint, status string, records_count int")
        self.creates = handle.getMapState("creates", "seq bigint", "url string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        version, gone, seq, status, count = self.marks.get() if self.marks.exists() else (0, NEVER, NEVER, None, 0)
        for part in rows:
            deletes, updates = part[part["kind"] == "delete"], part[part["kind"] == "update"]
            if len(deletes):
                gone = max(gone, int(deletes["seq"].max()))
            if len(updates) and updates["seq"].max() > seq:
                latest = updates.iloc[updates["seq"].to_numpy().argmax()]
                seq, status = int(latest["seq"]), latest["status"]
                count = 0 if pd.isna(latest["records_count"]) else int(latest["records_count"])
            fresh = part[(part["kind"] == "create") & (part["seq"] > gone)]
            for born, url in zip(fresh["seq"].tolist(), fresh["url"].tolist()):
                self.creates.updateValue((born,), (url,))
        births = [k[0] for k in self.creates.keys()]
        for born in births:
            if born < gone:
                self.creates.removeKey((born,))
        first = min((b for b in births if b > gone), default=None)
        self.marks.update((version + 1, gone, seq, status, count))
        if first is None:
            out = (max(gone, seq), None, None, None)
        else:
            url = self.creates.getValue((first,))[0]
            out = (seq, status, url, count) if seq > first else (first, "pending", url, 0)
        yield pd.DataFrame(
            [(key[0], *out, first is not None, version + 1)],
            columns=["task_id", "seq", "status", "url", "records_count", "live", "version"],
        )

    def close(self) -> None:
        pass


def ledger_state_stream(events: DataFrame) -> DataFrame:
    """Changes of task rows from a stream of ledger events; ``live`` is false for a deleted task.

    The row of a task with the highest ``version`` holds; it is that of the batch form over all
    events so far, in whatever order they came.
    """
    return (
        events.select("seq", "task_id", "kind", "status", "url", "records_count")
        .groupBy("task_id")
        .transformWithStateInPandas(_TaskStatus(), STATUS_SCHEMA, outputMode="Append", timeMode="None")
    )

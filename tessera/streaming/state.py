"""Streams with state and timers: locks that expire, alerts that come once."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.iterate import bounded
from tessera.operators.reports import latest
from tessera.operators.workflow import SHORT
from tessera.streaming.events import late

CHANGES = "user_id string, status string, at timestamp, expires_at timestamp"


def stateful(spark: SparkSession) -> None:
    """State in RocksDB, which timers and maps need; its checkpoints go where the query's go."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def millis(t: pd.Timestamp | datetime) -> int:
    return int(pd.Timestamp(t).tz_localize(None).value // 1_000_000)


def instant(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, UTC).replace(tzinfo=None)


class Locks(StatefulProcessor):
    """The last event of each document; a timer emits the expiry of its lock."""

    def __init__(self, key: str, ttl: timedelta):
        self.key, self.ttl = key, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "user_id string, action string, at long, event_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # the rows of a batch come in parts and in any order
        every = pd.concat([pd.DataFrame(p) for p in rows])
        last = self.last.get() if self.last.exists() else None
        out, ttl, now = [], int(self.ttl.total_seconds() * 1000), timerValues.getCurrentWatermarkInMs()
        for r in sorted(every.to_dict("records"), key=lambda r: (r["ts"], r["event_id"])):
            at = millis(r["ts"])
            if last is not None and (at, r["event_id"]) <= (last[2], last[3]):
                continue  # an event after it has already decided
            if last is not None and last[1] == "lock" and last[2] + ttl < at:
                out.append((key[0], last[0], "expired", instant(last[2] + ttl), instant(last[2] + ttl)))
            last = (r["user_id"], r["action"], at, r["event_id"])
            locked = r["action"] == "lock"
            out.append((key[0], r["user_id"], "locked" if locked else "unlocked", instant(at), instant(at + ttl) if locked else None))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if last[1] == "lock":
            # a time that has passed fires with the next batch
            self.handle.registerTimer(max(last[2] + ttl, now + 1))
        self.last.update(last)
        yield self.frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get() if self.last.exists() else None
        if last is not None and last[1] == "lock":
            until = instant(last[2] + int(self.ttl.total_seconds() * 1000))
            self.last.update((last[0], "expired", last[2], last[3]))
            yield self.frame([(key[0], last[0], "expired", until, until)])
        else:
            yield self.frame([])

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=t) for i, (c, t) in enumerate({self.key: object, "user_id": object, "status": object, "at": "datetime64[ns]", "expires_at": "datetime64[ns]"}.items())})

    def close(self) -> None:
        pass


def lock_changes(events: DataFrame, ttl_minutes: int = 30, delay: str = "10 minutes", key: str = "document_id") -> DataFrame:
    """key, user_id, status (locked, unlocked or expired), at, expires_at of a stream of (key, user_id, action, ts, event_id).

    Events count in the order of (ts, event_id), whatever order they come in
    within the delay; an expiry is emitted when the watermark has passed it.
    """
    stateful(events.sparkSession)
    kind = events.schema[key].dataType.simpleString()
    own = late(events.select(key, F.col("user_id").cast("string"), "action", "ts", F.col("event_id").cast("long").alias("event_id")), "ts", delay)
    return own.groupBy(key).transformWithStateInPandas(Locks(key, timedelta(minutes=ttl_minutes)), f"{key} {kind}, {CHANGES}", "Append", "EventTime")


def locks_of(changes: DataFrame, key: str = "document_id") -> DataFrame:
    """key, user_id, expires_at: what is locked after some changes (the batch counterpart is `workflow.locks`)."""
    rank = F.when(F.col("status") == "expired", 0).otherwise(1)
    return latest(changes.withColumn("_rank", rank), key, "at", "_rank").where(F.col("status") == "locked").select(key, "user_id", "expires_at")


class Alerts(StatefulProcessor):
    """What each search has alerted to; kept as long as the same document may come again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "doc_id long", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs(), []
        for p in rows:
            for r in p[["doc_id", "created_at"]].itertuples(index=False):
                if not self.seen.containsKey((int(r.doc_id),)):
                    self.seen.updateValue((int(r.doc_id),), (millis(r.created_at),))
                    out.append((key[0], int(r.doc_id), pd.Timestamp(r.created_at).tz_localize(None)))
        # rows before the watermark are dropped before they come here
        for k in [k for k, v in self.seen.iterator() if v[0] < now]:
            self.seen.removeKey(k)
        yield pd.DataFrame({"search_id": pd.Series([r[0] for r in out], dtype="int64"), "doc_id": pd.Series([r[1] for r in out], dtype="int64"), "created_at": pd.Series([r[2] for r in out], dtype="datetime64[ns]")})

    def close(self) -> None:
        pass


def alerts_stream(documents: DataFrame, searches: DataFrame, hit: Column, delay: str = "1 hour") -> DataFrame:
    """search_id, doc_id, created_at: each document of a stream once for each saved search that it meets and that has no later alert. searches: (search_id, last_alert, ...), at most `SHORT` rows, which is checked; the batch counterpart is `workflow.alerts`."""
    stateful(documents.sparkSession)
    since = F.coalesce("last_alert", F.lit("1970-01-01").cast("timestamp"))
    own = late(documents, "created_at", delay).join(F.broadcast(bounded(searches, SHORT, "saved searches")), hit & (F.col("created_at") > since))
    rows = own.select(F.col("search_id").cast("long").alias("search_id"), F.col("doc_id").cast("long").alias("doc_id"), "created_at")
    return rows.groupBy("search_id").transformWithStateInPandas(Alerts(), "search_id long, doc_id long, created_at timestamp", "Append", "EventTime")


def epoch_sink(path: str):
    """A foreachBatch function that writes each batch to a folder of its own, so that a batch that is repeated after a failure is there once."""

    def batch(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return batch

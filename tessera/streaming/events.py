"""Streaming counterparts over event tables; each takes a batch or a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.workflow import TRANSITIONS


def read_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def late(events: DataFrame, ts: str, delay: str) -> DataFrame:
    """A watermark for a stream; it needs an instant, so times without a zone are read in the session's zone."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay) if events.isStreaming else events


def tumbling(events: DataFrame, ts: str = "ts", size: str = "1 hour", delay: str = "10 minutes", slide: str | None = None, by: str = "event_type") -> DataFrame:
    """Counts and sums by window (sliding where a slide is given) and a column."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = late(events, ts, delay).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, ts: str = "ts", gap: str = "30 minutes", delay: str = "1 hour", by: str = "user_id") -> DataFrame:
    out = late(events, ts, delay).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def states(events: DataFrame, key: str, state: str, order: str) -> DataFrame:
    """key, state, previous (null at first), valid: the workflow state machine over a stream, one kept state a key."""

    def run(own: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        now = held.get[0] if held.exists else None
        rows = []
        # the rows of a batch come in parts: they are ordered together
        for s in pd.concat(list(parts)).sort_values(order)[state]:
            ok = s in TRANSITIONS.get(now or "", [])
            rows.append((own[0], s, now, ok))
            if ok:
                now = s
        held.update((now,))
        yield pd.DataFrame(rows, columns=[key, "state", "previous", "valid"])

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, state string, previous string, valid boolean", "state string", "append", "NoTimeout")


def index_sink(path: str, key: str, text: str, op: str | None = None, name: str = "stream", merge: int = 8):
    """A foreachBatch function that keeps an index: each batch is a segment in which its keys' newest rows replace earlier ones (or delete them, where column `op` says so).

    A batch that is repeated after a failure changes nothing. Segments are
    merged when there are more than `merge`.
    """
    from tessera.operators.index import Index

    def batch(df: DataFrame, epoch: int) -> None:
        own = Index(df.sparkSession, path, key)
        if not own.exists():
            Index.build(df.limit(0), key, text, path)
        changes = df if op else df.withColumn("op", F.lit("upsert"))
        own.apply(changes, text, op or "op", batch=(name, epoch))
        if len(own.state["segments"]) > merge:
            own.compact()

    return batch

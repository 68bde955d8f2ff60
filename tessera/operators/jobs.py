"""Processing of documents as a log of status events: claims, results, retries, stale work; adapters around remote calls."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.reports import latest

EVENTS = "document_id long, status string, error string, at timestamp, seq long"


def status(log: DataFrame) -> DataFrame:
    """The last event of each document (log: document_id, status, error, at, seq)."""
    return latest(log, "document_id", "at", "seq")


def event(rows: DataFrame, to: str, at: Column, error: Column | None = None) -> DataFrame:
    return rows.select("document_id", F.lit(to).alias("status"), (F.lit(None).cast("string") if error is None else error).alias("error"), at.alias("at"), (F.col("seq") + 1).alias("seq"))


def claim(log: DataFrame, at: Column, limit: int) -> DataFrame:
    """Events that take the first pending documents into processing."""
    return event(status(log).where("status = 'pending'").orderBy("at", "document_id").limit(limit), "processing", at)


def retry_failed(log: DataFrame, at: Column, documents: list[int] | None = None) -> DataFrame:
    """Events that put failed documents (or some of them) back to pending."""
    failed = status(log).where("status = 'failed'")
    return event(failed if documents is None else failed.where(F.col("document_id").isin(documents)), "pending", at)


def recover_stale(log: DataFrame, at: Column, minutes: int = 30) -> DataFrame:
    """Events that put documents back to pending whose processing began longer ago."""
    return event(status(log).where((F.col("status") == "processing") & (F.col("at") < at - F.make_interval(mins=F.lit(minutes)))), "pending", at, F.lit("stale"))


def backoff(attempt: int, base: float = 1.0, most: float = 60.0, jitter: float = 0.0, draw: float = 0.5) -> float:
    """Seconds to wait before another attempt: doubled each time up to a most, and up to a share of that more or less as `draw` (0 to 1) says."""
    wait = min(base * 2**attempt, most)
    return max(0.0, wait + (2 * draw - 1) * jitter * wait)


@dataclass
class RateLimit:
    """A window that is reset when it has passed: at most so many requests and tokens in each."""

    requests: int
    tokens: int
    seconds: float = 60.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    began: float | None = None
    used: list[int] = field(default_factory=lambda: [0, 0])

    def acquire(self, tokens: int = 1000) -> float:
        """Wait until one more request fits; returns the seconds waited."""
        now, waited = self.clock(), 0.0
        if self.began is None or now - self.began >= self.seconds:
            self.began, self.used = now, [0, 0]
        if self.used[0] >= self.requests or self.used[1] + tokens > self.tokens:
            waited = self.seconds - (now - self.began)
            self.sleep(waited)
            self.began, self.used = self.clock(), [0, 0]
        self.used[0] += 1
        self.used[1] += tokens
        return waited


def call(work: Callable, item: object, attempts: int, wait: Callable[[float], None], base: float = 1.0) -> tuple[object, str | None]:
    """What work(item) gives, or the last error after some attempts with a growing wait between them."""
    for k in range(attempts):
        try:
            return work(item), None
        except Exception as x:  # a remote call may fail in any way; the row says how
            error = f"{type(x).__name__}: {x}"
            if k + 1 < attempts:
                wait(backoff(k, base))
    return None, error


def process(rows: DataFrame, key: str, column: str, work: Callable[[object], str], attempts: int = 3, failures: int = 5, limit: RateLimit | None = None, tasks: int | None = None) -> DataFrame:
    """key, result, error: work (recognition, conversion, image description) on each row, in as many tasks as the service bears.

    A row that fails keeps its error and costs nothing else; after `failures`
    rows in a row a task gives the rest the error "aborted" without a call.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bad = 0
        for pdf in parts:
            out = []
            for k, item in zip(pdf[key], pdf[column], strict=True):
                if bad >= failures:
                    out.append((k, None, "aborted"))
                    continue
                if limit is not None:
                    limit.acquire()
                result, error = call(work, item, attempts, time.sleep, 0.01)
                bad = bad + 1 if error else 0
                out.append((k, result, error))
            yield pd.DataFrame(out, columns=[key, "result", "error"])

    own = rows.select(key, column)
    return (own.repartition(tasks) if tasks else own).mapInPandas(run, f"{key} {kind}, result string, error string")


def results(processed: DataFrame, at: Column, seq: int, *more: str) -> DataFrame:
    """Status events of processed documents, with further columns of them."""
    return processed.select(F.col("document_id"), F.when(F.col("error").isNull(), "complete").otherwise("failed").alias("status"), "error", at.alias("at"), F.lit(seq).cast("long").alias("seq"), *more)


def rerun(table: DataFrame, again: DataFrame, key: str) -> DataFrame:
    """A table of results with new ones in place of the old (re-embedding, reprocessing)."""
    return table.join(again.select(key).distinct(), key, "left_anti").unionByName(again)


def subscribed(events: DataFrame, *types: str) -> DataFrame:
    """Events of some types; '*' is every type. The same for a table and for a stream."""
    return events if "*" in types else events.where(F.col("event_type").isin(*types))


def replay(events: DataFrame, after: int, *order: str) -> DataFrame:
    """Events after the last that a client has seen, in order."""
    return events.where(F.col("event_id") > after).orderBy(*(order or ("event_id",)))

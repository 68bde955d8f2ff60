"""Reporting: time buckets, conditional aggregates, corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import bucket


def trend(rows: DataFrame, ts: str, unit: str, by: tuple[str, ...] = (), **measures: Column) -> DataFrame:
    """Measures by calendar bucket (rows without a time are left out) and further columns."""
    return rows.where(F.col(ts).isNotNull()).groupBy(bucket(ts, unit).alias("period"), *by).agg(*[m.alias(n) for n, m in measures.items()])


def share(part: Column, whole: Column, digits: int = 2, scale: float = 100) -> Column:
    """Rounded part of a whole; 0 where the whole is 0."""
    return F.when(whole > 0, F.round(scale * part / whole, digits)).otherwise(F.lit(0.0))


def mean_or_zero(total: Column, n: Column, digits: int = 2) -> Column:
    return F.when(n > 0, F.round(total / n, digits)).otherwise(F.lit(0.0))


def bands(rows: DataFrame, value: str, edges: dict[str, tuple[float, float]]) -> DataFrame:
    """One row: how many values lie in each band [low, high)."""
    return rows.agg(*[F.count_if((F.col(value) >= a) & (F.col(value) < b)).alias(n) for n, (a, b) in edges.items()], F.count_if(F.col(value).isNull()).alias("unknown"))


def counted_by(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def failure_rates(rows: DataFrame, by: str, failed: Column) -> DataFrame:
    """total, failures, rate in percent by a column."""
    return rows.groupBy(by).agg(F.count("*").alias("total"), F.sum(F.when(failed, 1).otherwise(0)).alias("failures")).withColumn("failure_rate", share(F.col("failures"), F.col("total")))


def distribution(rows: DataFrame, items: Column, name: str = "item") -> DataFrame:
    """How often each element of an array column occurs, and in how many rows."""
    own = rows.select(F.monotonically_increasing_id().alias("_row"), items.alias("_items"))
    return own.select("_row", F.explode("_items").alias(name)).groupBy(name).agg(F.count("*").alias("n"), F.count_distinct("_row").alias("n_rows"))


def top(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    return rows.orderBy(*order).limit(limit)


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows, with the number of all rows."""
    total = rows.agg(F.count("*").alias("n")).scalar()
    return rows.withColumn("total", total).orderBy(*order).offset(offset).limit(limit)


def after_cursor(rows: DataFrame, created_at: str, key: str, cursor: tuple[object, object] | None, limit: int) -> DataFrame:
    """Keyset paging, newest first: the filter reaches the scan, nothing is skipped by counting."""
    if cursor is not None:
        ts, k = F.lit(cursor[0]), F.lit(cursor[1])
        rows = rows.where((F.col(created_at) < ts) | ((F.col(created_at) == ts) & (F.col(key) < k)))
    return rows.orderBy(F.desc(created_at), F.desc(key)).limit(limit)


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The newest row of each key, by aggregation (partial in each task), not by a window over all rows."""
    every = F.struct(*[F.col(c) for c in [*order, *[c for c in rows.columns if c not in order]]])
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max(every).alias("r")).select(*[F.col(f"r.{c}").alias(c) for c in rows.columns])

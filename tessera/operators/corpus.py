"""A corpus as named tables; change logs in place of updates; integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.reports import latest

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events", "orders", "lineitem", "customer", "supplier", "part", "nation", "region")


class Corpus:
    """Tables of one folder, bound by name and read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def create_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"create database if not exists `{name}`")


def drop_database(spark: SparkSession, name: str) -> None:
    spark.sql(f"drop database if exists `{name}` cascade")


def list_databases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d.name, d.locationUri) for d in spark.catalog.listDatabases()], "name string, location string")


def current(log: DataFrame, key: str, *order: str) -> DataFrame:
    """The state after a log of changes: the last row of each key, without those it deletes (column `op`)."""
    return latest(log, key, *order).where(F.col("op") != "delete").drop("op")


def without(table: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """Cascade delete: rows whose key is not deleted."""
    return table.join(tombstones.select(key), key, "left_anti")


def merge_metadata(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Update columns where a change gives a value."""
    renamed = changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return table.join(renamed, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns])


def gaps(checks: dict[str, tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """category, n: rows of the first table without a row in the second, by key."""
    out = None
    for name, (table, other, key) in checks.items():
        one = table.join(other.select(key), key, "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("category"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def fingerprint(table: DataFrame, key: str, hashed: str, group: int = 1024) -> DataFrame:
    """One hash of all id:hash pairs: groups of about `group` pairs are sorted and hashed, then groups of those hashes, until one is left. No list is longer than that, whatever the table's size."""
    parts = max(1, -(-table.count() // group))
    rows = table.select(F.pmod(F.xxhash64(key), F.lit(parts)).alias("p"), F.concat(F.col(key).cast("string"), F.lit(":"), F.col(hashed)).alias("h"))
    joined = F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "|"), 256).alias("h")
    while True:
        rows = rows.groupBy("p").agg(joined)
        if parts == 1:
            return rows.select(F.col("h").alias("content_hash"))
        parts = -(-parts // group)
        rows = rows.select(F.pmod("p", F.lit(parts)).alias("p"), F.concat(F.col("p").cast("string"), F.lit(":"), "h").alias("h"))

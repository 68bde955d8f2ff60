"""Keeping clusters: lists, moves, merges, deletes. Assignments (run_id, document_id, cluster_id) are a table that each change gives anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.lists import where_given


def listed(clusters: DataFrame, run: object = None, tag: str | None = None, tags: DataFrame | None = None) -> DataFrame:
    """Clusters of a run, or with a tag (tags: entity_id, tag), largest first."""
    out = where_given(clusters, run_id=run)
    if tag is not None:
        out = out.join(tags.where(F.col("tag") == tag).select(F.col("entity_id").alias("cluster_id")).distinct(), "cluster_id", "left_semi")
    return out.orderBy(F.desc("document_count"), "cluster_id")


def counted(assigned: DataFrame) -> DataFrame:
    """run_id, cluster_id, document_count; noise (no cluster) is not counted."""
    return assigned.where("cluster_id is not null").groupBy("run_id", "cluster_id").agg(F.count("*").alias("document_count"))


def reassign(assigned: DataFrame, moves: DataFrame) -> DataFrame:
    """assigned after moves (document_id, run_id, cluster_id): a document is in one cluster of a run, with no similarity known there."""
    new = moves.dropDuplicates(["run_id", "document_id"])
    kept = assigned.join(new.select("run_id", "document_id"), ["run_id", "document_id"], "left_anti")
    return kept.unionByName(new.select("run_id", "document_id", "cluster_id"), allowMissingColumns=True)


def merge(assigned: DataFrame, run: object, into: object, other: object) -> DataFrame:
    """assigned with the documents of one cluster of a run in another; the emptied cluster is gone."""
    moved = (F.col("run_id") == run) & (F.col("cluster_id") == other)
    return assigned.withColumn("cluster_id", F.when(moved, F.lit(into)).otherwise(F.col("cluster_id")))


def without_run(table: DataFrame, run: object) -> DataFrame:
    return table.where(F.col("run_id") != run)


def stats(clusters: DataFrame) -> DataFrame:
    """One row: clusters, runs, mean coherence."""
    return clusters.agg(F.count("*").alias("total_clusters"), F.count_distinct("run_id").alias("total_runs"), F.avg("coherence").alias("avg_coherence"))

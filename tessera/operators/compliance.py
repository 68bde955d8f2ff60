"""Reports for auditors: one row a section and item, so that no report has to be held whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Parts of the names of actions that a report is about.
PHI_ACTIONS = ("search", "document.get", "document.read", "export", "download")
TRAIL_ACTIONS = ("ingest", "process", "delete", "workflow", "approval")


def within(entries: DataFrame, start: object = None, end: object = None) -> DataFrame:
    """Audit entries of a period; an end that is None is open."""
    if start is not None:
        entries = entries.where(F.col("created_at") >= F.lit(start).cast("timestamp"))
    return entries if end is None else entries.where(F.col("created_at") <= F.lit(end).cast("timestamp"))


def about(entries: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    hit = F.lit(False)
    for p in parts:
        hit = hit | F.contains("action", F.lit(p))
    return entries.where(hit)


def named(entries: DataFrame, users: DataFrame) -> DataFrame:
    """Entries with the name of their user, who may be gone."""
    return entries.join(users.select(F.col("id").alias("user_id"), F.col("display_name").alias("user_name")), "user_id", "left")


def section(name: str, rows: DataFrame, item: str, *columns: str) -> DataFrame:
    """section, item, detail (the columns as JSON)."""
    return rows.select(F.lit(name).alias("section"), F.col(item).cast("string").alias("item"), F.to_json(F.struct(*columns)).alias("detail"))


ENTRY = ("created_at", "user_id", "user_name", "action", "entity_type", "entity_id")


def soc2(entries: DataFrame, users: DataFrame, records: DataFrame) -> DataFrame:
    """Access controls, audit trail, and how many records (content_hash) have a hash."""
    n, hashed = F.count("*"), F.count("content_hash")
    coverage = records.agg(n.alias("total"), hashed.alias("hashed"), F.when(n > 0, F.round(100 * hashed / n, 2)).otherwise(0.0).alias("coverage_pct")).withColumn("item", F.lit("provenance"))
    return section("access_controls", users, "id", "display_name", "role").unionByName(section("audit_trail", named(entries, users), "id", *ENTRY)).unionByName(section("data_integrity", coverage, "item", "total", "hashed", "coverage_pct"))


def hipaa(entries: DataFrame, users: DataFrame, documents: DataFrame) -> DataFrame:
    """Access to documents, who may sign in, how many documents there are."""
    stock = documents.agg(F.count("*").alias("total_documents")).withColumn("item", F.lit("documents"))
    return section("phi_access", named(about(entries, PHI_ACTIONS), users), "id", *ENTRY).unionByName(section("user_authentication", users, "id", "display_name", "role")).unionByName(section("document_inventory", stock, "item", "total_documents"))


def sox(entries: DataFrame, users: DataFrame, steps: DataFrame, states: DataFrame) -> DataFrame:
    """What changed documents, decided approval steps with who decided, workflow states."""
    decided = steps.join(users.select(F.col("id").alias("decided_by"), F.col("display_name").alias("decided_by_name")), "decided_by", "left")
    return section("document_trail", named(about(entries, TRAIL_ACTIONS), users), "id", *ENTRY).unionByName(section("approval_decisions", decided, "id", "status", "decided_by", "decided_by_name")).unionByName(section("workflow_states", states, "id", "state"))


def totals(report: DataFrame) -> DataFrame:
    return report.groupBy("section").agg(F.count("*").alias("n"))

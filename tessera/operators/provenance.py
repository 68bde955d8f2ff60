"""Lineage: hash chains, walks, verification, exports."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import chain_hash, content_hash, slug_agent
from tessera.operators.iterate import cut
from tessera.operators.reports import page

# The types of records from the root to each type.
PATHS = {
    "DOCUMENT": ("DOCUMENT",),
    "OCR_RESULT": ("DOCUMENT", "OCR_RESULT"),
    "CHUNK": ("DOCUMENT", "OCR_RESULT", "CHUNK"),
    "IMAGE": ("DOCUMENT", "OCR_RESULT", "IMAGE"),
    "EXTRACTION": ("DOCUMENT", "OCR_RESULT", "EXTRACTION"),
    "FORM_FILL": ("DOCUMENT", "FORM_FILL"),
    "VLM_DESCRIPTION": ("DOCUMENT", "OCR_RESULT", "IMAGE", "VLM_DESCRIPTION"),
    "EMBEDDING": ("DOCUMENT", "OCR_RESULT", "CHUNK", "EMBEDDING"),
    "COMPARISON": ("DOCUMENT", "OCR_RESULT", "COMPARISON"),
    "CLUSTERING": ("DOCUMENT", "OCR_RESULT", "CHUNK", "EMBEDDING", "CLUSTERING"),
}
#: Columns by which records may be ordered.
ORDERS = ("created_at", "processed_at", "type", "processor", "processing_duration_ms", "chain_depth")
# Fixed value: the columns of the CSV export, in order.
CSV_COLUMNS = (
    "id", "type", "created_at", "processed_at", "source_file_created_at", "source_file_modified_at", "source_type", "source_path", "source_id", "root_document_id", "location",
    "content_hash", "input_hash", "file_hash", "processor", "processor_version", "processing_duration_ms", "processing_quality_score", "parent_id", "parent_ids", "chain_depth",
)


def with_chain_hashes(records: DataFrame) -> DataFrame:
    """chain_hash of each record (id, parent_id, content_hash), level by level from the roots until a level is empty.

    Records are dealt and sorted by their parent once and kept so while levels
    are worked off; of a level only ids and hashes move. Records that no root
    leads to (an absent parent, a cycle) stay, with a null hash.
    """
    none = F.lit(None).cast("string")
    level = cut(records.where(F.col("parent_id").isNull()).withColumn("chain_hash", chain_hash(F.col("content_hash"), none)))
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    below = records.where(F.col("parent_id").isNotNull()).repartition(parts, "parent_id").sortWithinPartitions("parent_id").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        out = level
        while True:
            parents = level.select(F.col("id").alias("parent_id"), F.col("chain_hash").alias("_parent")).dropDuplicates(["parent_id"])
            level = cut(below.join(parents, "parent_id").withColumn("chain_hash", chain_hash(F.col("content_hash"), F.col("_parent"))).select(*out.columns))
            if level.isEmpty():
                break
            out = out.unionByName(level)
        # what no level reached: its parent has no hash
        lost = cut(below.join(out.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").withColumn("chain_hash", none).select(*out.columns))
    finally:
        below.unpersist()
    return out.unionByName(lost)


def verify_chains(records: DataFrame) -> DataFrame:
    """root_document_id, checked, mismatched, missing: stored chain hashes against those of the parent."""
    parents = records.select(F.col("id").alias("parent_id"), F.col("chain_hash").alias("_parent"), F.lit(True).alias("_found"))
    both = records.join(parents, "parent_id", "left")
    good = F.col("chain_hash") == chain_hash(F.col("content_hash"), F.col("_parent"))
    return both.groupBy("root_document_id").agg(F.count_if(F.col("chain_hash").isNotNull()).alias("checked"), F.count_if(F.col("chain_hash").isNotNull() & ~good).alias("mismatched"), F.count_if(F.col("chain_hash").isNull()).alias("missing"))


def verify_records(records: DataFrame) -> DataFrame:
    """type, total, bad_hash, no_parent, bad_depth: re-hashed content (column `content`), parents and depths."""
    parents = records.select(F.col("id").alias("parent_id"), F.col("chain_depth").alias("_depth"))
    both = records.join(parents, "parent_id", "left")
    return both.groupBy("type").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("content_hash") != content_hash(F.col("content"))).alias("bad_hash"),
        F.count_if(F.col("parent_id").isNotNull() & F.col("_depth").isNull()).alias("no_parent"),
        F.count_if(F.col("_depth").isNotNull() & (F.col("chain_depth") != F.col("_depth") + 1)).alias("bad_depth"),
    )


def lineage(records: DataFrame, start: DataFrame) -> DataFrame:
    """item, step, id, type: each start id (column id) and its ancestors up to the root, or up to where a walk would come to an id again. Walks have any length; one row a walk is carried, with the ids it has met."""
    edges = cut(records.select("id", "parent_id", "type"))
    now = start.select(F.col("id").alias("item"), "id").join(edges, "id").withColumn("step", F.lit(0)).withColumn("met", F.array("id"))
    out, d = now, 0
    while True:
        d += 1
        up = now.where(F.col("parent_id").isNotNull() & ~F.array_contains("met", F.col("parent_id"))).select("item", F.col("parent_id").alias("id"), F.array_append("met", F.col("parent_id")).alias("met"))
        now = cut(up.join(edges, "id").select("item", "id", "parent_id", "type", F.lit(d).alias("step"), "met"))
        if now.isEmpty():
            return out.select("item", "step", "id", "type")
        out = out.unionByName(now)


def ancestors(records: DataFrame) -> DataFrame:
    """id, depth, path: the ids above each record, nearest first. Where no root leads to a record, the path goes as far as an absent record, or once round a cycle.

    Each round puts the path of a path's end behind it, so there are as many
    rounds as the logarithm of the longest path. Where ids are repeated, ways
    branch, and are walked step by step.
    """
    if records.groupBy("id").count().where((F.col("count") > 1) & F.col("id").isNotNull()).isEmpty():
        return doubled(records)
    walk = lineage(records, records.select("id"))
    return walk.groupBy(F.col("item").alias("id")).agg(F.max("step").alias("depth"), F.array_sort(F.collect_list(F.when(F.col("step") > 0, F.struct("step", F.col("id").cast("string").alias("id"))))).alias("p")).select("id", "depth", F.transform("p", lambda x: x["id"]).alias("path"))


def doubled(records: DataFrame) -> DataFrame:
    """`ancestors` of records whose ids differ. up: the id that follows a path, null where it is at its end."""
    none = F.array().cast(f"array<{records.schema['id'].dataType.simpleString()}>")
    now = cut(records.where(F.col("id").isNotNull()).select("id", none.alias("path"), F.col("parent_id").alias("up")))
    out = now.where(F.col("up").isNull())
    now = now.where(F.col("up").isNotNull())
    while not now.isEmpty():
        ends = out.unionByName(now).select(F.col("id").alias("up"), F.col("path").alias("_path"), F.col("up").alias("_up"))
        both = now.join(ends, "up", "left")
        longer = both.select("id", F.when(F.col("_path").isNotNull(), F.concat("path", F.array("up"), "_path")).otherwise(F.col("path")).alias("path"), F.col("_up").alias("up"))
        # an id that is met again: what comes before it is once round the cycle
        own = F.concat(F.array("id"), F.col("path"))
        once = longer.withColumn("_once", F.array_distinct(own))
        again = F.size("_once") <= F.size("path")
        now = cut(once.select("id", F.when(again, F.slice("_once", 2, F.size("_once"))).otherwise(F.col("path")).alias("path"), F.when(~again, F.col("up")).alias("up")))
        out, now = out.unionByName(now.where(F.col("up").isNull())), now.where(F.col("up").isNotNull())
    return out.select("id", F.size("path").alias("depth"), F.transform("path", lambda x: x.cast("string")).alias("path"))


def create(records: DataFrame, parents: DataFrame) -> DataFrame:
    """New records (id, type, source_id, ...) with parent_id, parent_ids (the parent's, then the parent), chain_depth, chain_path and root_document_id, from the parents' rows (id, parent_ids, chain_depth, root_document_id). A type that is not known, or a source that is not there, fails the row."""
    up = parents.select(F.col("id").alias("source_id"), F.col("parent_ids").alias("_ids"), F.col("chain_depth").alias("_depth"), F.col("root_document_id").alias("_root"), F.lit(True).alias("_found"))
    both = records.join(up, "source_id", "left")
    paths = chain_path(F.col("type"))
    checked = F.when(paths.isNull(), F.raise_error(F.concat(F.lit("no such type: "), F.col("type")))).when(F.col("source_id").isNotNull() & F.col("_found").isNull(), F.raise_error(F.concat(F.lit("no such source: "), F.col("source_id").cast("string")))).otherwise(paths)
    ids = F.when(F.col("source_id").isNull(), F.array().cast("array<string>")).otherwise(F.concat("_ids", F.array(F.col("source_id").cast("string"))))
    return both.select(*records.columns, F.col("source_id").alias("parent_id"), ids.alias("parent_ids"), F.coalesce(F.col("_depth") + 1, F.lit(0)).alias("chain_depth"), checked.alias("chain_path"), F.coalesce("_root", "id").alias("root_document_id"))


def chain_path(kind: Column) -> Column:
    """The types from the root to a type; null for one that is not known."""
    known = F.create_map(*[x for k, p in PATHS.items() for x in (F.lit(k), F.array(*map(F.lit, p)))])
    return F.try_element_at(known, kind)


def find(records: DataFrame, *, processor: str | None = None, type: str | None = None, least_depth: int | None = None, most_depth: int | None = None, least_quality: float | None = None, least_ms: int | None = None, after: object = None, before: object = None, root: object = None, order: str = "created_at", descending: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
    """Records for which all the given predicates hold, a page of them, with the number of all."""
    if order not in ORDERS:
        raise ValueError(f"order by one of {', '.join(ORDERS)}")
    tests = ((processor, F.col("processor") == processor), (type, F.col("type") == type), (least_depth, F.col("chain_depth") >= least_depth), (most_depth, F.col("chain_depth") <= most_depth), (least_quality, F.col("processing_quality_score") >= least_quality), (least_ms, F.col("processing_duration_ms") >= least_ms), (after, F.col("created_at") >= F.lit(after)), (before, F.col("created_at") <= F.lit(before)), (root, F.col("root_document_id") == root))
    for value, test in tests:
        if value is not None:
            records = records.where(test)
    return page(records, [F.desc(order) if descending else F.asc(order), F.asc("id")], limit, offset)


def by_root(records: DataFrame, root: object, kinds: tuple[str, ...] = ()) -> DataFrame:
    """All records of a document, by depth."""
    own = records.where(F.col("root_document_id") == root)
    return (own.where(F.col("type").isin(*kinds)) if kinds else own).orderBy("chain_depth", "id")


def scope(records: DataFrame, kind: str, document: object = None) -> DataFrame:
    """Records of one document, or of the whole database."""
    if kind not in ("document", "database", "all"):
        raise ValueError("scope is document, database or all")
    return records.where(F.col("root_document_id") == document) if kind == "document" else records


def resolve(owners: dict[str, DataFrame], items: DataFrame) -> DataFrame:
    """item, kind, provenance_id: whatever kind of entity has an id. owners: kind -> (id, provenance_id)."""
    every = None
    for kind, table in owners.items():
        one = table.select(F.col("id").cast("string").alias("item"), F.lit(kind).alias("kind"), F.col("provenance_id").cast("string").alias("provenance_id"))
        every = one if every is None else every.unionByName(one)
    return items.select(F.col("id").cast("string").alias("item")).distinct().join(every, "item", "left")


def contents(records: DataFrame, owners: dict[str, DataFrame]) -> DataFrame:
    """records with `content`, the text that the hash of its type covers. owners: type -> (provenance_id, content)."""
    every = None
    for kind, table in owners.items():
        one = table.select(F.lit(kind).alias("type"), F.col("provenance_id").alias("id"), "content")
        every = one if every is None else every.unionByName(one)
    return records.drop("content").join(every, ["type", "id"], "left")


def verify_files(records: DataFrame, files: DataFrame) -> DataFrame:
    """id, path, status: the stored file_hash of documents against their files. files: (path, content) as binaryFile reads them."""
    hashed = files.select(F.col("path").alias("source_path"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("_hash"))
    both = records.where("type = 'DOCUMENT'").join(hashed, "source_path", "left")
    return both.select("id", "source_path", F.when(F.col("_hash").isNull(), "missing").when(F.col("_hash") == F.col("file_hash"), "valid").otherwise("changed").alias("status"))


def summary(records: DataFrame, start: DataFrame) -> DataFrame:
    """item, summary: the types from the root to each record, as text."""
    walk = lineage(records, start)
    steps = F.reverse(F.array_sort(F.collect_list(F.struct("step", "type"))))
    return walk.groupBy("item").agg(F.array_join(F.transform(steps, lambda x: x["type"]), " -> ").alias("summary"))


def with_orphaned_root(records: DataFrame, detached: DataFrame, root: str = "orphaned-root") -> DataFrame:
    """records, and those of detached under one synthetic root record, which is added if it is not there."""
    known = records.where(F.col("id") == root)
    row = detached.sparkSession.createDataFrame([(root, "DOCUMENT", root, 0)], "id string, type string, root_document_id string, chain_depth long")
    new = row.join(known.select("id"), "id", "left_anti")
    moved = detached.withColumn("parent_id", F.lit(root)).withColumn("root_document_id", F.lit(root))
    return records.unionByName(new, allowMissingColumns=True).unionByName(moved, allowMissingColumns=True)


def children(records: DataFrame, parent: object) -> DataFrame:
    return records.where(F.col("parent_id") == parent)


def orphans(records: DataFrame, owners: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Records of each type whose owner row is gone: an anti join per type. owners: type -> (table, its provenance id column)."""
    out = None
    for kind, (table, column) in owners.items():
        one = records.where(F.col("type") == kind).join(table.select(F.col(column).alias("id")), "id", "left_anti").select("id", "type")
        out = one if out is None else out.unionByName(one)
    return out


def timeline(records: DataFrame, root: object) -> DataFrame:
    """Ordered steps of one document with running time."""
    from pyspark.sql import Window

    own = Window.partitionBy("root_document_id").orderBy("chain_depth", "created_at", "id")
    total = F.sum(F.coalesce("processing_duration_ms", F.lit(0))).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return records.where(F.col("root_document_id") == root).select(F.row_number().over(own).cast("long").alias("step"), "id", "type", "processor", F.coalesce("processing_duration_ms", F.lit(0)).alias("duration_ms"), total.alias("elapsed_ms"))


def processor_stats(records: DataFrame) -> DataFrame:
    ms, q = F.col("processing_duration_ms"), F.col("processing_quality_score")
    return records.groupBy("processor", "processor_version").agg(F.count("*").alias("n"), F.round(F.avg(ms), 4).alias("avg_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), F.sum(ms).alias("total_ms"), F.round(F.avg(q), 4).alias("avg_quality"))


def prov_statements(records: DataFrame, *by: str) -> DataFrame:
    """W3C PROV statements, one a row: kind, subject, object, after the columns `by` of the record. A derivation whose source is outside the records is left out."""
    entity = F.concat(F.lit("entity:"), F.col("id").cast("string"))
    activity = F.concat(F.lit("activity:"), F.col("id").cast("string"))
    agent = F.concat(F.lit("agent:"), slug_agent("processor"))
    none = F.lit(None).cast("string")
    row = lambda kind, s, o: F.struct(F.lit(kind).alias("kind"), s.alias("subject"), o.alias("object"))
    each = records.select(*by, F.explode(F.array(row("entity", entity, none), row("activity", activity, none), row("agent", agent, none), row("wasGeneratedBy", entity, activity), row("wasAttributedTo", entity, agent))).alias("s")).select(*by, "s.*")
    source = records.select(F.col("id").alias("source_id"))
    derived = records.join(source, "source_id").select(*by, F.lit("wasDerivedFrom").alias("kind"), entity.alias("subject"), F.concat(F.lit("entity:"), F.col("source_id").cast("string")).alias("object"))
    return each.unionByName(derived).distinct()


def prov_json(records: DataFrame) -> DataFrame:
    """root_document_id, kind, statements: the statements of each root document."""
    s = prov_statements(records, "root_document_id")
    return s.groupBy("root_document_id", "kind").agg(F.to_json(F.sort_array(F.collect_list(F.struct("subject", "object")))).alias("statements"))


def csv_rows(records: DataFrame) -> DataFrame:
    """The fixed columns, missing ones empty, as text."""
    return records.select(*[(F.to_json(c) if dict(records.dtypes).get(c, "").startswith(("array", "struct", "map")) else F.col(c).cast("string")).alias(c) if c in records.columns else F.lit("").alias(c) for c in CSV_COLUMNS])

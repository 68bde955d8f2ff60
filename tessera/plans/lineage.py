"""Queries: provenance records of documents, their text, chunks and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import content_hash
from tessera.operators import provenance
from tessera.operators.corpus import Corpus
from tessera.plans.registry import query

# Records: a document, its text, a chunk of it, the chunk's vector.
LEVELS = (("d", "DOCUMENT", "source", None), ("o", "OCR_RESULT", "text", "d"), ("c", "CHUNK", "trim(text)", "o"), ("e", "EMBEDDING", "lower(text)", "c"))
RECORDS = "rec as (" + " union all ".join(
    f"select '{p}' || doc_id as id, '{k}' as type, {f"'{up}' || doc_id" if up else 'null::varchar'} as parent_id, 'd' || doc_id as root_document_id, {d}::bigint as chain_depth, {c} as content, 'sha256:' || sha256({c}) as content_hash, 'Engine ' || (doc_id % 3) as processor, 'v1' as processor_version, doc_id % 100 as ms from documents" for d, (p, k, c, up) in enumerate(LEVELS)
) + ")"


def records(spark, sf) -> DataFrame:
    docs = Corpus(spark, sf).documents
    out = None
    for d, (prefix, kind, content, parent) in enumerate(LEVELS):
        up = F.concat(F.lit(parent), F.col("doc_id").cast("string")) if parent else F.lit(None).cast("string")
        own = docs.select(F.concat(F.lit(prefix), F.col("doc_id").cast("string")).alias("id"), F.lit(kind).alias("type"), up.alias("parent_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("root_document_id"), F.lit(d).cast("long").alias("chain_depth"), F.expr(content).alias("content"), F.concat(F.lit("Engine "), (F.col("doc_id") % 3).cast("string")).alias("processor"), F.lit("v1").alias("processor_version"), (F.col("doc_id") % 100).alias("processing_duration_ms"), F.lit(4.0).alias("processing_quality_score"))
        out = own if out is None else out.unionByName(own)
    return out.withColumn("content_hash", content_hash(F.col("content"))).withColumn("source_id", F.col("parent_id")).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))


CHAIN = f"""{RECORDS}, c0 as (select id, content_hash, sha256(content_hash) as h, parent_id, type, root_document_id from rec where parent_id is null),
  c1 as (select r.id, r.content_hash, sha256(r.content_hash || ':' || p.h) as h, r.parent_id, r.type, r.root_document_id from rec r join c0 p on r.parent_id = p.id), c2 as (select r.id, r.content_hash, sha256(r.content_hash || ':' || p.h) as h, r.parent_id, r.type, r.root_document_id from rec r join c1 p on r.parent_id = p.id),
  c3 as (select r.id, r.content_hash, sha256(r.content_hash || ':' || p.h) as h, r.parent_id, r.type, r.root_document_id from rec r join c2 p on r.parent_id = p.id), ch as (select * from c0 union all select * from c1 union all select * from c2 union all select * from c3)"""


@query(f"with {CHAIN} select id, h as chain_hash from ch")
def chain_hashes(spark, sf):
    return provenance.with_chain_hashes(records(spark, sf).select("id", "parent_id", "content_hash")).select("id", "chain_hash")


@query(f"with {CHAIN} select root_document_id, count(*) filter (type <> 'CHUNK' or h is null) as checked, count(*) filter (type = 'EMBEDDING') as mismatched, count(*) filter (type = 'CHUNK') as missing from ch group by 1")
def verify_chain(spark, sf):
    """Of every record; chunks are made to lack their hash, so what is below them can't match."""
    r = provenance.with_chain_hashes(records(spark, sf).select("id", "parent_id", "root_document_id", "type", "content_hash"))
    return provenance.verify_chains(r.withColumn("chain_hash", F.when(F.col("type") != "CHUNK", F.col("chain_hash"))))


@query(f"with {RECORDS} select type, count(*) as total, count(*) filter (type = 'CHUNK' and root_document_id in ('d1', 'd2')) as bad_hash, 0::bigint as no_parent, 0::bigint as bad_depth from rec group by type")
def verify_records(spark, sf):
    r = records(spark, sf)
    broken = (F.col("type") == "CHUNK") & F.col("root_document_id").isin("d1", "d2")
    return provenance.verify_records(r.withColumn("content", F.when(broken, F.concat("content", F.lit("!"))).otherwise(F.col("content"))))


@query(f"""with recursive {RECORDS}, w(item, step, id, type, parent_id) as (select id, 0, id, type, parent_id from rec where type = 'EMBEDDING' union all select w.item, w.step + 1, r.id, r.type, r.parent_id from w join rec r on w.parent_id = r.id) select item, step, id, type from w""")
def lineage(spark, sf):
    r = records(spark, sf)
    return provenance.lineage(r, r.where("type = 'EMBEDDING'").select("id"))


@query(f"with {RECORDS} select id, chain_depth::integer as depth, case chain_depth when 0 then '' when 1 then root_document_id when 2 then replace(root_document_id, 'd', 'o') || ',' || root_document_id else replace(root_document_id, 'd', 'c') || ',' || replace(root_document_id, 'd', 'o') || ',' || root_document_id end as path from rec")
def lineage_recursive(spark, sf):
    return provenance.ancestors(records(spark, sf)).select("id", "depth", F.array_join("path", ",").alias("path"))


@query(f"with {RECORDS} select id, type from rec where (type = 'DOCUMENT' and id not in (select 'd' || doc_id from documents where doc_id % 10 <> 0)) or (type = 'CHUNK' and id not in (select 'c' || doc_id from labels))")
def orphans(spark, sf):
    c = Corpus(spark, sf)
    own = lambda df, p: df.select(F.concat(F.lit(p), F.col("doc_id").cast("string")).alias("provenance_id"))
    return provenance.orphans(records(spark, sf), {"DOCUMENT": (own(c.documents.where("doc_id % 10 <> 0"), "d"), "provenance_id"), "CHUNK": (own(c.labels, "c"), "provenance_id")})


@query(f"with {RECORDS} select row_number() over (order by chain_depth) as step, id, type, processor, ms as duration_ms, cast(sum(ms) over (order by chain_depth) as bigint) as elapsed_ms from rec where root_document_id = 'd5'")
def provenance_timeline(spark, sf):
    return provenance.timeline(records(spark, sf), "d5")


@query(f"with {RECORDS} select processor, processor_version, count(*) as n, round(avg(ms), 4) as avg_ms, min(ms) as min_ms, max(ms) as max_ms, cast(sum(ms) as bigint) as total_ms, 4.0::double as avg_quality from rec group by all")
def provenance_processors(spark, sf):
    return provenance.processor_stats(records(spark, sf))


@query(
    f"""with {RECORDS}, s as (select * from rec), a as (select *, 'agent:' || regexp_replace(lower(processor), '[^a-z0-9_-]+', '_', 'g') as agent from s)
    select distinct 'entity' as kind, 'entity:' || id as subject, null::varchar as object from a union select 'activity', 'activity:' || id, null from a union select 'agent', agent, null from a union select 'wasGeneratedBy', 'entity:' || id, 'activity:' || id from a union select 'wasAttributedTo', 'entity:' || id, agent from a
    union select 'wasDerivedFrom', 'entity:' || id, 'entity:' || parent_id from a where parent_id in (select id from s)"""
)
def prov_statements(spark, sf):
    return provenance.prov_statements(records(spark, sf))


@query(f"with {RECORDS} select id, type, content_hash, '' as file_hash, chain_depth::varchar as chain_depth from rec")
def provenance_csv(spark, sf):
    return provenance.csv_rows(records(spark, sf)).select("id", "type", "content_hash", "file_hash", "chain_depth")


@query(None)
def prov_json(spark, sf):
    """PROV-JSON statements grouped by root document and kind; the text form of JSON differs between engines."""
    return provenance.prov_json(records(spark, sf))


DEEP = "r as (select 'e' || event_id as id, case when event_id % 12 = 0 then null when event_id % 97 = 0 then 'gone' || event_id else 'e' || (event_id - 1) end as parent_id, 'sha256:' || sha256(event_type || event_id) as content_hash from events)"


def deep(spark, sf) -> DataFrame:
    """Chains of up to twelve records; some have lost the parent on the way."""
    i = F.col("event_id")
    parent = F.when(i % 12 == 0, None).when(i % 97 == 0, F.concat(F.lit("gone"), i)).otherwise(F.concat(F.lit("e"), i - 1))
    return Corpus(spark, sf).events.select(F.concat(F.lit("e"), i).alias("id"), parent.alias("parent_id"), content_hash(F.concat("event_type", i.cast("string"))).alias("content_hash"), F.lit("CHUNK").alias("type"), i.alias("n"))


@query(f"with recursive {DEEP}, w(id, h) as (select id, sha256(content_hash) from r where parent_id is null union all select r.id, sha256(r.content_hash || ':' || w.h) from r join w on r.parent_id = w.id) select r.id, w.h as chain_hash from r left join w on r.id = w.id")
def deep_chain_hashes(spark, sf):
    return provenance.with_chain_hashes(deep(spark, sf).select("id", "parent_id", "content_hash")).select("id", "chain_hash")


@query(f"with recursive {DEEP}, w(item, step, up) as (select id, 0, parent_id from r union all select w.item, w.step + 1, r.parent_id from w join r on w.up = r.id) select item as id, max(step)::integer as depth from w group by item")
def deep_lineage(spark, sf):
    return provenance.ancestors(deep(spark, sf)).select("id", "depth")


@query(f"with {RECORDS}, f as (select * from rec where type = 'CHUNK' and processor = 'Engine 1' and ms >= 10 and chain_depth >= 2) select id, type, (select count(*) from f) as total from f order by ms desc, id limit 20 offset 5")
def provenance_query(spark, sf):
    return provenance.find(records(spark, sf), type="CHUNK", processor="Engine 1", least_ms=10, least_depth=2, order="processing_duration_ms", limit=20, offset=5).select("id", "type", "total")


@query(f"with {RECORDS} select id, type, chain_depth from rec where root_document_id = 'd7'")
def provenance_by_root(spark, sf):
    return provenance.scope(provenance.by_root(records(spark, sf), "d7"), "document", "d7").select("id", "type", "chain_depth")


@query(f"with {RECORDS} select c.id, c.parent_id, p.root_document_id || ',' || replace(p.root_document_id, 'd', 'o') as parent_ids, (p.chain_depth + 1)::bigint as chain_depth, 'DOCUMENT,OCR_RESULT,CHUNK' as chain_path, p.root_document_id from rec c join rec p on c.parent_id = p.id where c.type = 'CHUNK'")
def provenance_created(spark, sf):
    r = records(spark, sf)
    parents = r.where("type = 'OCR_RESULT'").select("id", "chain_depth", "root_document_id", F.array("parent_id").alias("parent_ids"))
    new = r.where("type = 'CHUNK'").select("id", "type", "source_id")
    return provenance.create(new, parents).select("id", "parent_id", F.array_join("parent_ids", ",").alias("parent_ids"), F.col("chain_depth").cast("long").alias("chain_depth"), F.array_join("chain_path", ",").alias("chain_path"), "root_document_id")


@query("select doc_id::varchar as item, 'document' as kind, 'd' || doc_id as provenance_id from documents where doc_id in (select doc_id from labels) union all select vec_id::varchar, 'embedding', 'v' || vec_id from embeddings where vec_id in (select doc_id from labels) union all select doc_id::varchar, null, null from labels where doc_id not in (select doc_id from documents) and doc_id not in (select vec_id from embeddings)")
def provenance_ids(spark, sf):
    c = Corpus(spark, sf)
    docs = c.documents.select(F.col("doc_id").alias("id"), F.concat(F.lit("d"), "doc_id").alias("provenance_id"))
    vectors = c.embeddings.select(F.col("vec_id").alias("id"), F.concat(F.lit("v"), "vec_id").alias("provenance_id"))
    return provenance.resolve({"document": docs, "embedding": vectors}, c.labels.select(F.col("doc_id").alias("id")))


@query(f"with {RECORDS} select type, count(*) as total, count(*) filter (type = 'OCR_RESULT' and ms = 3) as bad_hash, 0::bigint as no_parent, 0::bigint as bad_depth from rec where type in ('DOCUMENT', 'OCR_RESULT') group by type")
def verify_contents(spark, sf):
    docs = Corpus(spark, sf).documents
    text = F.when(F.col("doc_id") % 100 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    owners = {"DOCUMENT": docs.select(F.concat(F.lit("d"), "doc_id").alias("provenance_id"), F.col("source").alias("content")), "OCR_RESULT": docs.select(F.concat(F.lit("o"), "doc_id").alias("provenance_id"), text.alias("content"))}
    return provenance.verify_records(provenance.contents(records(spark, sf).where("type in ('DOCUMENT', 'OCR_RESULT')"), owners))


@query(f"with {RECORDS} select id as item, 'DOCUMENT -> OCR_RESULT -> CHUNK -> EMBEDDING' as summary from rec where type = 'EMBEDDING'")
def lineage_summary(spark, sf):
    r = records(spark, sf)
    return provenance.summary(r, r.where("type = 'EMBEDDING'").select("id"))

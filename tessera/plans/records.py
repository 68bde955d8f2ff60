"""Queries: lists of stored entities, processing jobs, clusters, compliance, comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import clusters, compare, compliance, jobs, lists
from tessera.operators.corpus import Corpus
from tessera.plans.registry import query

# Images, derived from parts; annotations, extractions and jobs, from events.
IMAGES = """img as (select p_partkey as id, p_partkey % 50 as document_id, (p_size % 7)::integer as page_number, case p_partkey % 5 when 0 then 'pending' when 1 then 'failed' else 'complete' end as vlm_status, case when p_partkey % 5 > 1 then (p_partkey % 97) / 97.0::double end as vlm_confidence, p_brand as image_type, p_name as vlm_description from part)"""
NOTES = "n as (select event_id as id, user_id % 40 as document_id, event_type as annotation_type, case when value > 50 then 'open' else 'closed' end as status, user_id, ts as created_at, props from events)"


def image_table(spark, sf):
    k = F.col("p_partkey")
    state = F.when(k % 5 == 0, "pending").when(k % 5 == 1, "failed").otherwise("complete")
    return Corpus(spark, sf).part.select(k.alias("id"), (k % 50).alias("document_id"), (F.col("p_size") % 7).cast("int").alias("page_number"), state.alias("vlm_status"), F.when(k % 5 > 1, (k % 97) / 97.0).alias("vlm_confidence"), F.col("p_brand").alias("image_type"), F.col("p_name").alias("vlm_description"), (F.col("p_size") * 20).alias("width"), (F.col("p_size") * 10).alias("height"))


def notes(spark, sf):
    return Corpus(spark, sf).events.select(F.col("event_id").alias("id"), (F.col("user_id") % 40).alias("document_id"), F.col("event_type").alias("annotation_type"), F.when(F.col("value") > 50, "open").otherwise("closed").alias("status"), "user_id", F.col("ts").alias("created_at"), "props")


@query(f"with {IMAGES}, f as (select * from img where vlm_status = 'complete' and vlm_confidence >= 0.5 and contains(lower(vlm_description), 'a')) select id, document_id, (select count(*) from f) as total from f order by document_id, page_number, id limit 25 offset 3")
def images_list(spark, sf):
    return lists.images(image_table(spark, sf), status="complete", least_confidence=0.5, text="A", limit=25, offset=3).select("id", "document_id", "total")


@query(f"with {IMAGES} select id from img where vlm_status = 'pending' order by document_id, page_number, id limit 30")
def images_pending(spark, sf):
    return lists.pending_images(image_table(spark, sf), 30).select("id")


@query(f"with {IMAGES} select count(*) as total, count(*) filter (vlm_status = 'complete') as complete, count(*) filter (vlm_status = 'pending') as pending, count(*) filter (vlm_status = 'processing') as processing, count(*) filter (vlm_status = 'failed') as failed, round(avg(vlm_confidence), 9) as avg_confidence from img")
def image_stats(spark, sf):
    return lists.image_stats(image_table(spark, sf)).withColumn("avg_confidence", F.round("avg_confidence", 9))


@query(f"""with {IMAGES}, d as (select distinct doc_id % 60 as document_id from documents), o as (select document_id, count(*) as n, count(*) filter (vlm_status = 'complete') as c, count(*) filter (vlm_status = 'pending') as p, count(*) filter (vlm_status = 'failed') as f, avg(vlm_confidence) as a, min(vlm_confidence) as lo, max(vlm_confidence) as hi from img group by 1)
    select d.document_id, coalesce(n, 0) as image_count, coalesce(c, 0) as vlm_complete, coalesce(p, 0) as vlm_pending, coalesce(f, 0) as vlm_failed, round(coalesce(a, 0), 9) as avg_confidence, coalesce(lo, 0) as min_confidence, coalesce(hi, 0) as max_confidence from d left join o on d.document_id = o.document_id""")
def evaluation_report(spark, sf):
    docs = Corpus(spark, sf).documents.select((F.col("doc_id") % 60).alias("document_id")).distinct()
    return lists.evaluation_report(docs, image_table(spark, sf)).withColumn("avg_confidence", F.round("avg_confidence", 9))


@query(f"with {IMAGES} select id, vlm_confidence from img where vlm_status = 'complete' and vlm_confidence < 0.7 order by vlm_confidence, id limit 50")
def low_confidence_images(spark, sf):
    return lists.low_confidence(image_table(spark, sf)).select("id", "vlm_confidence")


@query(f"with {IMAGES} select event_id, page_number, image_type from events left join img on event_id = img.id")
def image_metadata(spark, sf):
    hits = Corpus(spark, sf).events.select("event_id", F.col("event_id").alias("image_id"))
    return lists.with_images(hits, image_table(spark, sf)).select("event_id", "page_number", "image_type")


@query(f"with {NOTES}, f as (select * from n where status = 'open' and annotation_type = 'click') select id, document_id, (select count(*) from f) as total from f order by created_at desc, id limit 20")
def annotations_list(spark, sf):
    return lists.annotations(notes(spark, sf), kind="click", status="open", limit=20).select("id", "document_id", "total")


@query(f"""with {NOTES} select id from n where contains(lower(props), 'k": 7') and document_id = 3 order by created_at desc, id limit 40""")
def extractions_search(spark, sf):
    return lists.extractions(notes(spark, sf).withColumn("extraction_json", F.col("props")), 'K": 7', 3, 40).select("id")


@query(f"with {NOTES}, f as (select * from n where contains(lower(props), '1') or contains(status, '1') or contains(annotation_type, '1')) select id, (select count(*) from f) as total from f order by created_at desc, id limit 10 offset 10")
def form_fills_search(spark, sf):
    rows = notes(spark, sf).withColumn("field_data_json", F.col("props")).withColumn("fields_filled", F.col("status")).withColumn("source_file_path", F.col("annotation_type"))
    return lists.form_fills(rows, "1", 10, 10).select("id", "total")


@query("select vec_id from embeddings where label = 3 and vec_id % 2 = 0")
def embeddings_list(spark, sf):
    rows = Corpus(spark, sf).embeddings.select("vec_id", F.col("label").alias("document_id"), F.lit("m").alias("model_name"), F.when(F.col("vec_id") % 2 == 0, F.col("vec_id")).alias("chunk_id"), F.when(F.col("vec_id") % 2 == 1, F.col("vec_id")).alias("image_id"))
    return lists.embeddings(rows, 3, "chunk", "m").select("vec_id")


@query("select (select count(*) from embeddings) as n_vectors, (select round(sum(x)::double, 5) from (select unnest(embedding) as x from embeddings where vec_id = 7)) as total")
def vector_lookup(spark, sf):
    e = Corpus(spark, sf).embeddings
    one = lists.vector(e, "vec_id", 7).select(F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 5))
    return lists.vector_count(e).withColumn("total", one.scalar())


@query("select conv_id as document_id, turn as chunk_index from conversations where (conv_id + turn) % 3 = 0 order by 1, 2 limit 50")
def chunks_pending(spark, sf):
    rows = Corpus(spark, sf).conversations.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, "pending").otherwise("complete").alias("embedding_status"))
    return lists.pending_chunks(rows, 50).select("document_id", "chunk_index")


@query("select e.vec_id, c.text, d.source as file_name from embeddings e left join (select doc_id, text from documents where doc_id % 2 = 0) c on e.vec_id = c.doc_id left join documents d on e.label = d.doc_id")
def vector_items(spark, sf):
    c = Corpus(spark, sf)
    own = c.embeddings.select("vec_id", F.col("vec_id").alias("chunk_id"), F.col("label").alias("document_id"))
    chunks = c.documents.where("doc_id % 2 = 0").select(F.col("doc_id").alias("chunk_id"), "text")
    return lists.with_items(own.select("vec_id"), "vec_id", own, chunks, c.documents.select(F.col("doc_id").alias("document_id"), F.col("source").alias("file_name"))).select("vec_id", "text", "file_name")


@query("select o_orderkey as id, a.c_name as name_1, b.c_name as name_2 from orders left join customer a on o_custkey = a.c_custkey left join customer b on o_custkey + 1 = b.c_custkey")
def comparison_names(spark, sf):
    c = Corpus(spark, sf)
    pairs = c.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id_1"), (F.col("o_custkey") + 1).alias("document_id_2"))
    return lists.named_pairs(pairs, c.customer.select(F.col("c_custkey").alias("document_id"), F.col("c_name").alias("file_name"))).select("id", "name_1", "name_2")


@query("select event_id, case when event_id % 3 = 0 then event_type || '|' || user_id when event_id % 3 = 1 then event_type || '|b' else 'a|b' end as items from events")
def json_or_commas(spark, sf):
    i = F.col("event_id")
    value = F.when(i % 3 == 0, F.concat(F.lit('["'), "event_type", F.lit('", "'), F.col("user_id").cast("string"), F.lit('"]'))).when(i % 3 == 1, F.concat("event_type", F.lit(" , b,, "))).otherwise(F.lit(" a,b"))
    return Corpus(spark, sf).events.select("event_id", F.array_join(lists.json_or_commas(value), "|").alias("items"))


@query("select event_id, case when event_id % 4 = 3 then null else coalesce(case when event_id % 4 <> 2 then event_type end, 'other') end as image_type, case when event_id % 4 = 3 then null when event_id % 4 = 2 then 0.5 else 0.25 end::double as confidence from events")
def model_answers(spark, sf):
    """Answers in a code fence, within other words, without some parts, and without JSON."""
    i, body = F.col("event_id"), F.concat(F.lit('{"imageType": "'), "event_type", F.lit('", "confidence": 0.25, "dates": ["x"]}'))
    said = F.when(i % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(i % 4 == 1, F.concat(F.lit("Let me see. "), body, F.lit(" Done."))).when(i % 4 == 2, F.lit("{}")).otherwise(F.lit("no answer"))
    own = Corpus(spark, sf).events.select("event_id", lists.evaluation(said).alias("e"))
    return own.select("event_id", F.col("e.imageType").alias("image_type"), F.col("e.confidence").alias("confidence"))


# --- processing jobs: events as a status log of documents

LOG = "l as (select user_id as document_id, case event_type when 'signup' then 'pending' when 'error' then 'failed' when 'purchase' then 'complete' else 'processing' end as status, ts as at_, event_id as seq from events), s as (select * from l qualify row_number() over (partition by document_id order by at_ desc, seq desc) = 1)"


def job_log(spark, sf):
    kind = F.col("event_type")
    state = F.when(kind == "signup", "pending").when(kind == "error", "failed").when(kind == "purchase", "complete").otherwise("processing")
    return Corpus(spark, sf).events.select(F.col("user_id").alias("document_id"), state.alias("status"), F.lit(None).cast("string").alias("error"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"))


def job_time():
    return F.lit("2024-01-30 12:00:00").cast("timestamp")


@query(f"with {LOG}, p as (select * from s where status = 'pending' order by at_, document_id limit 15) select document_id, 'processing' as status, seq + 1 as seq from p")
def jobs_claimed(spark, sf):
    return jobs.claim(job_log(spark, sf), job_time(), 15).select("document_id", "status", "seq")


@query(f"with {LOG} select document_id, 'pending' as status, seq + 1 as seq from s where status = 'failed'")
def jobs_retried(spark, sf):
    return jobs.retry_failed(job_log(spark, sf), job_time()).select("document_id", "status", "seq")


@query(f"with {LOG} select document_id, 'pending' as status, 'stale' as error from s where status = 'processing' and at_ < timestamp '2024-01-30 12:00:00' - interval 30 minute")
def jobs_recovered(spark, sf):
    return jobs.recover_stale(job_log(spark, sf), job_time()).select("document_id", "status", "error")


@query("select doc_id as document_id, case when doc_id % 7 = 0 then 'failed' else 'complete' end as status, case when doc_id % 7 = 0 then 'ValueError: bad 0' end as error, case when doc_id % 7 <> 0 then source || ' read' end as result from documents")
def jobs_processed(spark, sf):
    """A stand-in for recognition that fails on some documents; each row says how it went."""

    def work(item: str) -> str:
        if item.startswith("!"):
            raise ValueError("bad 0")
        return f"{item} read"

    docs = Corpus(spark, sf).documents.select(F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 7 == 0, "!").otherwise(F.col("source")).alias("path"))
    done = jobs.process(docs, "document_id", "path", work, attempts=2, failures=10**9)
    return jobs.results(done, job_time(), 9, "result").select("document_id", "status", "error", "result")


@query("select doc_id, case when lang = 'fr' then 'new' else 'old' end as model from documents")
def embeddings_rebuilt(spark, sf):
    docs = Corpus(spark, sf).documents
    old = docs.select("doc_id", F.lit("old").alias("model"))
    return jobs.rerun(old, docs.where("lang = 'fr'").select("doc_id", F.lit("new").alias("model")), "doc_id")


@query("select event_id from events where event_type in ('click', 'error') and event_id > 100")
def events_replayed(spark, sf):
    return jobs.replay(jobs.subscribed(Corpus(spark, sf).events, "click", "error"), 100).select("event_id")


# --- clusters

MEMBERS = "a as (select (vec_id % 2)::bigint as run_id, vec_id as document_id, case when vec_id % 11 = 0 then null else label end as cluster_id from embeddings)"


def members(spark, sf):
    v = F.col("vec_id")
    return Corpus(spark, sf).embeddings.select((v % 2).cast("long").alias("run_id"), v.alias("document_id"), F.when(v % 11 != 0, F.col("label")).alias("cluster_id"))


@query(f"with {MEMBERS}, m as (select run_id, document_id, case when document_id < 20 then 5 when run_id = 0 and cluster_id = 2 then 1 else cluster_id end as cluster_id from a where run_id = 0 or document_id >= 0), r as (select run_id, document_id, case when document_id < 20 then 5 when run_id = 0 and cluster_id = 2 then 1 else cluster_id end as cluster_id from a) select run_id, cluster_id, count(*) as document_count from r where cluster_id is not null group by all")
def clusters_changed(spark, sf):
    """Some documents moved to cluster 5, then cluster 2 of a run merged into 1; the counts that follow."""
    own = members(spark, sf)
    moved = clusters.reassign(own, own.where("document_id < 20").select("document_id", "run_id", F.lit(5).cast(dict(own.dtypes)["cluster_id"]).alias("cluster_id")))
    return clusters.counted(clusters.merge(moved, 0, 1, 2))


@query(f"with {MEMBERS}, c as (select run_id, cluster_id, count(*) as n from a where cluster_id is not null group by all) select cluster_id, n as document_count from c where run_id = 1 order by n desc, cluster_id")
def clusters_list(spark, sf):
    return clusters.listed(clusters.without_run(clusters.counted(members(spark, sf)), 0), run=1).select("cluster_id", "document_count")


@query(f"with {MEMBERS}, c as (select run_id, cluster_id, count(*) / 100.0::double as coherence from a where cluster_id is not null group by all) select count(*) as total_clusters, count(distinct run_id) as total_runs, round(avg(coherence), 9) as avg_coherence from c")
def clustering_stats(spark, sf):
    own = clusters.counted(members(spark, sf)).withColumn("coherence", F.col("document_count") / 100.0)
    return clusters.stats(own).withColumn("avg_coherence", F.round("avg_coherence", 9))


# --- compliance: events are audit entries, customers are users

ENTRIES = "e as (select event_id as id, user_id, case event_type when 'click' then 'document.get' when 'view' then 'search.run' when 'purchase' then 'approval.decide' when 'signup' then 'ingest.file' else 'other' end as action, ts as created_at from events where ts >= timestamp '2024-01-05' and ts <= timestamp '2024-01-20')"


def audit(spark, sf):
    kind = F.col("event_type")
    action = F.when(kind == "click", "document.get").when(kind == "view", "search.run").when(kind == "purchase", "approval.decide").when(kind == "signup", "ingest.file").otherwise("other")
    own = Corpus(spark, sf).events.select(F.col("event_id").alias("id"), "user_id", action.alias("action"), F.col("ts").cast("timestamp").alias("created_at"), F.lit("document").alias("entity_type"), F.col("event_id").alias("entity_id"))
    users = Corpus(spark, sf).customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("display_name"), F.col("c_mktsegment").alias("role"))
    return compliance.within(own, "2024-01-05", "2024-01-20"), users


@query(f"with {ENTRIES} select 'access_controls' as section, count(*) as n, null::double as coverage from customer union all select 'audit_trail', count(*), null from e union all select 'data_integrity', 1, (select round(100.0 * count(*) filter (doc_id % 4 <> 0) / count(*), 2)::double from documents)")
def soc2_report(spark, sf):
    records = Corpus(spark, sf).documents.select(F.when(F.col("doc_id") % 4 != 0, F.lit("sha256:x")).alias("content_hash"))
    report = compliance.soc2(*audit(spark, sf), records)
    return report.groupBy("section").agg(F.count("*").alias("n"), F.max(F.get_json_object("detail", "$.coverage_pct").cast("double")).alias("coverage"))


@query(f"with {ENTRIES} select 'phi_access' as section, count(*) as n from e where contains(action, 'search') or contains(action, 'document.get') union all select 'user_authentication', count(*) from customer union all select 'document_inventory', 1")
def hipaa_report(spark, sf):
    return compliance.totals(compliance.hipaa(*audit(spark, sf), Corpus(spark, sf).documents))


@query(f"with {ENTRIES} select 'document_trail' as section, count(*) as n, count(c_name) as named from e left join customer on user_id = c_custkey where contains(action, 'ingest') or contains(action, 'approval') union all select 'approval_decisions', count(*), count(c_name) from orders left join customer on o_custkey = c_custkey union all select 'workflow_states', count(*), 0 from nation")
def sox_report(spark, sf):
    c = Corpus(spark, sf)
    steps = c.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("decided_by"))
    states = c.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("state"))
    report = compliance.sox(*audit(spark, sf), steps, states)
    name = F.coalesce(F.get_json_object("detail", "$.user_name"), F.get_json_object("detail", "$.decided_by_name"))
    return report.groupBy("section").agg(F.count("*").alias("n"), F.count(name).alias("named"))


# --- comparisons

@query("""with c as (select conv_id as doc_id, string_agg(role || chr(10), '' order by turn) as text from conversations group by conv_id), p as (select a.doc_id as a, b.doc_id as b, a.text as x, b.text as y from c a join c b on b.doc_id = a.doc_id + 1),
    r as (select *, least(length(x), length(y)) as n from p where starts_with(x, y) or starts_with(y, x)) select a, b, round(2.0 * n / (length(x) + length(y)), 4)::double as similarity, case when length(y) > length(x) then 1 else 0 end::integer as insertions, case when length(x) > length(y) then 1 else 0 end::integer as deletions, 1::integer as unchanged from r""")
def diff_operations(spark, sf):
    """Line diffs of neighbouring conversations by role, of which one begins with the other."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(x["role"], F.lit("\n"))), "")
    docs = Corpus(spark, sf).conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(lines.alias("text"))
    pairs = docs.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))
    x, y = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), docs.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
    begin = pairs.join(x, "a").join(y, "b").where(F.startswith("x", F.col("y")) | F.startswith("y", F.col("x"))).select("a", "b")
    return compare.compared(begin, docs, "doc_id", "text").select("a", "b", "similarity", "insertions", "deletions", "unchanged")


@query("""with m as (select vec_id from embeddings where label = 4), p as (select a.vec_id as a, b.vec_id as b from m a join m b on a.vec_id < b.vec_id), d as (select doc_id, source, n_chars from documents)
    select a, b, x.n_chars as n_chars_a, y.n_chars as n_chars_b, 'Comparison of "' || x.source || '" vs "' || y.source || '". Text similarity: 50%. 1 insertions, 2 deletions, 3 unchanged sections.' || case when x.n_chars <> y.n_chars then ' Page count difference: ' || abs(x.n_chars - y.n_chars) || ' pages.' else '' end as summary from p join d x on a = x.doc_id join d y on b = y.doc_id""")
def comparison_batch(spark, sf):
    """All pairs of one cluster, side by side and in words."""
    c = Corpus(spark, sf)
    facts = c.documents.where("source is not null").select(F.col("doc_id").alias("vec_id"), "source", "n_chars")
    both = compare.cluster_pairs(c.embeddings.withColumn("cluster", F.col("label")), 4, "vec_id", facts)
    words = compare.comparison_summary(F.col("source_a"), F.col("source_b"), F.lit(0.5), F.lit(1), F.lit(2), F.lit(3), F.col("n_chars_a"), F.col("n_chars_b"))
    return both.select("a", "b", "n_chars_a", "n_chars_b", words.alias("summary"))

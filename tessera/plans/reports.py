"""Queries: reports, filters and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalar, text
from tessera.operators import reports
from tessera.operators.corpus import Corpus, current, fingerprint, gaps, merge_metadata, without
from tessera.plans.registry import query


def events(spark, sf):
    return Corpus(spark, sf).events


def trend(name: str, unit: str, form: str):
    def run(spark, sf):
        return reports.trend(events(spark, sf), "ts", unit, ("event_type",), n=F.count("*"), total=F.round(F.sum("value"), 4), mean=F.round(F.avg("value"), 9), least=F.min("value"), most=F.max("value"))

    run.__name__ = name
    query(f"select strftime(ts, '{form}') as period, event_type, count(*) as n, round(sum(value), 4) as total, round(avg(value), 9) as mean, min(value) as least, max(value) as most from events where ts is not null group by 1, 2")(run)


for _name, _unit, _form in (("trends_hourly", "hour", "%Y-%m-%d %H:00"), ("trends_daily", "day", "%Y-%m-%d"), ("trends_weekly", "week", "%Y-W%W"), ("trends_monthly", "month", "%Y-%m")):
    trend(_name, _unit, _form)


@query(
    """select strftime(ts, '%Y-%m-%d') as period, count(*) filter (event_type <> 'error') as processed, count(*) filter (event_type = 'error') as failed, round(sum(case when event_type <> 'error' then value else 0 end), 4) as total_ms,
    case when count(*) filter (event_type <> 'error') > 0 then round(sum(case when event_type <> 'error' then value else 0 end) / count(*) filter (event_type <> 'error'), 9) else 0.0 end as avg_ms from events group by 1"""
)
def throughput(spark, sf):
    ok = F.col("event_type") != "error"
    out = reports.trend(events(spark, sf), "ts", "day", processed=F.count_if(ok), failed=F.count_if(~ok), total_ms=F.sum(F.when(ok, F.col("value")).otherwise(0.0)))
    return out.withColumn("avg_ms", reports.mean_or_zero(F.col("total_ms"), F.col("processed"), 9)).withColumn("total_ms", F.round("total_ms", 4))


@query("""select event_type, user_id % 3 as version, count(*) as n, round(avg(value), 9) as avg_ms, min(value) as min_ms, max(value) as max_ms, round(sum(value), 4) as total_ms from events group by all""")
def processor_stats(spark, sf):
    v = F.col("value")
    return events(spark, sf).groupBy("event_type", (F.col("user_id") % 3).alias("version")).agg(F.count("*").alias("n"), F.round(F.avg(v), 9).alias("avg_ms"), F.min(v).alias("min_ms"), F.max(v).alias("max_ms"), F.round(F.sum(v), 4).alias("total_ms"))


@query("""select user_id % 10 as file_type, count(*) as total, cast(sum(case when event_type = 'error' then 1 else 0 end) as bigint) as failures, case when count(*) > 0 then round(100.0::double * sum(case when event_type = 'error' then 1 else 0 end) / count(*), 2) else 0.0 end as failure_rate from events group by 1""")
def error_rates(spark, sf):
    return reports.failure_rates(events(spark, sf).withColumn("file_type", F.col("user_id") % 10), "file_type", F.col("event_type") == "error")


@query("""select json_extract_string(props, '$.k') as message, count(*) as n from events where event_type = 'error' group by 1 order by n desc, message limit 10""")
def top_errors(spark, sf):
    own = events(spark, sf).where("event_type = 'error'").withColumn("message", F.get_json_object("props", "$.k"))
    return reports.top(reports.counted_by(own, "message"), [F.desc("n"), F.asc("message")], 10)


@query(
    """select (select count(*) from documents) as n_documents, (select count(distinct source) from documents) as n_sources, (select count(*) from embeddings) as n_embeddings, (select count(*) from pages) as n_pages,
    (select round(avg(quality * 5.0), 9) from labels) as avg_quality, (select min(n_chars) from documents) as min_chars, (select max(n_chars) from documents) as max_chars, (select round(avg(n_chars), 9) from documents) as avg_chars"""
)
def database_stats(spark, sf):
    c = Corpus(spark, sf)
    base = c.documents.agg(F.count("*").alias("n_documents"), F.count_distinct("source").alias("n_sources"), F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"), F.round(F.avg("n_chars"), 9).alias("avg_chars"))
    one = lambda df, e: df.agg(e).toDF("x").scalar()
    return base.withColumn("n_embeddings", one(c.embeddings, F.count("*"))).withColumn("n_pages", one(c.pages, F.count("*"))).withColumn("avg_quality", one(c.labels, F.round(F.avg(F.col("quality") * 5.0), 9)))


@query("""select strftime(l_shipdate, '%Y-%m') as month, l_returnflag as mode, round(sum(l_extendedprice * l_discount), 2) as cost_cents, count(*) as n from lineitem group by 1, 2""")
def cost_by_month(spark, sf):
    return Corpus(spark, sf).lineitem.groupBy(scalar.bucket("l_shipdate", "month").alias("month"), F.col("l_returnflag").alias("mode")).agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("cost_cents"), F.count("*").alias("n"))


@query("""select l_orderkey as document, round(sum(l_extendedprice), 2) as cost from lineitem group by 1 order by sum(l_extendedprice) desc, 1 limit 50""")
def cost_by_document(spark, sf):
    own = Corpus(spark, sf).lineitem.groupBy(F.col("l_orderkey").alias("document")).agg(F.sum("l_extendedprice").alias("raw"))
    return reports.top(own, [F.desc("raw"), F.asc("document")], 50).select("document", F.round("raw", 2).alias("cost"))


@query("""select word as item, count(*) as n, count(distinct doc_id) as n_rows from (select doc_id, unnest(string_split(lower(text), ' ')) as word from documents) group by 1""")
def content_type_distribution(spark, sf):
    return reports.distribution(Corpus(spark, sf).documents, F.split(F.lower("text"), " "))


@query("""select source, lang, count(*) as n, count(distinct text) as n_distinct from documents group by all""")
def section_frequency(spark, sf):
    return Corpus(spark, sf).documents.groupBy("source", "lang").agg(F.count("*").alias("n"), F.count_distinct("text").alias("n_distinct"))


@query("""select count(*) filter (n_chars >= 0 and n_chars < 500) as poor, count(*) filter (n_chars >= 500 and n_chars < 1500) as fair, count(*) filter (n_chars >= 1500 and n_chars < 3000) as good, count(*) filter (n_chars >= 3000 and n_chars < 1e12) as excellent, count(*) filter (n_chars is null) as unknown from documents""")
def quality_bands(spark, sf):
    return reports.bands(Corpus(spark, sf).documents, "n_chars", {"poor": (0, 500), "fair": (500, 1500), "good": (1500, 3000), "excellent": (3000, 1e12)})


@query("""select lang, count(*) as n, min(c) as min_chunks, max(c) as max_chunks, round(avg(c), 9) as avg_chunks from (select doc_id, lang, len(string_split(text, chr(10))) as c from documents) group by lang""")
def chunks_per_document(spark, sf):
    own = Corpus(spark, sf).documents.select("lang", F.size(F.split("text", "\n")).cast("long").alias("c"))
    return own.groupBy("lang").agg(F.count("*").alias("n"), F.min("c").alias("min_chunks"), F.max("c").alias("max_chunks"), F.round(F.avg("c"), 9).alias("avg_chunks"))


@query("""select case when vec_id % 5 = 0 then 'vlm' when vec_id % 5 = 1 then 'extraction' else 'chunk' end as source_type, label % 2 as device, count(*) as n from embeddings group by all""")
def embedding_stats(spark, sf):
    kind = F.when(F.col("vec_id") % 5 == 0, "vlm").when(F.col("vec_id") % 5 == 1, "extraction").otherwise("chunk")
    return Corpus(spark, sf).embeddings.groupBy(kind.alias("source_type"), (F.col("label") % 2).alias("device")).agg(F.count("*").alias("n"))


@query("""select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as at, 30 as page_size from events where ts < timestamp '2024-01-15 12:00:00' or (ts = timestamp '2024-01-15 12:00:00' and event_id < 5000) order by ts desc, event_id desc limit 30""")
def keyset_page(spark, sf):
    out = reports.after_cursor(events(spark, sf), "ts", "event_id", ("2024-01-15 12:00:00", 5000), 30)
    return out.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.lit(30).alias("page_size"))


@query("""select o_orderkey, (select count(*) from orders) as total from orders order by o_totalprice desc, o_orderkey limit 25 offset 50""")
def offset_page(spark, sf):
    return reports.page(Corpus(spark, sf).orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], 25, 50).select("o_orderkey", "total")


@query("""select o_orderkey, strftime(case when o_orderkey % 7 = 0 then null else o_orderdate end, '%Y-%m-%d') as due from orders where o_orderstatus = 'O' order by case when o_orderkey % 7 = 0 then null else o_orderdate end asc nulls last, o_orderkey desc limit 40""")
def obligations_list(spark, sf):
    own = Corpus(spark, sf).orders.where("o_orderstatus = 'O'").withColumn("d", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")))
    return own.orderBy(F.asc_nulls_last("d"), F.desc("o_orderkey")).limit(40).select("o_orderkey", F.date_format("d", "yyyy-MM-dd").alias("due"))


@query("""select event_type as action, count(*) as n, count(distinct user_id) as n_users, strftime(min(ts), '%Y-%m-%d') as first_day, strftime(max(ts), '%Y-%m-%d') as last_day from events where event_type like 'c%' or event_type like 'v%' group by 1""")
def access_report(spark, sf):
    own = events(spark, sf).where(F.startswith("event_type", F.lit("c")) | F.startswith("event_type", F.lit("v")))
    return own.groupBy(F.col("event_type").alias("action")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"), F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_day"))


@query("""select event_id, c_name as user_name, event_type from events left join customer on user_id = c_custkey where event_type = 'purchase' and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-07'""")
def audit_query(spark, sf):
    c = Corpus(spark, sf)
    own = c.events.where("event_type = 'purchase' and ts >= timestamp'2024-01-05' and ts < timestamp'2024-01-07'")
    return own.join(c.customer, F.col("user_id") == F.col("c_custkey"), "left").select("event_id", F.col("c_name").alias("user_name"), "event_type")


@query("""select (select count(*) from documents) as n_documents, (select count(*) from labels where doc_id in (select doc_id from documents)) as n_labelled, round(100.0::double * (select count(distinct doc_id) from labels where doc_id in (select doc_id from documents)) / (select count(*) from documents), 2) as coverage""")
def compliance_report(spark, sf):
    c = Corpus(spark, sf)
    own = c.labels.join(c.documents.select("doc_id"), "doc_id", "left_semi").agg(F.count("*").alias("n_labelled"), F.count_distinct("doc_id").alias("k"))
    return own.withColumn("n_documents", c.documents.agg(F.count("*")).toDF("n").scalar()).select("n_documents", "n_labelled", reports.share(F.col("k"), F.col("n_documents")).alias("coverage"))


@query(
    """select 'documents without label' as category, count(*) as n from documents where doc_id not in (select doc_id from labels) union all select 'labels without document', count(*) from labels where doc_id not in (select doc_id from documents)
    union all select 'events without user', count(*) from events where user_id not in (select c_custkey from customer) union all select 'customers without order', count(*) from customer where c_custkey not in (select o_custkey from orders)"""
)
def health_check(spark, sf):
    c = Corpus(spark, sf)
    users, buyers = c.customer.select(F.col("c_custkey").alias("user_id")), c.orders.select(F.col("o_custkey").alias("c_custkey"))
    return gaps({"documents without label": (c.documents, c.labels, "doc_id"), "labels without document": (c.labels, c.documents, "doc_id"), "events without user": (c.events, users, "user_id"), "customers without order": (c.customer, buyers, "c_custkey")})


@query("""select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1 and event_type <> 'error'""")
def current_state(spark, sf):
    log = events(spark, sf).withColumn("op", F.when(F.col("event_type") == "error", "delete").otherwise("put"))
    return current(log, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("""select c.conv_id, c.turn from conversations c where conv_id not in (select doc_id from labels where toxic = 1)""")
def cascade_delete(spark, sf):
    c = Corpus(spark, sf)
    return without(c.conversations, c.labels.where("toxic = 1").select(F.col("doc_id").alias("conv_id")), "conv_id").select("conv_id", "turn")


@query("""select doc_id, case when doc_id % 4 = 0 then 'new' else source end as source from documents""")
def update_metadata(spark, sf):
    docs = Corpus(spark, sf).documents
    changes = docs.where("doc_id % 4 = 0").select("doc_id", F.lit("new").alias("source"), F.lit(None).cast("string").alias("lang"))
    return merge_metadata(docs, changes, "doc_id", ["source", "lang"]).select("doc_id", "source")


@query("""select lang, count(*) as n_documents, cast(sum(length(text) - length(replace(text, ' ', '')) + 1) as bigint) as n_words, count(distinct source) as n_sources from documents group by lang""")
def corpus_summary(spark, sf):
    return Corpus(spark, sf).documents.groupBy("lang").agg(F.count("*").alias("n_documents"), F.sum(text.word_count("text").cast("long")).alias("n_words"), F.count_distinct("source").alias("n_sources"))


@query("""select conv_id, count(*) as n_chunks, count(distinct role) as n_sections, cast(sum(length(text) - length(replace(text, ' ', '')) + 1) as bigint) as n_words, substring(min_by(text, turn), 1, 100) as preview from conversations group by conv_id""")
def document_summary(spark, sf):
    return Corpus(spark, sf).conversations.groupBy("conv_id").agg(F.count("*").alias("n_chunks"), F.count_distinct("role").alias("n_sections"), F.sum(text.word_count("text").cast("long")).alias("n_words"), F.substring(F.min_by("text", "turn"), 1, 100).alias("preview"))


@query(
    """with s as (select p_partkey, p_size * 20 as w, (p_partkey % 50 + 1) * 12 as h, p_partkey % 300 as c from part), m as (select *, greatest(w, h) as mx, greatest(w, h)::double / greatest(1, least(w, h)) as r, case when c <= 1 then 0.0 when c >= 256 then 1.0 else log2(c) / 8 end as d from s),
    k as (select *, case when mx < 64 or (c < 8 and mx < 200) then 'icon' when c < 48 and mx < 400 then 'logo' when r > 6 then 'decorative' when d > 0.7 and w * h > 40000 then 'photo' when c >= 48 and c < 256 then case when r < 2 then 'chart' else 'document' end when c >= 256 then 'photo' else 'unknown' end as category from m)
    select p_partkey, category, round(0.3 * (case when w * h < 2500 then 0.0 when w * h < 10000 then 0.2 when w * h < 40000 then 0.4 when w * h < 160000 then 0.7 else 1.0 end) + 0.2 * (case when r <= 2 then 1.0 when r <= 3.5 then 1 - 0.5 * (r - 2) / 1.5 else greatest(0.1, 0.5 - 0.1 * (r - 3.5)) end) + 0.3 * d + 0.2 * (case when category in ('photo', 'chart') then 1.0 when category = 'document' then 0.9 when category = 'unknown' then 0.5 when category = 'logo' then 0.2 else 0.1 end), 6) as relevance from k"""
)
def image_relevance(spark, sf):
    rows = Corpus(spark, sf).part.select("p_partkey", (F.col("p_size") * 20).alias("w"), ((F.col("p_partkey") % 50 + 1) * 12).alias("h"), (F.col("p_partkey") % 300).alias("c"))
    w, h, c = F.col("w"), F.col("h"), F.col("c")
    return rows.select("p_partkey", scalar.image_category(w, h, c, scalar.color_diversity(c)).alias("category"), F.round(scalar.image_relevance(w, h, c), 6).alias("relevance"))


@query("""select 'lang' as tag, lang as value, count(*) as uses from documents group by lang""")
def tag_values(spark, sf):
    return reports.counted_by(Corpus(spark, sf).documents, "lang").select(F.lit("lang").alias("tag"), F.col("lang").alias("value"), F.col("n").alias("uses"))


@query(None)
def corpus_fingerprint(spark, sf):
    """One hash of all documents, by ranges of a hash of the id."""
    return fingerprint(Corpus(spark, sf).documents.withColumn("h", F.sha2("text", 256)), "doc_id", "h")


@query("""select doc_id, regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g') as slug, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) as normalized from documents""")
def text_functions(spark, sf):
    return Corpus(spark, sf).documents.select("doc_id", text.slug("source").alias("slug"), text.normalize_search("text").alias("normalized"))


@query(
    r"""select page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) as plain, regexp_replace('**' || url || '** and *x*', '\*\*([^*]+)\*\*', '\1', 'g') as bold,
    regexp_replace(page_id || '  ' || url || chr(10) || page_id || ' y', '(?m)^\d+\s{2,}', '', 'g') as lines, page_id % 2 = 0 as valid from pages"""
)
def text_cleaning(spark, sf):
    key = F.col("page_id").cast("string")
    own = Corpus(spark, sf).pages.select("page_id", "html", F.concat(F.lit("**"), "url", F.lit("** and *x*")).alias("b"), F.concat(key, F.lit("  "), "url", F.lit("\n"), key, F.lit(" y")).alias("l"), F.concat(F.when(F.col("page_id") % 2 == 0, "sha256:").otherwise("sha1:"), F.sha2(key, 256)).alias("h"))
    return own.select("page_id", text.strip_html("html").alias("plain"), text.strip_bold("b").alias("bold"), text.strip_line_numbers("l").alias("lines"), text.valid_hash("h").alias("valid"))


@query("""select o_orderkey as document_id, count(*) as n, max(l_shipdate)::varchar is not null as has_date from orders join lineitem on o_orderkey = l_orderkey group by 1 order by n desc, 1 limit 20""")
def bottlenecks(spark, sf):
    c = Corpus(spark, sf)
    own = c.lineitem.groupBy(F.col("l_orderkey").alias("document_id")).agg(F.count("*").alias("n"), F.max("l_shipdate").isNotNull().alias("has_date"))
    return reports.top(own.join(c.orders.select(F.col("o_orderkey").alias("document_id")), "document_id", "left_semi"), [F.desc("n"), F.asc("document_id")], 20)




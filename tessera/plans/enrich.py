"""Queries: context joins, images, headings, saved searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import enrich, parse
from tessera.operators.corpus import Corpus
from tessera.plans.registry import query

IMG = """i as (select p_partkey as id, p_size * 20 as w, (p_partkey % 50 + 1) * 12 as h, p_partkey % 300 as c, p_partkey % 11 = 0 as hf, case when p_partkey % 7 = 0 then 'Figure' else 'Picture' end as bt, case when p_partkey % 5 <> 0 then p_brand || p_size end as ch from part),
  m as (select *, greatest(w, h) as mx, greatest(w, h)::double / greatest(1, least(w, h)) as r, case when c <= 1 then 0.0 when c >= 256 then 1.0 else log2(c) / 8 end as d, min(id) over (partition by ch) as f from i),
  k as (select *, case when mx < 64 or (c < 8 and mx < 200) then 'icon' when c < 48 and mx < 400 then 'logo' when r > 6 then 'decorative' when d > 0.7 and w * h > 40000 then 'photo' when c >= 48 and c < 256 then case when r < 2 then 'chart' else 'document' end when c >= 256 then 'photo' else 'unknown' end as cat from m),
  e as (select *, 0.3 * (case when w * h < 2500 then 0.0 when w * h < 10000 then 0.2 when w * h < 40000 then 0.4 when w * h < 160000 then 0.7 else 1.0 end) + 0.2 * (case when r <= 2 then 1.0 when r <= 3.5 then 1 - 0.5 * (r - 2) / 1.5 else greatest(0.1, 0.5 - 0.1 * (r - 3.5)) end) + 0.3 * d + 0.2 * (case when cat in ('photo', 'chart') then 1.0 when cat = 'document' then 0.9 when cat = 'unknown' then 0.5 when cat = 'logo' then 0.2 else 0.1 end) as rel from k)"""


def images(spark, sf):
    k = F.col("p_partkey")
    return Corpus(spark, sf).part.select(k.alias("id"), (F.col("p_size") * 20).alias("width"), ((k % 50 + 1) * 12).alias("height"), (k % 300).alias("colors"), (k % 11 == 0).alias("is_header_footer"), F.when(k % 7 == 0, "Figure").otherwise("Picture").alias("block_type"), F.when(k % 5 != 0, F.concat("p_brand", F.col("p_size").cast("string"))).alias("content_hash"))


@query(f"""with {IMG} select id, case when hf then 'header_footer' when bt = 'Figure' then 'figure' when ch is not null and id > f then 'duplicate' when mx < 50 then 'too_small' when mx < 100 then 'icon' when r > 6 then 'extreme_aspect' when mx < 50 or cat in ('icon', 'decorative') or (cat = 'logo' and rel < 0.4) or rel < 0.35 then 'low_relevance' else 'describe' end as decision from e""")
def image_decisions(spark, sf):
    return enrich.image_decisions(images(spark, sf)).select("id", "decision")


@query("""with i as (select p_partkey as id, p_brand || p_size as ch, case when p_partkey % 3 = 0 then 'text ' || p_partkey end as d from part), k as (select ch, min_by(d, id) as kd from i where d is not null group by ch) select id, coalesce(d, kd) as description from i left join k on i.ch = k.ch""")
def copied_descriptions(spark, sf):
    k = F.col("p_partkey")
    rows = Corpus(spark, sf).part.select(k.alias("id"), F.concat("p_brand", F.col("p_size").cast("string")).alias("content_hash"), F.when(k % 3 == 0, F.concat(F.lit("text "), k.cast("string"))).alias("description"))
    return enrich.copied_descriptions(rows).select("id", "description")


@query("""select vec_id, string_agg(distinct cast(label % 4 as varchar), ',') as clusters from embeddings group by vec_id""")
def cluster_context(spark, sf):
    e = Corpus(spark, sf).embeddings
    return enrich.with_clusters(e.select("vec_id"), e.select("vec_id", (F.col("label") % 4).alias("cluster")), "vec_id")


@query(
    """with c as (select o_orderkey % 20 as a, 20 + o_custkey % 20 as b, max(o_totalprice) as s from orders group by 1, 2), r as (select a as document, b as other, s from c union all select b, a, s from c), t as (select document, other, row_number() over (partition by document order by s desc, other) as n from r),
    l as (select document, string_agg(cast(other as varchar), ',' order by n) as related from t where n <= 3 group by document), h as (select range as turn, (range * 7) % 40 as document from range(120))
    select h.turn, h.document, case when row_number() over (partition by h.document order by turn) = 1 then related end as related from h left join l on h.document = l.document"""
)
def cross_document_context(spark, sf):
    c = Corpus(spark, sf).orders.groupBy((F.col("o_orderkey") % 20).alias("a"), (20 + F.col("o_custkey") % 20).alias("b")).agg(F.max("o_totalprice").alias("similarity"))
    hits = spark.range(120).select(F.col("id").alias("turn"), ((F.col("id") * 7) % 40).alias("document"))
    return enrich.cross_document(hits, c, "document", "turn")


@query(
    r"""with l as (select doc_id, source, unnest(string_split('Report of ' || source || chr(10) || text || chr(10) || '  REPORT of ' || source || ' x', chr(10))) as line from documents), n as (select source, count(distinct doc_id) as n from l group by source),
    k as (select l.source as of, lower(trim(line)) as rep from l join n on l.source = n.source where trim(line) <> '' group by l.source, lower(trim(line)), n having count(distinct doc_id) >= 2 and count(distinct doc_id) > 0.5 * n),
    t as (select distinct doc_id, source, line, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) as a from l), r as (select of, trim(regexp_replace(lower(rep), '\s+', ' ', 'g')) as b from k)
    select distinct doc_id, line from t join r on source = of where length(a) > 0 and (a = b or (length(a) <= 1.2 * length(b) and contains(b, a)) or (length(a) <= 1.5 * length(b) and contains(a, b)))"""
)
def repeated_chunk_match(spark, sf):
    """Lines of all documents, as pages with a header and a footer, against the repeated lines of their source."""
    docs = Corpus(spark, sf).documents
    page = F.concat(F.lit("Report of "), "source", F.lit("\n"), "text", F.lit("\n  REPORT of "), "source", F.lit(" x"))
    lines = docs.select("doc_id", "source", F.explode(F.split(page, "\n")).alias("line"))
    known = parse.repeated_lines(lines, "source", "doc_id", "line").select(F.col("source").alias("of"), F.col("line").alias("rep"))
    return lines.join(known, F.col("source").eqNullSafe(F.col("of")) & enrich.repeats_line("line", "rep"), "left_semi").select("doc_id", "line").distinct()


@query(
    """with h as (select event_id, user_id % 7 as doc, case event_id % 3 when 0 then 'Article ' || event_id when 1 then 'Section ' || event_id else 'Intro' end as heading, 1 + event_id % 4 as level from events), g as (select *, case event_id % 3 when 0 then 'A' when 1 then 'S' end as g from h),
    c as (select doc, g, level, count(*) as n from g where g is not null group by all), m as (select doc, g, first(level order by n desc, level) as mode, sum(n) as total from c group by doc, g) select event_id, case when total >= 3 then mode else level end as level from g left join m on g.doc = m.doc and g.g = m.g"""
)
def heading_levels(spark, sf):
    k = F.col("event_id")
    rows = Corpus(spark, sf).events.select("event_id", (F.col("user_id") % 7).alias("doc"), F.when(k % 3 == 0, F.concat(F.lit("Article "), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("**Section "), k.cast("string"), F.lit("**"))).otherwise("Intro").alias("heading"), (1 + k % 4).alias("level"))
    return enrich.levelled(rows, "doc", "heading", "level").select("event_id", "level")


@query("""select c_custkey as search_id, c_name, count(o_orderkey) as n_runs, strftime(max(o_orderdate), '%Y-%m-%d') as last_run from customer left join orders on c_custkey = o_custkey group by 1, 2""")
def saved_searches(spark, sf):
    c = Corpus(spark, sf)
    saved = c.customer.select(F.col("c_custkey").alias("search_id"), "c_name")
    runs = c.orders.select(F.col("o_custkey").alias("search_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ran_at"))
    return enrich.replayed(saved, runs)


@query("""select event_id, 'k' as section, 1::bigint as n from events where json_extract_string(props, '$.k') is not null""")
def extras_sections(spark, sf):
    return enrich.extras(Corpus(spark, sf).events, "event_id", "props")


@query("""select event_id, columns as table_columns, n as table_rows from (select event_id, 'a | b' as columns, event_id % 9 as n from events where event_id % 2 = 0) union all select event_id, null, null from events where event_id % 2 <> 0""")
def table_metadata(spark, sf):
    e = Corpus(spark, sf).events.select("event_id")
    records = e.where("event_id % 2 = 0").withColumn("params", F.to_json(F.struct(F.array(F.lit("a"), F.lit("b")).alias("columnHeaders"), (F.col("event_id") % 9).alias("rowCount"))))
    return enrich.table_metadata(e, records, "event_id", "params")


@query("""select p_partkey as id, case when p_partkey % 2 = 0 then case when p_partkey % 3 = 0 then 'Figure' else 'Picture' end end as block_type from part""")
def block_type_names(spark, sf):
    k = F.col("p_partkey")
    name = F.when(k % 2 == 0, F.concat(F.lit("x_page_0_"), F.when(k % 3 == 0, "Figure").otherwise("Picture"), F.lit("_"), k.cast("string"), F.lit(".jpeg"))).otherwise("plain.png")
    return Corpus(spark, sf).part.select(k.alias("id"), enrich.block_type_of(name).alias("block_type"))


@query(None)
def page_contexts(spark, sf):
    """Text around the middle page of each document."""
    return Corpus(spark, sf).documents.select("doc_id", enrich.page_context("text", F.lit(2), F.lit(3)).alias("context"))

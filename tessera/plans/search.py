"""Queries: ranked text search, fusion and context."""

from __future__ import annotations

import hashlib

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.text import parse_query, query_terms, snippet
from tessera.operators import engine, fusion, search
from tessera.operators.corpus import Corpus
from tessera.operators.index import Index
from tessera.operators.iterate import cut
from tessera.operators.manifest import source_state
from tessera.plans.registry import query

TOK = r"list_transform(regexp_extract_all(lower(coalesce({t},'')), '[\p{{L}}\p{{N}}]+'), lambda x: strip_accents(x))"
QUALITY = "0.8 + 0.04 * greatest(0.0, least(5.0, q.quality))"


def bm25_sql(terms: list[str], where: str, table: str = "documents", key: str = "doc_id", text: str = "text", name: str = "r") -> str:
    """CTEs ending in `name`(key, score)."""
    tfs = ", ".join(f"len(list_filter(tk, lambda x: x in ({forms(w)}))) as tf{i}" for i, w in enumerate(terms))
    dfs = ", ".join(f"count(*) filter (tf{i} > 0) as df{i}" for i in range(len(terms)))
    idf = lambda i: f"(case when ln((n - df{i} + 0.5) / (df{i} + 0.5)) <= 0 then 1e-6 else ln((n - df{i} + 0.5) / (df{i} + 0.5)) end)"
    score = " + ".join(f"{idf(i)} * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * dl / mean))" for i in range(len(terms)))
    return f"""{name}_t as (select {key}, {TOK.format(t=text)} as tk from {table}),
      {name}_c as (select {key}, tk, len(tk) as dl, {tfs} from {name}_t),
      {name}_s as (select count(*) as n, avg(dl) as mean, {dfs} from {name}_c),
      {name} as (select {key}, 0.0::double + {score} as score from {name}_c, {name}_s where {where})"""


# Words of the tables that have the stem of a query's word (found by stemming all of them), without accents.
FORMS = {"the": "thes", "of": "ofed ofes", "un": "une", "de": "des", "la": "las", "en": "ened enes ening ene", "and": "andes anding", "changed": "chang change changes changing"}


def forms(word: str) -> str:
    return ", ".join(f"'{w}'" for w in [word, *FORMS.get(word, "").split()])


def has(*words: str, any_of: bool = False) -> str:
    return "(" + (" or " if any_of else " and ").join(f"list_has_any(tk, [{forms(w)}])" for w in words) + ")"


def shared_folder(spark) -> str:
    """A folder that all executors share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        cut(spark.range(1))  # sets it
    return context.getCheckpointDir()


def shared_index(spark, sf) -> Index:
    """The index of the documents of a folder, built beside the checkpoints when a session first needs it, and again when the table has changed; searches read it."""
    table = f"{sf}/documents.parquet"
    own, now = Index(spark, f"{shared_folder(spark)}/index-{hashlib.sha256(sf.encode()).hexdigest()[:16]}"), source_state(spark, table)
    if not own.exists() or own.state["source"] != now:
        Index.build(Corpus(spark, sf).documents, "doc_id", "text", own.path, now)
    return Index(spark, own.path)


def quality(spark, sf):
    return Corpus(spark, sf).labels.groupBy("doc_id").agg((F.max("quality") * 5.0).alias("quality"))


QUALITY_CTE = "q as (select doc_id, max(quality) * 5.0 as quality from labels group by doc_id)"


@query(
    f"""with {bm25_sql(["the", "and", "with"], has("the", "and", "with", any_of=True))}, {QUALITY_CTE},
    w as (select r.doc_id, score * (case when q.quality is null then 0.9 else {QUALITY} end) as score from r left join q on r.doc_id = q.doc_id)
    select doc_id, round(score, 6) as score, row_number() over (order by score desc, doc_id) as rank from w order by score desc, doc_id limit 20"""
)
def bm25_search(spark, sf):
    return shared_index(spark, sf).search("the OR and OR with", 20, quality=quality(spark, sf)).withColumn("score", F.round("score", 6))


@query(
    f"""with {bm25_sql(["and", "the", "un"], "(" + has("the", "and") + " and not " + has("of") + ") or " + has("un"))}
    select doc_id, round(score, 6) as score, row_number() over (order by score desc, doc_id) as rank from r order by score desc, doc_id limit 25"""
)
def bm25_boolean(spark, sf):
    return shared_index(spark, sf).search("the AND and AND NOT of OR un", 25).withColumn("score", F.round("score", 6))


@query(
    f"""with {bm25_sql(["de", "la"], "regexp_matches(' ' || array_to_string(tk, ' ') || ' ', ' (de|des) (la|las) ')")}
    select doc_id, round(score, 6) as score, row_number() over (order by score desc, doc_id) as rank from r order by score desc, doc_id limit 15"""
)
def bm25_phrase(spark, sf):
    return shared_index(spark, sf).search("de la", 15, phrase=True).withColumn("score", F.round("score", 6))


@query(
    f"""with f as (select * from documents where contains(lower(source), 'src1') and doc_id in (select doc_id from labels where quality * 5.0 >= 3.0)),
    {bm25_sql(["der", "die"], has("der", "die", any_of=True), table="f")}
    select doc_id, round(score, 6) as score from r order by score desc, doc_id limit 30"""
)
def bm25_filtered(spark, sf):
    docs = search.metadata_filter(Corpus(spark, sf).documents, source="SRC1")
    docs = search.quality_filter(docs, "doc_id", quality(spark, sf), 3.0)
    return search.bm25_texts(docs, "doc_id", "text", "der OR die").orderBy(F.desc("score"), "doc_id").limit(30).withColumn("score", F.round("score", 6))


@query(
    f"""with d as (select doc_id, source || ' ' || lang as meta from documents), {bm25_sql(["en", "src3"], has("src3", "en"), table="d", text="meta")}
    select doc_id, round(score, 6) as score from r"""
)
def metadata_search(spark, sf):
    docs = Corpus(spark, sf).documents.withColumn("meta", F.concat_ws(" ", "source", "lang"))
    return search.bm25_texts(docs, "doc_id", "meta", "src3 en").withColumn("score", F.round("score", 6))


@query(r"""select term, count(*) as df, cast(sum(tf) as bigint) as cf from (select doc_id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(coalesce(text,'')), '[\p{L}\p{N}]+')) as term from documents) group by all) group by term""")
def term_statistics(spark, sf):
    p = search.postings(search.analyzed(Corpus(spark, sf).documents, "doc_id", "text", stem=False), "doc_id")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(r"""select count(*) as tokens, count(distinct doc_id) as documents from (select doc_id, unnest(regexp_extract_all(lower(coalesce(text,'')), '[\p{L}\p{N}]+')) as term from documents)""")
def index_build(spark, sf):
    """A new index, by how many tokens and documents its postings have."""
    path = f"{shared_folder(spark)}/index-build-{hashlib.sha256(sf.encode()).hexdigest()[:16]}"
    return Index.build(Corpus(spark, sf).documents, "doc_id", "text", path).postings().agg(F.sum("tf").alias("tokens"), F.count_distinct("key").alias("documents"))


@query("""select count(*) as n_rows, count(distinct (doc_id, text)) as n_indexed, false as stale from documents""")
def fts_status(spark, sf):
    """What the index of the whole table says of itself, held against the table."""
    own = shared_index(spark, sf)
    return own.status(Corpus(spark, sf).documents, source_state(spark, f"{sf}/documents.parquet")).select("n_rows", "n_indexed", "stale")


CHANGED = "select doc_id, case when source = 'src1' then coalesce(text, '') || ' the changed text of ' || source else text end as text from documents where lang is distinct from 'fr'"


@query(
    f"""with f as ({CHANGED}), {bm25_sql(["changed", "of", "the"], has("the", "changed", "of", any_of=True), table="f")}
    select doc_id, round(score, 6) as score, row_number() over (order by score desc, doc_id) as rank from r order by rank limit 40"""
)
def changed_index_search(spark, sf):
    """An index of all documents, kept up to date: one batch deletes a language, the next one rewrites a source; the search reads three segments."""
    docs, path = Corpus(spark, sf).documents, f"{shared_folder(spark)}/index-changed-{hashlib.sha256(sf.encode()).hexdigest()[:16]}"
    own = Index.build(docs, "doc_id", "text", path)
    own.apply(docs.where("lang = 'fr'").select("doc_id", "text", F.lit("delete").alias("op")), batch=("changes", 0))
    new = F.concat(F.coalesce("text", F.lit("")), F.lit(" the changed text of "), F.col("source"))
    own.apply(docs.where("source = 'src1' and not (lang <=> 'fr')").select("doc_id", new.alias("text"), F.lit("upsert").alias("op")), batch=("changes", 1))
    return own.search("the OR changed OR of", 40).withColumn("score", F.round("score", 6))


@query(
    """with q as (select item_id, text as s, len(string_split_regex(text, '\\s+')) as n from benchmark),
    p as (select item_id,
      (case when regexp_matches(s, '^["''].*["'']$') then 2 else 0 end) + (case when regexp_matches(s, '\\b[A-Z]{2,}-\\d+\\b') then 2 else 0 end) + (case when regexp_matches(s, '\\b\\d{4}-\\d{2}-\\d{2}\\b') then 2 else 0 end)
        + (case when regexp_matches(s, '\\b[A-Z][a-z]+ [A-Z][a-z]+\\b') then 2 else 0 end) + (case when regexp_matches(s, '\\b\\d{3,}\\b') then 2 else 0 end) + (case when regexp_matches(s, '[@#$%]\\w+') then 2 else 0 end) + (case when n <= 2 then 1 else 0 end) as e,
      (case when regexp_matches(s, '(?i)\\b(about|regarding|related to|similar to|like|concerning)\\b') then 2 else 0 end) + (case when regexp_matches(s, '(?i)\\b(what|how|why|when|where|who)\\b') then 2 else 0 end)
        + (case when regexp_matches(s, '(?i)\\b(documents?|files?|papers?|records?) (about|on|regarding)\\b') then 2 else 0 end) + (case when n >= 6 then 1 else 0 end) as m,
      regexp_matches(s, '(?i)\\b(table|tables|tabular)\\b') or regexp_matches(s, '(?i)\\b(column|columns|row|rows|cell|cells)\\b') or regexp_matches(s, '(?i)\\b(spreadsheet|grid|matrix)\\b') or regexp_matches(s, '(?i)\\b(header|headers)\\s+(of|in|from)\\b') as t from q)
    select item_id, case when e + m = 0 then 'mixed' when e / (e + m) > 0.7 then 'exact' when e / (e + m) < 0.3 then 'semantic' else 'mixed' end as kind, t as table_query from p"""
)
def query_classes(spark, sf):
    return Corpus(spark, sf).benchmark.select("item_id", search.classify_query("text").alias("kind"), search.is_table_query("text").alias("table_query"))


@query(
    f"""with {bm25_sql(["of", "the"], has("the", "of", any_of=True), table="(select * from documents where lang = 'en')", name="a")}, {bm25_sql(["of", "the"], has("the", "of", any_of=True), table="(select * from documents where lang <> 'en')", name="b")},
    u as (select * from (select 'first' as database_name, doc_id, score from a order by score desc, doc_id limit 10) union all select * from (select 'second', doc_id, score from b order by score desc, doc_id limit 10)),
    n as (select *, min(score) over (partition by database_name) as lo, max(score) over (partition by database_name) as hi from u)
    select database_name, doc_id, round(case when hi = lo then 1.0 else (score - lo) / (hi - lo) end, 6) as normalized_score from n order by case when hi = lo then 1.0 else (score - lo) / (hi - lo) end desc, database_name, doc_id limit 15"""
)
def cross_corpus_search(spark, sf):
    docs = Corpus(spark, sf).documents
    best = lambda d: search.bm25_texts(d, "doc_id", "text", "the OR of").orderBy(F.desc("score"), "doc_id").limit(10)
    return search.across({"first": best(docs.where("lang = 'en'")), "second": best(docs.where("lang <> 'en'"))}, "score", 15).select("database_name", "doc_id", F.round("normalized_score", 6).alias("normalized_score"))


@query(
    """with a as (select doc_id from documents where lang = 'en'), b as (select doc_id from documents where source = 'src0'), u as (select doc_id, 'en' as n from a union all select doc_id, 'src0' from b)
    select doc_id, string_agg(distinct n, ',' order by n) as databases, count(distinct n) as n from u group by doc_id having count(distinct n) > 1"""
)
def corpus_overlap(spark, sf):
    docs = Corpus(spark, sf).documents
    return search.overlap({"en": docs.where("lang = 'en'"), "src0": docs.where("source = 'src0'")}, "doc_id")


def two_lists(spark, sf):
    docs = Corpus(spark, sf).documents
    a = shared_index(spark, sf).search("the OR of", 40)
    b = docs.select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return a, search.ranked(b, "doc_id", "score", 40)


TWO = f"""{bm25_sql(["of", "the"], has("the", "of", any_of=True))}, a as (select doc_id, row_number() over (order by score desc, doc_id) as text_rank from r qualify text_rank <= 40), b as (select doc_id, row_number() over (order by n_chars desc, doc_id) as vector_rank from documents qualify vector_rank <= 40)"""


@query(f"""with {TWO} select coalesce(a.doc_id, b.doc_id) as doc_id, text_rank, vector_rank, round(coalesce(1.5 / (60 + text_rank), 0) + coalesce(0.5 / (60 + vector_rank), 0), 8) as rrf_score from a full join b on a.doc_id = b.doc_id""")
def rrf_hybrid(spark, sf):
    return fusion.rrf(*two_lists(spark, sf), "doc_id", 60, 1.5, 0.5).withColumn("rrf_score", F.round("rrf_score", 8))


@query(
    """select conv_id, turn, round(greatest(0.5::double, least(2.0::double, (1::double + 0.1 * (4 - least(greatest(turn + 1, 1), 4))) * (case when role = 'user' then 1.1 else 1.0 end) * (case when role = 'user' then 1.2 else 1.0 end) * (0.8 + 0.4 * 0.7)
      * (case when length(trim(text)) > 0 and length(trim(text)) < 80 and (regexp_matches(trim(text), '(?i)^page\\s+\\d+(\\s+of\\s+\\d+)?$') or regexp_matches(trim(text), '^\\d+$') or contains(lower(trim(text)), 'confidential') or contains(lower(trim(text)), 'all rights reserved')) then 0.5 else 1.0 end))), 6) as boost from conversations"""
)
def metadata_boosts(spark, sf):
    rows = Corpus(spark, sf).conversations.withColumn("heading_level", (F.col("turn") + 1).cast("int")).withColumn("is_atomic", F.col("role") == "user").withColumn("content_types", F.when(F.col("role") == "user", F.array(F.lit("table"))).otherwise(F.array(F.lit("text"))))
    return rows.select("conv_id", "turn", F.round(fusion.boost("rows of a table"), 6).alias("boost"))


CHUNK_HITS = "h as (select conv_id, turn, length(text)::double as score from conversations where role = 'user')"


def chunk_hits(spark, sf):
    return Corpus(spark, sf).conversations.where("role = 'user'").select("conv_id", "turn", F.length("text").cast("double").alias("score"))


@query(
    f"""with {CHUNK_HITS}, n as (select conv_id, count(*) as n from conversations where conv_id in (select conv_id from h) group by conv_id), m as (select list_sort(list(n))[len(list(n)) // 2 + 1] as median from n)
    select h.conv_id, turn, round(score * greatest(0.7, least(1.0, sqrt(median / greatest(n, 1)))), 6) as score from h join n on h.conv_id = n.conv_id, m"""
)
def length_normalization(spark, sf):
    return fusion.length_normalized(chunk_hits(spark, sf), Corpus(spark, sf).conversations, "conv_id", "score").select("conv_id", "turn", F.round("score", 6).alias("score"))


@query(f"""with {CHUNK_HITS} select conv_id, turn, round(score * (1 + 0.1 * (select count(*) from h o where o.conv_id = h.conv_id and abs(o.turn - h.turn) <= 2 and o.turn <> h.turn)), 6) as score from h""")
def proximity_boost(spark, sf):
    return fusion.proximity(chunk_hits(spark, sf), "conv_id", "turn", "score").select("conv_id", "turn", F.round("score", 6).alias("score"))


@query("""select min(doc_id) as doc_id, sha256(text) as content_hash from documents group by text""")
def dedup_by_hash(spark, sf):
    docs = Corpus(spark, sf).documents.select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return fusion.first_by_hash(docs, "content_hash", "doc_id")


@query("""select doc_id, source from (select doc_id, source, row_number() over (partition by source order by n_chars desc, doc_id) as n from documents) where n <= 3""")
def source_diversity(spark, sf):
    docs = Corpus(spark, sf).documents.select("doc_id", "source", F.struct(F.negative("n_chars"), "doc_id").alias("rank"))
    return fusion.diverse(docs, "source", "rank", 3).select("doc_id", "source")


@query("""select source, count(*) as result_count, string_agg(cast(doc_id as varchar), ',' order by doc_id) as keys from documents where lang = 'fr' group by source""")
def group_by_document(spark, sf):
    return fusion.grouped(Corpus(spark, sf).documents.where("lang = 'fr'").withColumn("rank", F.col("doc_id")), "source", "doc_id", "rank")


HITS = "k as (select conv_id, turn from conversations where contains(lower(text), 'the'))"


@query(f"""with {HITS} select distinct c.conv_id, c.turn, c.role, substring(c.text, 1, 500) as text from conversations c join k on c.conv_id = k.conv_id and abs(c.turn - k.turn) <= 1 where (c.conv_id, c.turn) not in (select (conv_id, turn) from k)""")
def context_neighbours(spark, sf):
    chunks = Corpus(spark, sf).conversations
    hits = chunks.where("contains(lower(text), 'the')").select("conv_id", "turn")
    return fusion.neighbours(hits, chunks, "conv_id", "turn", 1).select("conv_id", "turn", "role", "text").distinct()


@query(f"""with {TWO}, t as (select a.text_rank as rank, a.doc_id, d.text from a join documents d on a.doc_id = d.doc_id where text_rank <= 5) select substring(string_agg('### Source ' || rank || ' (document ' || doc_id || ')' || chr(10) || text, chr(10) || chr(10) order by rank), 1, 4000) as context, count(*) as n_sources from t""")
def rag_context(spark, sf):
    docs = Corpus(spark, sf).documents
    hits = shared_index(spark, sf).search("the OR of", 5).join(docs.select("doc_id", "text"), "doc_id")
    return fusion.context(hits, "rank", "doc_id", "text", 4000)


@query(None)
def overlap_suppression(spark, sf):
    """Greedy by rank within a document, so beyond SQL; tested against plain code."""
    hits = Corpus(spark, sf).conversations.select("conv_id", "turn", (F.col("turn") * 100).alias("start"), (F.col("turn") * 100 + F.length("text")).alias("end"), F.length("text").alias("rank"))
    return fusion.without_overlaps(hits.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy("rank", "turn"))), "conv_id", "start", "end", "rank").select("conv_id", "turn")


@query(
    f"""with {bm25_sql(["the", "was", "this"], has("the", "was", "this", any_of=True))}
    select doc_id, round(score, 6) as score, row_number() over (order by score desc, doc_id) as rank from r order by score desc, doc_id limit 20"""
)
def stemmed_search(spark, sf):
    """The same search without an index: texts are tokenised, folded and stemmed where they lie."""
    return search.search(Corpus(spark, sf).documents, "doc_id", "text", "Thes OR was OR THIS", 20).withColumn("score", F.round("score", 6))


COSINE = "list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0))"


@query(
    f"""with {bm25_sql(["of", "the"], has("the", "of", any_of=True))}, a as (select doc_id, row_number() over (order by score desc, 'chunk:' || doc_id) as n from (select * from r order by score desc, doc_id limit 20)),
    b as (select vec_id as doc_id, row_number() over (order by {COSINE} desc, 'chunk:' || vec_id) as n from embeddings qualify n <= 20),
    f as (select doc_id, sum(p) as s from (select doc_id, 1.0 / (60 + n) as p from a union all select doc_id, 1.0 / (60 + n) from b) group by doc_id),
    {QUALITY_CTE}, w as (select f.doc_id, d.text, d.source, s * (case when q.quality is null then 0.9 else {QUALITY} end) as score from f join documents d on f.doc_id = d.doc_id left join q on f.doc_id = q.doc_id),
    u as (select *, row_number() over (partition by text order by score desc, 'chunk:' || doc_id) as c from w), v as (select *, row_number() over (partition by source order by score desc, 'chunk:' || doc_id) as k from u where c = 1)
    select doc_id as item, round(score, 8) as rrf_score, row_number() over (order by score desc, 'chunk:' || doc_id) as rank from v where k <= 3 order by score desc, 'chunk:' || doc_id limit 10"""
)
def unified_search(spark, sf):
    """Text and vectors fused by typed keys, weighted by quality, without copies, three to a source."""
    best = two_branches(spark, sf).search("the OR of", first_embedding(spark, sf), 10, weights=(1.0, 1.0))
    return engine.compact(best, "hybrid").select("item", F.round("rrf_score", 8).alias("rrf_score"), "rank")


def two_branches(spark, sf) -> engine.Engine:
    c = Corpus(spark, sf)
    chunks = c.documents.select(F.col("doc_id").alias("item"), F.col("source").alias("document"), "text")
    vectors = c.embeddings.select(F.lit("chunk").alias("kind"), F.col("vec_id").alias("item"), "embedding")
    return engine.Engine({"chunk": engine.Kind(shared_index(spark, sf), chunks)}, vectors, quality(spark, sf).withColumnRenamed("doc_id", "item"))


def first_embedding(spark, sf):
    return F.array(*map(F.lit, Corpus(spark, sf).embeddings.where("vec_id = 0").first().embedding))


def one_branch(ranks: str) -> str:
    return f"""f as (select doc_id, 1.0 / (60 + n) as s from ({ranks})),
    {QUALITY_CTE}, w as (select f.doc_id, d.text, d.source, s * (case when q.quality is null then 0.9 else {QUALITY} end) as score from f join documents d on f.doc_id = d.doc_id left join q on f.doc_id = q.doc_id),
    u as (select *, row_number() over (partition by text order by score desc, 'chunk:' || doc_id) as c from w), v as (select *, row_number() over (partition by source order by score desc, 'chunk:' || doc_id) as k from u where c = 1)
    select doc_id as item, round(score, 8) as score, row_number() over (order by score desc, 'chunk:' || doc_id) as rank from v where k <= 3 order by score desc, 'chunk:' || doc_id limit 10"""


@query(f"""with {bm25_sql(["of", "the"], has("the", "of", any_of=True))}, {one_branch("select doc_id, row_number() over (order by score desc, 'chunk:' || doc_id) as n from (select * from r order by score desc, doc_id limit 20)")}""")
def keyword_search(spark, sf):
    """The engine's text branch alone, with all that follows it."""
    return two_branches(spark, sf).search("the OR of", None, 10, "keyword", weights=(1.0, 1.0)).select("item", F.round("score", 8).alias("score"), "rank")


@query(f"""with {one_branch(f"select vec_id as doc_id, row_number() over (order by {COSINE} desc, 'chunk:' || vec_id) as n from embeddings qualify n <= 20")}""")
def semantic_search(spark, sf):
    """The engine's vector branch alone, with all that follows it."""
    return two_branches(spark, sf).search("the OR of", first_embedding(spark, sf), 10, "semantic", weights=(1.0, 1.0)).select("item", F.round("score", 8).alias("score"), "rank")


#: Characters of a chunk, and from one chunk to the next: neighbours overlap by more than half.
CHUNK, STEP = 1200, 500


def overlapping_chunks(spark, sf):
    """item, document, start, end, text: every document in overlapping chunks."""
    docs = Corpus(spark, sf).documents
    each = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.char_length("text") - 1), F.lit(STEP))).alias("start"))
    text = F.substring("text", F.col("start") + 1, F.lit(CHUNK))
    return each.select((F.col("doc_id") * 1_000_000 + F.floor(F.col("start") / STEP)).alias("item"), F.col("doc_id").alias("document"), "start", (F.col("start") + F.char_length(text)).alias("end"), text.alias("text"))


@query(None)
def rag_hybrid(spark, sf):
    """Context for a question from overlapping chunks: both branches, three times the limit, overlaps, diversity, a budget of tokens; held against plain code in the tests."""
    c, chunks = Corpus(spark, sf), overlapping_chunks(spark, sf)
    own, now = Index(spark, f"{shared_folder(spark)}/index-{hashlib.sha256(f'chunks {sf}'.encode()).hexdigest()[:16]}", "item"), source_state(spark, f"{sf}/documents.parquet")
    if not own.exists() or own.state["source"] != now:
        Index.build(chunks, "item", "text", own.path, now)
    vectors = c.embeddings.select(F.lit("chunk").alias("kind"), (F.col("vec_id") * 1_000_000).alias("item"), "embedding")
    found = engine.Engine({"chunk": engine.Kind(Index(spark, own.path, "item"), chunks)}, vectors).rag("the OR of OR with", first_embedding(spark, sf), 8, 2, 900)
    return found.select("rank", "item", "document", "tokens", F.round("score", 8).alias("score"))


@query(None)
def engine_search(spark, sf):
    """The same in one call, over two kinds of items with expansion and header lines; tested against plain code."""
    return engine.compact(two_kinds(spark, sf).search("the of", limit=15, per_document=5), "hybrid").drop("text")


def two_kinds(spark, sf):
    c = Corpus(spark, sf)
    shared = shared_index(spark, sf)
    path = f"{shared_folder(spark)}/index-{hashlib.sha256(f'images {sf}'.encode()).hexdigest()[:16]}"
    pictures = Index.build(c.benchmark, "item_id", "text", path)
    chunks = c.documents.select(F.col("doc_id").alias("item"), F.col("source").alias("document"), "text")
    images = c.benchmark.select(F.col("item_id").alias("item"), F.lit("benchmark").alias("document"), "text")
    return engine.Engine({"chunk": engine.Kind(shared, chunks), "image": engine.Kind(pictures, images)}, synonyms={"of": ["with"]})


@query(None)
def snippets(spark, sf):
    """Marked windows around hits."""
    docs = Corpus(spark, sf).documents
    hits = search.search(docs, "doc_id", "text", "of the", 10)
    return hits.join(docs, "doc_id").select("doc_id", "rank", snippet(query_terms(parse_query("of the")))("text").alias("snippet"))


@query(
    """select conv_id, turn from conversations where (role = 'user' or role = 'assistant') and turn between 1 and 4 and starts_with(role || ' > ' || turn, 'user') and contains(lower(text), 'the')"""
)
def chunk_filters(spark, sf):
    rows = Corpus(spark, sf).conversations.select("conv_id", "turn", F.array("role").alias("content_types"), F.concat_ws(" > ", "role", "turn").alias("section_path"), F.col("text").alias("heading"), F.col("turn").alias("page_number"))
    return rows.where(search.ChunkFilter(content_types=("user", "assistant"), section="user", heading="The", pages=(1, 4)).column()).select("conv_id", "turn")

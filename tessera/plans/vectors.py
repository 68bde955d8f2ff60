"""Queries: vector search, centroids, comparison and clustering of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.scalar import cosine
from tessera.operators import compare, pairs, vectors
from tessera.operators.corpus import Corpus
from tessera.plans.registry import query

V = "v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings)"
Q = "q as (select e as q from v where vec_id = (select min(vec_id) from v))"
COS = "list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q)))"
CENTRE = f"""{V}, p as (select label, unnest(e) as x, generate_subscripts(e, 1) as i from v), m as (select label, i, avg(x) as a, count(*) as n from p group by label, i),
  l as (select label, max(n) as n, list(a order by i) as a from m group by label), c as (select label, n, list_transform(a, lambda x: x / sqrt(list_dot_product(a, a))) as centroid from l)"""
CLAMP = "greatest(0.0, least(1.0, list_dot_product(x.centroid, y.centroid)))"


def embeddings(spark, sf):
    return Corpus(spark, sf).embeddings


def first_vector(spark, sf):
    e = embeddings(spark, sf)
    return e.agg(F.min_by("embedding", "vec_id")).toDF("q").scalar()


def centre(spark, sf):
    return vectors.centroids(embeddings(spark, sf), "label", "embedding")


@query(f"""with {V}, {Q} select vec_id, round({COS}, 6) as similarity from v, q order by {COS} desc, vec_id limit 10""")
def cosine_topk(spark, sf):
    return vectors.top(embeddings(spark, sf), "vec_id", "embedding", first_vector(spark, sf), 10).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(
    f"""with {V}, {Q}, n as (select vec_id, {COS} as s from v, q where label in (1, 3, 5) order by 1 - s, vec_id limit 60), w as (select vec_id, s, s * (case when vec_id % 3 = 0 then 0.9 else 0.8 + 0.04 * (vec_id % 6) end) as score from n where 1 - s <= 0.9)
    select vec_id, round(s, 6) as similarity, round(score, 6) as score from w order by score desc, vec_id limit 20"""
)
def cosine_topk_filtered(spark, sf):
    rows = embeddings(spark, sf).where("label in (1, 3, 5)").withColumn("quality", F.when(F.col("vec_id") % 3 != 0, (F.col("vec_id") % 6).cast("double")))
    return vectors.top(rows, "vec_id", "embedding", first_vector(spark, sf), 20, 0.1, "quality").select("vec_id", F.round("similarity", 6).alias("similarity"), F.round("score", 6).alias("score"))


@query(
    f"""with {V}, {Q}, s as (select vec_id, {COS} as s from v, q order by s desc, vec_id limit 30), t as (select greatest(0.15, least(0.5, avg(s) - stddev_pop(s))) as t from s) select vec_id, round(s, 6) as similarity, round(t, 6) as threshold from s, t where s >= t"""
)
def adaptive_threshold(spark, sf):
    near = embeddings(spark, sf).withColumn("_q", first_vector(spark, sf)).withColumn("similarity", cosine(F.col("embedding"), F.col("_q"))).orderBy(F.desc("similarity"), "vec_id").limit(30)
    return vectors.adaptive(near, "similarity").select("vec_id", F.round("similarity", 6).alias("similarity"), F.round("threshold", 6).alias("threshold"))


@query(f"""with {CENTRE} select label, n, i::bigint as i, round(x, 6) as x from (select label, n, unnest(centroid) as x, generate_subscripts(centroid, 1) - 1 as i from c)""")
def centroids(spark, sf):
    return centre(spark, sf).select("label", "n", F.posexplode("centroid").alias("i", "x")).select("label", "n", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query(
    f"""with {CENTRE}, o as (select centroid as q from c where label = 0), s as (select vec_id, label, {COS} as s from v, o where label <> 0 order by s desc, vec_id limit 50) select label, round(avg(s), 6) as avg_similarity, count(*) as n from s group by label having avg(s) >= 0.05 order by avg(s) desc, label limit 5"""
)
def find_similar(spark, sf):
    e = embeddings(spark, sf)
    return vectors.similar_groups(e, "label", "embedding", centre(spark, sf), 0, 5, 0.05).select("label", F.round("avg_similarity", 6).alias("avg_similarity"), "n")


@query(f"""with {CENTRE} select x.label as a, y.label as b, round({CLAMP}, 4) as similarity from c x join c y on x.label < y.label where {CLAMP} >= 0.01 and not (x.label = 0 and y.label = 1)""")
def similar_pairs(spark, sf):
    known = spark.createDataFrame([(1, 0)], "a int, b int")
    return vectors.pairs(centre(spark, sf), "label", "centroid", 0.01, known).withColumn("similarity", F.round("similarity", 4))


UNIT = f"{V}, u as (select vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as u from v), s as (select x.vec_id as a, y.vec_id as b, list_dot_product(x.u, y.u) as s from u x join u y on x.vec_id < y.vec_id)"


@query(f"""with {UNIT} select a, b, round(least(1.0, s), 4) as similarity from s where s >= 0.3""")
def vector_pairs(spark, sf):
    """Every pair of vectors of the table that are alike."""
    return pairs.similar(embeddings(spark, sf), "vec_id", "embedding", 0.3).withColumn("similarity", F.round("similarity", 4))


@query(
    f"""with {UNIT}, m as (select a, b, s from s order by s desc, a, b limit 1), l as (select a, b, s from s order by s, a, b limit 1)
    select (select count(*) from v) as n, (select count(*) from s) as pairs, (select round(avg(s), 6) from s) as mean, m.a as most_a, m.b as most_b, round(m.s, 6) as most, l.a as least_a, l.b as least_b, round(l.s, 6) as least from m, l"""
)
def matrix_summary(spark, sf):
    """The most and the least similar pair of all vectors, and the mean of all pairs, without their matrix."""
    return pairs.extremes(embeddings(spark, sf), "vec_id", "embedding").withColumns({c: F.round(c, 6) for c in ("mean", "most", "least")})


@query(f"""with {CENTRE} select x.label as a, y.label as b, round({CLAMP}, 4) as similarity from c x, c y""")
def similarity_matrix(spark, sf):
    return vectors.matrix(centre(spark, sf), "label", "centroid").withColumn("similarity", F.round("similarity", 4))


@query(f"""with {CENTRE}, s as (select vec_id, c.label, greatest(0.0, least(1.0, list_dot_product(e, centroid))) as s from v, c) select vec_id, label as cluster, round(s, 6) as similarity from s qualify row_number() over (partition by vec_id order by s desc, label) = 1""")
def cluster_assign(spark, sf):
    return vectors.assign(embeddings(spark, sf), "vec_id", "embedding", centre(spark, sf), "label").withColumn("similarity", F.round("similarity", 6))


@query(f"""with {V}, u as (select label, vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as u from v), p as (select x.label, avg(list_dot_product(x.u, y.u)) as a from u x join u y on x.label = y.label and x.vec_id < y.vec_id group by x.label), n as (select label, count(*) as n from v group by label) select n.label, n.n, round(coalesce(a, 1.0), 6) as coherence from n left join p on n.label = p.label""")
def coherence(spark, sf):
    return vectors.coherence(embeddings(spark, sf), "label", "embedding").withColumn("coherence", F.round("coherence", 6))


@query(
    f"""with {V}, d as (select x.vec_id, x.label, y.label as other, avg(1 - list_dot_product(x.e, y.e)) filter (x.vec_id <> y.vec_id) as d from v x, v y group by all), s as (select vec_id, max(d) filter (label = other) as i, min(d) filter (label <> other) as o from d group by vec_id) select round(avg(case when i is null then 0.0 else (o - i) / greatest(o, i) end), 6) as silhouette from s"""
)
def silhouette(spark, sf):
    return vectors.silhouette(embeddings(spark, sf), "label", "embedding").select(F.round("silhouette", 6).alias("silhouette"))


@query("""select sha256(text) as content_hash, count(*) as n, min(doc_id) as first_id, string_agg(cast(doc_id as varchar), ',' order by doc_id) as ids from documents group by text having count(*) > 1""")
def exact_duplicates(spark, sf):
    return compare.exact_duplicates(Corpus(spark, sf).documents, "doc_id", F.sha2("text", 256))


@query("""select doc_id, row_number() over (partition by source order by n_chars, doc_id) as version, row_number() over (partition by source order by n_chars desc, doc_id desc) = 1 as is_latest from documents""")
def document_versions(spark, sf):
    return compare.versions(Corpus(spark, sf).documents, "source", "n_chars", "doc_id").select("doc_id", "version", "is_latest")


@query(
    """with w as (select lang, length(text) - length(replace(text, ' ', '')) as spaces, length(text) - length(replace(text, chr(10), '')) as lines, length(text) - length(replace(text, ',', '')) as commas from documents),
    m as (select lang, sum(spaces)::double as s, sum(lines)::double as l, sum(commas)::double as c from w group by lang) select x.lang as a, y.lang as b, round((x.s * y.s + x.l * y.l + x.c * y.c) / (sqrt(x.s * x.s + x.l * x.l + x.c * x.c) * sqrt(y.s * y.s + y.l * y.l + y.c * y.c)), 6) as similarity from m x join m y on x.lang < y.lang"""
)
def structural_similarity(spark, sf):
    n = lambda c: F.sum(F.length("text") - F.length(F.replace(F.col("text"), F.lit(c), F.lit("")))).cast("double")
    m = Corpus(spark, sf).documents.groupBy("lang").agg(F.create_map(F.lit("s"), n(" "), F.lit("l"), n("\n"), F.lit("c"), n(",")).alias("m"))
    a, b = m.select(F.col("lang").alias("a"), F.col("m").alias("ma")), m.select(F.col("lang").alias("b"), F.col("m").alias("mb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(compare.map_cosine(F.col("ma"), F.col("mb")), 6).alias("similarity"))


@query(
    """select doc_id, round(case when quality is null then (0.4 * (doc_id % 10) / 10 + 0.3 * (doc_id % 7) / 7 + 0.2 * (doc_id % 3) / 3) / 0.9 else 0.4 * (doc_id % 10) / 10 + 0.3 * (doc_id % 7) / 7 + 0.2 * (doc_id % 3) / 3 + 0.1 * quality end, 6) as score from documents left join (select doc_id, max(quality) as quality from labels group by doc_id) using (doc_id)"""
)
def composite_similarity(spark, sf):
    c = Corpus(spark, sf)
    q = c.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    part = lambda n: (F.col("doc_id") % n) / n
    return c.documents.join(q, "doc_id", "left").select("doc_id", F.round(compare.composite(part(10), part(7), part(3), F.col("quality")), 6).alias("score"))


@query(None)
def line_diff_similarity(spark, sf):
    """A minimal line diff of each document with the one before it in its source. Ids are ordered by source; texts meet by id."""
    from pyspark.sql import Window

    own = Window.partitionBy("source").orderBy("doc_id")
    docs = Corpus(spark, sf).documents
    pairs = docs.select("doc_id", F.lag("doc_id").over(own).alias("before")).where("before is not null")
    texts = docs.select("doc_id", "text")
    both = pairs.join(texts, "doc_id").join(texts.select(F.col("doc_id").alias("before"), F.col("text").alias("old")), "before")
    return both.select("doc_id", compare.line_diff_ratio("old", "text").alias("ratio"))


@query(None)
def cluster_kmeans(spark, sf):
    return compare.kmeans(embeddings(spark, sf), "vec_id", "embedding", 10)


@query(None)
def cluster_agglomerative(spark, sf):
    return compare.cluster_centroids(centre(spark, sf), "label", "agglomerative", n_clusters=3)


@query(None)
def cluster_hdbscan(spark, sf):
    return compare.cluster_centroids(centre(spark, sf), "label", "hdbscan", least=2)


@query(
    f"""with {CENTRE}, o as (select centroid as q from c where label = 2), s as (select c.label, greatest(0.0, least(1.0, list_dot_product(centroid, q))) as s from c, o where label <> 2) select label, round(s + case when label % 2 = 0 then 0.5 else 0.0 end, 6) as score from s order by s + case when label % 2 = 0 then 0.5 else 0.0 end desc, label limit 4"""
)
def recommend(spark, sf):
    """Half a point for a peer of the same cluster (here: the label's parity) plus the similarity of centroids."""
    from tessera.functions.scalar import clamped_dot

    c = centre(spark, sf)
    own = c.where("label = 2").select("centroid").scalar()
    score = clamped_dot(F.col("centroid"), F.col("own")) + F.when(F.col("label") % 2 == 0, 0.5).otherwise(0.0)
    return c.where("label <> 2").withColumn("own", own).select("label", score.alias("raw")).orderBy(F.desc("raw"), "label").limit(4).select("label", F.round("raw", 6).alias("score"))

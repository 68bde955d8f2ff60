"""Result lists: rank fusion, boosts, removal of repeats, diversity, context."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import block_confidence


def rrf(text: DataFrame, vector: DataFrame, key: str, k: int = 60, text_weight: float = 1.0, vector_weight: float = 1.0) -> DataFrame:
    """key, rrf_score, text_rank, vector_rank: the sum of weight / (k + rank) over two ranked lists."""
    a, b = text.select(key, F.col("rank").alias("text_rank")), vector.select(key, F.col("rank").alias("vector_rank"))
    part = lambda c, w: F.coalesce(w / (k + F.col(c)), F.lit(0.0))
    return a.join(b, key, "full_outer").withColumn("rrf_score", part("text_rank", text_weight) + part("vector_rank", vector_weight))


def dedup_key(chunk: str = "chunk_id", image: str = "image_id", extraction: str = "extraction_id", embedding: str = "embedding_id") -> Column:
    tag = lambda name, c: F.concat(F.lit(name + ":"), F.col(c).cast("string"))
    return F.coalesce(tag("chunk", chunk), tag("image", image), tag("extraction", extraction), tag("embedding", embedding))


def boilerplate(text: str) -> Column:
    """Short text that looks like a page header or footer."""
    t = F.trim(F.col(text))
    short = (F.length(t) > 0) & (F.length(t) < 80)
    like = F.rlike(t, F.lit(r"(?i)^page\s+\d+(\s+of\s+\d+)?$")) | F.rlike(t, F.lit(r"^\d+$")) | F.rlike(t, F.lit(r"^-\s*\d+\s*-$")) | F.contains(F.lower(t), F.lit("confidential")) | F.contains(F.lower(t), F.lit("all rights reserved")) | F.rlike(t, F.lit(r"(?i)^copyright\s")) | F.rlike(t, F.lit("^©\\s"))
    return short & like


def boost(query: str = "", text: str = "text", level: str = "heading_level", atomic: str = "is_atomic", types: str = "content_types", repeated: Column | None = None) -> Column:
    """The factor of a hit: heading level, atomic chunks, content types the query asks for, block confidence, boilerplate; 0.5 to 2."""
    lev = F.least(F.greatest(F.coalesce(F.col(level), F.lit(5)), F.lit(1)), F.lit(4))
    out = (1 + 0.1 * (4 - lev)) * F.when(F.col(atomic), 1.1).otherwise(1.0)
    q = F.lit(query.lower())
    for words, kind, factor in (("table|data|statistic|row|column|figure|chart", "table", 1.2), ("code|function|class|method|import|variable|api", "code", 1.2), ("list|items|steps|requirements|criteria", "list", 1.15)):
        out = out * F.when(F.rlike(q, F.lit(rf"\b({words})\b")) & F.coalesce(F.array_contains(types, kind), F.lit(False)), factor).otherwise(1.0)
    # chunks store lower-case types, which have no confidence of their own
    out = out * F.when(F.coalesce(F.size(types), F.lit(0)) > 0, 0.8 + 0.4 * block_confidence(F.col(types), {})).otherwise(1.0)
    if repeated is not None:
        out = out * F.when(repeated, 0.5).otherwise(1.0)
    out = out * F.when(boilerplate(text), 0.5).otherwise(1.0)
    return F.greatest(F.lit(0.5), F.least(F.lit(2.0), out))


def length_normalized(hits: DataFrame, chunks: DataFrame, document: str, score: str) -> DataFrame:
    """Scores times clamp(sqrt(median / chunks of the document), 0.7, 1); unchanged if all hits are of one document. The median is the upper one."""
    own = chunks.join(hits.select(document).distinct(), document, "left_semi").groupBy(document).agg(F.count("*").alias("n"))
    # the upper of two middle values is the lower one from above
    middle = own.agg(F.struct(F.expr("percentile_disc(0.5) within group (order by n desc)").alias("median"), F.count("*").alias("documents"))).toDF("m").scalar()
    factor = F.when(F.col("m.documents") <= 1, 1.0).otherwise(F.greatest(F.lit(0.7), F.least(F.lit(1.0), F.sqrt(F.col("m.median") / F.greatest(F.coalesce("n", "m.median"), F.lit(1))))))
    return hits.join(own, document, "left").withColumn("m", middle).withColumn(score, F.col(score) * factor).drop("n", "m")


def proximity(hits: DataFrame, document: str, index: str, score: str, near: int = 2) -> DataFrame:
    """Scores times 1 + 0.1 for each other hit within `near` chunks of the same document."""
    band = Window.partitionBy(document).orderBy(index).rangeBetween(-near, near)
    same = Window.partitionBy(document, index)
    return hits.withColumn(score, F.col(score) * (1 + 0.1 * (F.count("*").over(band) - F.count("*").over(same))))


def first_by_hash(hits: DataFrame, content_hash: str, rank: str) -> DataFrame:
    """The best-ranked hit of each content hash; hits without one stay, and take no part in the grouping."""
    known = hits.where(F.col(content_hash).isNotNull())
    n = F.row_number().over(Window.partitionBy(content_hash).orderBy(rank))
    return known.withColumn("_n", n).where(F.col("_n") == 1).drop("_n").unionByName(hits.where(F.col(content_hash).isNull()))


def diverse(hits: DataFrame, document: str, rank: str, most: int) -> DataFrame:
    """At most `most` hits of each document, in rank order."""
    return hits.withColumn("_n", F.row_number().over(Window.partitionBy(document).orderBy(rank))).where(F.col("_n") <= most).drop("_n")


def without_overlaps(hits: DataFrame, document: str, start: str, end: str, rank: str, share: float = 0.5) -> DataFrame:
    """Greedy by rank: drop a hit that shares more than `share` of the shorter span with a kept hit of its document. Works on a result list, so a document's group is at most the list's limit."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, kept = pdf.sort_values(rank), []
        for i, r in enumerate(pdf[[start, end]].itertuples(index=False)):
            a, b = int(r[0]), int(r[1])
            if all(min(b, d) - max(a, c) <= share * max(1, min(b - a, d - c)) for _, c, d in kept):
                kept.append((i, a, b))
        return pdf.iloc[[i for i, _, _ in kept]]

    return hits.groupBy(document).applyInPandas(run, hits.schema)


def grouped(hits: DataFrame, document: str, key: str, rank: str) -> DataFrame:
    """document, result_count, keys in rank order; documents with most results first."""
    out = hits.groupBy(document).agg(F.count("*").alias("result_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank), F.col(key).cast("string").alias("k")))), lambda x: x["k"]), ",").alias("keys"))
    return out.orderBy(F.desc("result_count"), document)


def neighbours(hits: DataFrame, chunks: DataFrame, document: str, index: str, around: int, cut: int = 500) -> DataFrame:
    """Chunks within `around` of a hit, shortened, without the hits themselves."""
    wanted = hits.select(document, F.explode(F.sequence(F.col(index) - around, F.col(index) + around)).alias(index)).distinct()
    return chunks.join(wanted, [document, index], "left_semi").join(hits.select(document, index), [document, index], "left_anti").withColumn("text", F.substring("text", 1, cut))


def context(hits: DataFrame, rank: str, document: str, text: str, most: int) -> DataFrame:
    """One row: the hits as a markdown block in rank order, cut at `most` characters."""
    lines = F.collect_list(F.struct(F.col(rank), F.concat(F.lit("### Source "), F.col(rank).cast("string"), F.lit(" (document "), F.col(document).cast("string"), F.lit(")\n"), F.col(text)).alias("line")))
    return hits.agg(F.substring(F.array_join(F.transform(F.array_sort(lines), lambda x: x["line"]), "\n\n"), 1, most).alias("context"), F.count("*").alias("n_sources"))


def reranked(hits: DataFrame, text: str, rank: str, scorer, pool: int = 20) -> DataFrame:
    """The first `pool` hits by a scorer (a pandas UDF over their first 500 characters), the rest behind in their order."""
    return hits.withColumn("_s", F.when(F.col(rank) <= pool, scorer(F.substring(text, 1, 500)))).orderBy(F.col("_s").desc_nulls_last(), rank).drop("_s")


def batches_of(items: Iterator, size: int) -> Iterator[list]:
    """Lists of up to `size` items."""
    held: list = []
    for x in items:
        held.append(x)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held

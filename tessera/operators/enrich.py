"""Joining context to results, images and headings; saved searches; roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import worth_describing
from tessera.functions.text import normalize_search, strip_bold

# Names of numbered headings that should share a level.
NUMBERED = ("ARTICLE", "SECTION", "CHAPTER", "PART", "TITLE", "APPENDIX", "SCHEDULE", "EXHIBIT")
LETTERED = ("APPENDIX", "SCHEDULE", "EXHIBIT")


def with_clusters(hits: DataFrame, members: DataFrame, document: str) -> DataFrame:
    """hits with the clusters of their document, comma-joined. members: (document, cluster)."""
    own = members.groupBy(document).agg(F.array_join(F.array_sort(F.collect_set(F.col("cluster").cast("string"))), ",").alias("clusters"))
    return hits.join(own, document, "left")


def related(comparisons: DataFrame) -> DataFrame:
    """document, other, similarity: each comparison from both of its ends."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("document"), F.col("b").alias("other")), F.struct(F.col("b").alias("document"), F.col("a").alias("other"))))
    return comparisons.select(ends.alias("e"), "similarity").select("e.*", "similarity")


def cross_document(hits: DataFrame, comparisons: DataFrame, document: str, rank: str, most: int = 3) -> DataFrame:
    """The first hit of each document gets its most similar compared documents."""
    first = hits.withColumn("_first", F.row_number().over(Window.partitionBy(document).orderBy(rank)) == 1)
    best = related(comparisons).withColumn("_n", F.row_number().over(Window.partitionBy("document").orderBy(F.desc("similarity"), "other"))).where(F.col("_n") <= most)
    lists = best.groupBy(F.col("document").alias(document)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col("other").cast("string").alias("o")))), lambda x: x["o"]), ",").alias("related"))
    return first.join(lists, document, "left").withColumn("related", F.when(F.col("_first"), F.col("related"))).drop("_first")


def table_metadata(hits: DataFrame, records: DataFrame, chunk: str, params: str) -> DataFrame:
    """hits with columns and row count of their table, from the JSON of the chunk's processing parameters."""
    own = records.select(chunk, F.from_json(params, "columnHeaders array<string>, rowCount long").alias("m")).where("m.rowCount is not null")
    return hits.join(own.select(chunk, F.array_join("m.columnHeaders", " | ").alias("table_columns"), F.col("m.rowCount").alias("table_rows")), chunk, "left")


def repeats_line(text: str, line: str) -> Column:
    """Is a chunk one of the repeated lines: equal, or one holds the other at nearly its length?"""
    a, b = normalize_search(text), normalize_search(line)
    n, m = F.length(a), F.length(b)
    return (n > 0) & ((a == b) | ((n <= 1.2 * m) & F.contains(b, a)) | ((n <= 1.5 * m) & F.contains(a, b)))


def heading_group(heading: str) -> Column:
    """The numbered kind of a heading, or null."""
    t = F.upper(F.trim(strip_bold(heading)))
    out = F.lit(None).cast("string")
    for name in reversed(NUMBERED):
        out = F.when(F.rlike(t, F.lit(rf"^{name}\s+" + ("[A-Z0-9]" if name in LETTERED else r"\d+"))), F.lit(name)).otherwise(out)
    return out


def levelled(headings: DataFrame, document: str, heading: str, level: str, least: int = 3) -> DataFrame:
    """Headings of one numbered kind in a document get its most common level (the smaller of equals) where there are `least` of them."""
    own = headings.withColumn("_g", heading_group(heading))
    counts = own.where("_g is not null").groupBy(document, "_g", level).agg(F.count("*").alias("_n"))
    mode = counts.groupBy(document, "_g").agg(F.min_by(F.col(level), F.struct(F.negative("_n"), F.col(level))).alias("_mode"), F.sum("_n").alias("_total"))
    return own.join(mode, [document, "_g"], "left").withColumn(level, F.when(F.col("_total") >= least, F.col("_mode")).otherwise(F.col(level))).drop("_g", "_mode", "_total")


def block_type_of(file_name: str) -> Column:
    """The block type in an extracted image's name, or null."""
    return F.nullif(F.regexp_extract(file_name, r"_page_\d+_([A-Za-z]+)_\d+\.", 1), F.lit(""))


def page_context(text: str, page: Column, pages: Column, most: int = 1000) -> Column:
    """Text around a page's place where page offsets are unknown: 500 characters to each side, cut at blanks."""
    n = F.length(text)
    at = F.floor((F.greatest(F.lit(1), F.least(page, pages)) - 1) / F.greatest(F.lit(1), pages - 1) * n)
    a, b = F.greatest(F.lit(0), at - most // 2), F.least(n, at + most // 2)
    cut = F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    cut = F.when(a > 0, F.regexp_replace(cut, r"^\S{1,49} ", "")).otherwise(cut)
    cut = F.when(b < n, F.regexp_replace(cut, r" \S{0,48}$", "")).otherwise(cut)
    return F.trim(cut)


def image_decisions(images: DataFrame, least: int = 50) -> DataFrame:
    """images with `decision`: why an image is described or not; the first image of a content hash stands for the others."""
    w, h = F.col("width"), F.col("height")
    first = images.where(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.min("id").alias("_first"))
    decision = (
        F.when(F.col("is_header_footer"), "header_footer")
        .when(F.col("block_type").isin("Figure", "FigureGroup"), "figure")
        .when(F.col("content_hash").isNotNull() & (F.col("id") > F.col("_first")), "duplicate")
        .when(F.greatest(w, h) < least, "too_small")
        .when(F.greatest(w, h) < 100, "icon")
        .when(F.greatest(w, h) / F.greatest(F.lit(1), F.least(w, h)) > 6, "extreme_aspect")
        .when(~worth_describing(w, h, F.col("colors")), "low_relevance")
        .otherwise("describe")
    )
    return images.join(first, "content_hash", "left").withColumn("decision", decision).select(*images.columns, "decision")


def copied_descriptions(images: DataFrame) -> DataFrame:
    """Images without a description take that of the first image with the same content."""
    known = images.where(F.col("description").isNotNull() & F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.min_by("description", "id").alias("_d"))
    return images.join(known, "content_hash", "left").withColumn("description", F.coalesce("description", "_d")).drop("_d")


def page_pictures(blocks: DataFrame, document: str) -> DataFrame:
    """Per page: is there a figure, and how many pictures lie in headers or footers and in the body. blocks: (document, page, kind, parent_kind)."""
    edge = F.col("parent_kind").isin("PageHeader", "PageFooter")
    picture = F.col("kind") == "Picture"
    return blocks.groupBy(document, "page").agg(F.max(F.col("kind").isin("Figure", "FigureGroup")).alias("has_figure"), F.count_if(picture & edge).alias("edge_pictures"), F.count_if(picture & ~edge).alias("body_pictures"))


def replayed(saved: DataFrame, runs: DataFrame) -> DataFrame:
    """Saved searches with how often they ran and when last."""
    n = runs.groupBy("search_id").agg(F.count("*").alias("n_runs"), F.max("ran_at").alias("last_run"))
    return saved.join(n, "search_id", "left").withColumn("n_runs", F.coalesce("n_runs", F.lit(0)))


def extras(docs: DataFrame, key: str, column: str) -> DataFrame:
    """key, section, n: sections of a JSON object and how many entries each array section has."""
    each = docs.select(key, F.explode(F.from_json(column, "map<string,string>")).alias("section", "body"))
    return each.select(key, "section", F.coalesce(F.json_array_length("body"), F.lit(1)).cast("long").alias("n"))


def allowed(users: DataFrame, scopes: DataFrame, tools: DataFrame) -> DataFrame:
    """user, tool: what each role may do. scopes: (role, scope); tools: (tool, scope). The planner sends the small sides to every task if they are small."""
    return users.join(scopes, "role").join(tools, "scope").select("user_id", "tool")

"""Filtered lists of the stored entities, and joins that dress them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.reports import page


def where_given(rows: DataFrame, **equal: object) -> DataFrame:
    """Rows whose columns have the given values; a value that is None is no condition."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def pending_chunks(chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """Chunks that wait for their vector, in order."""
    own = chunks.where("embedding_status = 'pending'").orderBy("document_id", "chunk_index")
    return own if limit is None else own.limit(limit)


def embeddings(rows: DataFrame, document: object = None, source: str | None = None, model: str | None = None) -> DataFrame:
    """Vectors by document, model and what they are of: a chunk, an image or an extraction."""
    kinds = {"chunk": "chunk_id", "image": "image_id", "extraction": "extraction_id"}
    if source is not None:
        if source not in kinds:
            raise ValueError(f"source is one of {', '.join(kinds)}")
        rows = rows.where(F.col(kinds[source]).isNotNull())
    return where_given(rows, document_id=document, model_name=model)


def vector(rows: DataFrame, key: str, item: object) -> DataFrame:
    """The vector of one item: a filter that reaches the scan."""
    return rows.where(F.col(key) == item)


def vector_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n_vectors"))


def annotations(rows: DataFrame, document: object = None, kind: str | None = None, status: str | None = None, user: object = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Annotations by document, type, status and user, newest first, a page of them."""
    return page(where_given(rows, document_id=document, annotation_type=kind, status=status, user_id=user), [F.desc("created_at"), F.asc("id")], limit, offset)


def images(rows: DataFrame, document: object = None, status: str | None = None, kind: str | None = None, least_confidence: float | None = None, text: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Images by document, description status, type, confidence and words of the description, in page order."""
    rows = where_given(rows, document_id=document, vlm_status=status, image_type=kind)
    if least_confidence is not None:
        rows = rows.where(F.col("vlm_confidence") >= least_confidence)
    if text is not None:
        rows = rows.where(holds(F.col("vlm_description"), text))
    return page(rows, [F.asc("document_id"), F.asc("page_number"), F.asc("id")], limit, offset)


def pending_images(rows: DataFrame, limit: int) -> DataFrame:
    return rows.where("vlm_status = 'pending'").orderBy("document_id", "page_number", "id").limit(limit)


def holds(column: Column, part: str) -> Column:
    """Does a text hold a part, in either case? The part has no wildcards."""
    return F.contains(F.lower(column), F.lit(part.lower()))


def extractions(rows: DataFrame, query: str, document: object = None, limit: int = 50) -> DataFrame:
    """Extractions whose JSON holds a text, newest first."""
    return where_given(rows, document_id=document).where(holds(F.col("extraction_json"), query)).orderBy(F.desc("created_at"), "id").limit(limit)


def form_fills(rows: DataFrame, query: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """Form fills whose field data, filled fields or path hold a text, newest first, a page of them."""
    hit = holds(F.col("field_data_json"), query) | holds(F.coalesce("fields_filled", F.lit("")), query) | holds(F.col("source_file_path"), query)
    return page(rows.where(hit), [F.desc("created_at"), F.asc("id")], limit, offset)


def with_items(hits: DataFrame, key: str, embeddings: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits on vectors with their chunk and document, which may be gone."""
    own = hits.join(embeddings.select(key, "chunk_id", "document_id"), key)
    return own.join(chunks.select("chunk_id", "text"), "chunk_id", "left").join(documents.select("document_id", "file_name"), "document_id", "left")


def named_pairs(comparisons: DataFrame, documents: DataFrame) -> DataFrame:
    """Comparisons with the names of both documents."""
    name = lambda i: documents.select(F.col("document_id").alias(f"document_id_{i}"), F.col("file_name").alias(f"name_{i}"))
    return comparisons.join(name(1), "document_id_1", "left").join(name(2), "document_id_2", "left")


def with_images(hits: DataFrame, images: DataFrame) -> DataFrame:
    """Image hits with page, size, type and confidence of their image; other hits have none."""
    own = images.select(F.col("id").alias("image_id"), "page_number", "width", "height", "image_type", "vlm_confidence")
    return hits.join(own, "image_id", "left")


def safe_count(spark: SparkSession, table: str, condition: str | None = None) -> int:
    """Rows of a table, 0 where it is not there."""
    if not spark.catalog.tableExists(table):
        return 0
    rows = spark.table(table)
    return (rows.where(condition) if condition else rows).count()


def json_or_commas(value: str | Column) -> Column:
    """A JSON array of texts, or else the parts between commas, trimmed, without empty ones."""
    text = F.col(value) if isinstance(value, str) else value
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.from_json(F.when(F.startswith(F.trim(text), F.lit("[")), text), "array<string>"), parts)


def model_json(text: str | Column, schema: str) -> Column:
    """The JSON object in what a model said: without code fences, or else what lies between the first and the last brace; null if that is no JSON."""
    own = F.trim(F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"```json\n?|\n?```", ""))
    inside = F.regexp_extract(own, r"(?s)(\{.*\})", 1)
    read = lambda c: F.when(F.get_json_object(c, "$").isNotNull(), F.from_json(c, schema))
    return F.coalesce(read(own), read(F.when(inside != "", inside)))


def evaluation(text: str | Column) -> Column:
    """A model's evaluation of an image, with what is missing filled in."""
    own = model_json(text, "imageType string, primarySubject string, paragraph1 string, paragraph2 string, paragraph3 string, extractedText array<string>, dates array<string>, names array<string>, numbers array<string>, confidence double")
    blank = lambda c: F.coalesce(own[c], F.lit("")).alias(c)
    none = lambda c: F.coalesce(own[c], F.array().cast("array<string>")).alias(c)
    return F.when(own.isNotNull(), F.struct(F.coalesce(F.nullif(own["imageType"], F.lit("")), F.lit("other")).alias("imageType"), *[blank(c) for c in ("primarySubject", "paragraph1", "paragraph2", "paragraph3")], *[none(c) for c in ("extractedText", "dates", "names", "numbers")], F.coalesce(own["confidence"], F.lit(0.5)).alias("confidence")))


def image_stats(images: DataFrame) -> DataFrame:
    """One row: images by the status of their description."""
    n = lambda s: F.count_if(F.col("vlm_status") == s).alias(s)
    return images.agg(F.count("*").alias("total"), *[n(s) for s in ("complete", "pending", "processing", "failed")], F.avg("vlm_confidence").alias("avg_confidence"))


def evaluation_report(documents: DataFrame, images: DataFrame) -> DataFrame:
    """document_id, and of its images: all, complete, pending, failed, and mean, least and greatest confidence of the complete ones (0 where there are none)."""
    n = lambda s: F.count_if(F.col("vlm_status") == s)
    sure = F.when(F.col("vlm_status") == "complete", F.col("vlm_confidence"))
    own = images.groupBy("document_id").agg(F.count("*").alias("image_count"), n("complete").alias("vlm_complete"), n("pending").alias("vlm_pending"), n("failed").alias("vlm_failed"), F.avg(sure).alias("avg_confidence"), F.min(sure).alias("min_confidence"), F.max(sure).alias("max_confidence"))
    out = documents.select("document_id").join(own, "document_id", "left")
    counts = ("image_count", "vlm_complete", "vlm_pending", "vlm_failed")
    return out.select("document_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("avg_confidence", "min_confidence", "max_confidence")])


def low_confidence(images: DataFrame, below: float = 0.7, limit: int = 50) -> DataFrame:
    """The described images of least confidence."""
    return images.where((F.col("vlm_status") == "complete") & (F.col("vlm_confidence") < below)).orderBy("vlm_confidence", "id").limit(limit)

"""SQL names of the engine's functions: call `register(spark)` once a session."""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import ArrowUDFType, arrow_udf, udtf

from tessera.functions.text import Porter, fold, stemmed_tokens
from tessera.operators import parse
from tessera.operators.compare import line_diff_ratio

Row = tuple


class ParseBlocks:
    """Blocks of a markdown text."""

    def eval(self, text: str):
        for i, b in enumerate(parse.blocks(text or "")):
            yield i, b.kind, b.start, b.end, b.level, b.heading, b.section, b.text


class ChunkText:
    """Chunks of a markdown text."""

    def eval(self, text: str):
        for i, c in enumerate(parse.chunks(text or "")):
            yield i, c.start, c.heading, c.section, c.atomic, c.text


class WalkBlocks:
    """Blocks of a JSON layout tree."""

    def eval(self, tree: str):
        try:
            own = json.loads(tree) if tree else []
        except ValueError:
            own = []
        for i, b in enumerate(parse.walk(own)):
            yield i, b["kind"], b["page"], b["depth"], b["text"]


class HtmlTables:
    """Cells of the tables of an HTML text."""

    def eval(self, html: str):
        for row, tr in enumerate(re.findall(r"(?is)<tr[^>]*>(.*?)</tr>", html or "")):
            for column, cell in enumerate(re.findall(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>", tr)):
                yield row, column, re.sub(r"\s+", " ", re.sub("<[^>]*>", " ", cell)).strip()


def centroid(vectors: pa.Array) -> list[float] | None:
    """The mean of some vectors, scaled to unit length; null for none. A group's vectors are gathered: for large groups use `vectors.centroids`."""
    own = vectors.drop_null()
    if not len(own):
        return None
    mean = own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1).mean(0)
    size = float(np.linalg.norm(mean))
    return (mean / size if size else mean).tolist()


#: A walk from each record to its root; `cycle` marks the step after which it would come to an id again.
PROV_LINEAGE = """
with recursive walk(item, step, id, type, parent_id, met) as (
  select id, 0, id, type, parent_id, array(id) from {records}
  union all
  select w.item, w.step + 1, r.id, r.type, r.parent_id, array_append(w.met, r.id) from walk w join {records} r on w.parent_id = r.id where not array_contains(w.met, r.id))
select item, step, id, type, coalesce(array_contains(met, parent_id), false) as cycle from walk"""


def lineage_view(spark: SparkSession, records: str, name: str = "prov_lineage") -> None:
    """A view (item, step, id, type, cycle) over a view or table of records. Its depth and rows are bound by Spark's limits for recursion (an error beyond them); `provenance.lineage` has none."""
    spark.sql(f"create or replace temporary view {name} as {PROV_LINEAGE.format(records=records)}")


def register(spark: SparkSession) -> None:
    spark.udf.register("porter_stem", lambda w: None if w is None else Porter.stem(w.lower()), T.StringType())
    spark.udf.register("fold_diacritics", lambda w: None if w is None else fold(w), T.StringType())
    spark.udf.register("stemmed_tokens", stemmed_tokens)
    spark.udf.register("line_diff_ratio", line_diff_ratio)
    spark.udf.register("vec_centroid", arrow_udf(centroid, T.ArrayType(T.DoubleType()), ArrowUDFType.GROUPED_AGG))
    spark.udtf.register("html_tables", udtf(HtmlTables, returnType="row int, column int, text string"))
    spark.udtf.register("parse_blocks", udtf(ParseBlocks, returnType="block_index int, kind string, start_offset int, end_offset int, level int, heading string, section_path string, text string"))
    spark.udtf.register("chunk_text", udtf(ChunkText, returnType="chunk_index int, start_offset int, heading string, section_path string, is_atomic boolean, text string"))
    spark.udtf.register("walk_json_blocks", udtf(WalkBlocks, returnType="block_index int, kind string, page int, depth int, text string"))

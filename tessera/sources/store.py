"""Tables of records by document (images, vectors, extractions) that repeated and broken batches leave as they should be."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.operators.manifest import Manifest

#: Rows of a file, on average; folders of a segment at most.
ROWS = 500_000
FOLDERS = 256


class Store:
    """Rows of documents in segments under a manifest.

    A batch replaces the rows of its documents. Within it, rows of one document
    and content are one row (the least by all columns); a document whose rows
    are what the store has already changes nothing, and a batch without any
    change writes no version. A batch under a number that was applied is not
    applied again, and one that broke before its manifest has not happened, so
    after a retry the table is the same, however often a batch was tried.
    Readers see the version that they opened. Documents are told apart by value,
    null being one of them.
    """

    def __init__(self, spark: SparkSession, path: str, document: str, content: str):
        self.spark, self.path, self.document, self.content = spark, path, document, content
        self.manifest = Manifest(spark, path)

    def state(self) -> dict | None:
        return self.manifest.read()

    def read(self, documents: DataFrame | None = None) -> DataFrame:
        """The rows of all documents, or of some."""
        state = self.state()
        if state is None:
            raise FileNotFoundError(f"nothing in {self.path}")
        rows = self.rows(state)
        return rows if documents is None else rows.join(documents.select(self.document).distinct().withColumnRenamed(self.document, "_d"), F.col(self.document).eqNullSafe(F.col("_d")), "left_semi")

    def rows(self, state: dict) -> DataFrame:
        schema = StructType.fromJson(state["schema"])
        out, gone = None, None
        for at, s in enumerate(state["segments"]):
            folder = posixpath.join(self.path, "segments", s)
            one = self.spark.read.schema(StructType([*schema.fields, StructField("folder", IntegerType())])).parquet(posixpath.join(folder, "rows")).drop("folder").withColumn("_at", F.lit(at))
            keys = self.spark.read.schema(StructType([f for f in schema.fields if f.name == self.document])).parquet(posixpath.join(folder, "documents")).select(F.col(self.document).alias("_d"), F.lit(at).alias("_until"))
            out, gone = (one, keys) if out is None else (out.unionByName(one), gone.unionByName(keys))
        if out is None:
            return self.spark.createDataFrame([], schema)
        last = gone.groupBy("_d").agg(F.max("_until").alias("_until"))
        return out.join(last, F.col(self.document).eqNullSafe(F.col("_d")) & (F.col("_at") < F.col("_until")), "left_anti").drop("_at")

    def put(self, rows: DataFrame, documents: DataFrame | None = None, batch: tuple[str, int] | None = None) -> dict:
        """Apply a batch; the state after it. documents: all that the batch is about, where some have no rows left."""
        old = self.state()
        if old and batch and old["batches"].get(batch[0], -1) >= batch[1]:
            return old
        names = rows.columns
        new = rows.groupBy(self.document, self.content).agg(F.min(F.struct(*names)).alias("row")).select("row.*")
        about = rows.select(self.document) if documents is None else rows.select(self.document).unionByName(documents.select(self.document))
        about = about.distinct()
        segment = uuid.uuid4().hex
        folder = posixpath.join(self.path, "segments", segment)
        if old:
            # of each document the number of rows and a sum of their hashes, on both sides
            marks = lambda df, n: df.groupBy(F.col(self.document).alias(f"_{n}")).agg(F.struct(F.count("*"), F.sum(F.xxhash64(*names).cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), *names).cast("decimal(38,0)"))).alias(n))
            same = lambda n: F.col(self.document).eqNullSafe(F.col(f"_{n}"))
            both = about.join(marks(new, "now"), same("now"), "left").join(marks(self.read(about).select(*names), "before"), same("before"), "left")
            about = both.where(~F.col("now").eqNullSafe(F.col("before"))).select(self.document)
        about.write.parquet(posixpath.join(folder, "documents"))
        about = self.spark.read.schema(about.schema).parquet(posixpath.join(folder, "documents"))
        n = about.count()
        value = (old or {"segments": [], "batches": {}, "schema": new.schema.jsonValue()}) | {}
        version = value.pop("version", None)
        if n:
            kept = new.join(about.withColumnRenamed(self.document, "_d"), F.col(self.document).eqNullSafe(F.col("_d")), "left_semi")
            folders = max(1, min(FOLDERS, -(-kept.count() // ROWS)))
            place = F.pmod(F.xxhash64(self.document), F.lit(folders)).cast("int")
            kept.withColumn("folder", place).repartition(folders, "folder").write.partitionBy("folder").parquet(posixpath.join(folder, "rows"))
            value["segments"] = [*value["segments"], segment]
        elif old and not batch:
            return old
        if batch:
            value["batches"] = value["batches"] | {batch[0]: batch[1]}
        return self.manifest.write(value, version)

    def compact(self) -> dict:
        """All rows in one segment; then what no version needs is deleted."""
        old = self.state()
        segment = uuid.uuid4().hex
        folder = posixpath.join(self.path, "segments", segment)
        rows = self.rows(old)
        folders = max(1, min(FOLDERS, -(-rows.count() // ROWS)))
        rows.withColumn("folder", F.pmod(F.xxhash64(self.document), F.lit(folders)).cast("int")).repartition(folders, "folder").write.partitionBy("folder").parquet(posixpath.join(folder, "rows"))
        rows.select(self.document).distinct().write.parquet(posixpath.join(folder, "documents"))
        version = old.pop("version")
        new = self.manifest.write(old | {"segments": [segment]}, version)
        self.manifest.keep([segment], "segments")
        return new

"""Files in, files out: directory scans, registration, exports, model adapters."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File types that can be ingested.
EXTENSIONS = ("pdf", "png", "jpg", "jpeg", "tiff", "tif", "bmp", "gif", "webp", "docx", "doc", "pptx", "ppt", "xlsx", "xls", "txt", "csv", "md")


def scan(spark: SparkSession, folder: str | list[str], recursive: bool = True, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path, file_type, file_size, modified_at, file_hash of every file with a known extension; other files are not opened."""
    names = "*.{" + ",".join([*extensions, *map(str.upper, extensions)]) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", names).load(folder)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.where(kind.isin(*extensions)).select("path", kind.alias("file_type"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified_at"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("file_hash"))


def register(found: DataFrame, known: DataFrame) -> DataFrame:
    """found with `action`: skip (same path and hash), duplicate (same hash elsewhere), version (known path, new hash) or new."""
    same = known.select("path", "file_hash").distinct().withColumn("_same", F.lit(True))
    hashes = known.select("file_hash").distinct().withColumn("_hash", F.lit(True))
    paths = known.select("path").distinct().withColumn("_path", F.lit(True))
    out = found.join(same, ["path", "file_hash"], "left").join(hashes, "file_hash", "left").join(paths, "path", "left")
    return out.withColumn("action", F.when(F.col("_same"), "skip").when(F.col("_hash"), "duplicate").when(F.col("_path"), "version").otherwise("new")).drop("_same", "_hash", "_path")


def same_size_hints(files: DataFrame, least: int = 3) -> DataFrame:
    """Groups of files of one size, and whether their hashes agree; none for fewer than `least` files."""
    n = files.agg(F.count("*")).toDF("n").scalar()
    return files.withColumn("_n", n).where(F.col("_n") >= least).groupBy("file_size").agg(F.count("*").alias("n"), (F.count_distinct("file_hash") == 1).alias("same_hash")).where("n > 1")


def export_csv(rows: DataFrame, path: str, quote_all: bool = False) -> None:
    rows.write.mode("overwrite").csv(path, header=True, quoteAll=quote_all, escape='"', nullValue="")


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def export_markdown(rows: DataFrame, text: Column, path: str) -> None:
    rows.select(text.alias("value")).write.mode("overwrite").text(path)


def document_json(docs: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """One JSON text a document, with its chunks in order."""
    own = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("chunks"))
    return docs.join(own, key, "left").select(key, F.to_json(F.struct(*docs.columns, "chunks")).alias("json"))


def signature(secret: str, body: str) -> str:
    return hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()


def webhook_sink(deliver: Callable[[str, str], None], secret: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each partition delivers its rows as signed JSON."""

    def send(rows) -> None:
        for r in rows:
            deliver(r.body, signature(secret, r.body))

    def batch(df: DataFrame, _epoch: int) -> None:
        df.select(F.to_json(F.struct(*df.columns)).alias("body")).foreachPartition(send)

    return batch


def adapter(model: Callable[[list[str]], list[list[float]]], size: int = 512):
    """A pandas UDF around an embedding model: batches of `size`, halved when memory runs out."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(text: pd.Series) -> pd.Series:
        out: list[list[float]] = []
        todo, step = text.fillna("").tolist(), size
        while todo:
            try:
                out += model(todo[:step])
                todo = todo[step:]
            except MemoryError:
                if step == 1:
                    raise
                step = max(1, step // 2)
        return pd.Series(out)

    return run


def stand_in_model(dims: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic model for tests: hashed words, unit length."""

    def run(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dims
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=4).digest(), "little")
                v[h % dims] += 1.0 if h >> 31 else -1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out

    return run

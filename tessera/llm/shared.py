"""Lineage cuts, connected components and the first row of each."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LATEST = 2**63 - 1


def ensure_checkpoints(spark: SparkSession) -> None:
    """Use the folder in spark.checkpoint.dir; where it is unset (local tests), a folder of the session's own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = os.path.join(tempfile.gettempdir(), f"checkpoints-{context.applicationId}")
        context.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, from reliable storage: a lost executor costs no recomputation."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node that each node reaches. edges: (a, b), of one type that can be ordered; either way round, repeats and loops allowed.

    Alternating stars: every node sends its larger neighbours to the least
    node near it, then its smaller neighbours to the least of them, until
    nothing changes. Only minima and joins by node: no neighbour list is held.
    Edges are dealt once by each end in a round; minimum and join read the same.
    """
    now = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").repartition("a")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # b > a, said with m (never more than a) so that it is not pushed below the exchange, which then serves both sides
        large = both.join(least, "a").where(F.greatest("a", "m") < F.col("b")).select(F.col("m").alias("a"), "b").where("a < b").repartition("b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b")))).alias("e")).select("e.*").where("a < b").distinct()
        now = cut(small)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark or new[0] == 0:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        mark = new


def row_keys(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """row (the columns of docs), and __at (doc_id, null last), __h and __g: 96 hash bits of the row, nulls told apart by place. No column of docs can clash with those."""
    own = [docs[f"`{c}`"] for c in docs.columns]
    every = [*own, *(c.isNull() for c in own)]
    return docs.select(F.struct(*own).alias("row"), F.coalesce(docs[f"`{key}`"].cast("long"), F.lit(LATEST)).alias("__at"), F.xxhash64(*every).alias("__h"), F.hash(*every).alias("__g"))


def keep_first(docs: DataFrame, member: DataFrame) -> DataFrame:
    """One row of docs for each root. member: (__at, __h, __g, root) of each row."""
    names = ["__at", "__h", "__g"]
    found = member.groupBy("root").agg(F.min(F.struct(*names)).alias("first")).select("first.*").distinct()
    # the join and the window share one exchange; rows of one key are alike in every column
    same = Window.partitionBy(*names).orderBy("__at")
    return row_keys(docs).join(found, names, "left_semi").withColumn("__rank", F.row_number().over(same)).where("__rank = 1").select("row.*")

"""Operator 7: quality rules, gradient-boosted trees over document statistics.

Base counts are exact (`stats`). The trees are fitted on labelled documents (at
most `SAMPLE` of them, the least by a hash of doc_id, so the sample is the same
in every run), flattened into node arrays and applied to each Arrow batch: one
scan and one Arrow map over all documents, no shuffle. Shares of symbols,
duplicate lines and repeated words never raise the verdict, the number of words
and the share of letters never lower it.

Defined cases: a null or empty text has no words and fails the base rules; with
no labelled documents (or one class of label only) every document that passes
the base rules is kept; a document labelled several times counts each label;
repeated rows each give a row; null doc_ids stay; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import arrays
from tessera.llm.boosting import Forest, fit
from tessera.llm.stats import BASE, FEATURES, measure

SAMPLE = 20_000
#: A document goes if its probability of being good is below this.
THRESHOLD = 0.3
RISING = ("log_words", "letter_share")
FALLING = ("symbol_share", "dup_line_share", "repeat_share", "lone_sign_share")
MONOTONE = np.array([1 if f in RISING else -1 if f in FALLING else 0 for f in FEATURES])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """The trees from documents with labels.quality (0 or 1); sample bounds the labels, and the rows that reach the driver where documents share a doc_id."""
    own = labels.where("doc_id is not null and quality in (0, 1)").select(labels["doc_id"].cast("long").alias("doc_id"), "quality")
    # at most `sample` rows of two numbers: small enough to broadcast whatever the corpus, so texts are not shuffled
    own = F.broadcast(own.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).join(own, "doc_id").select("text", "quality")

    def run(parts):
        arrays.release()
        for b in parts:
            _, x = measure(b.column(0))
            yield pa.record_batch([b.column(1).cast(pa.int32()), *[pa.array(x[:, i]) for i in range(len(FEATURES))]], names=["quality", *FEATURES])

    got = rows.mapInArrow(run, "quality int, " + ", ".join(f"{f} double" for f in FEATURES)).orderBy(F.xxhash64(*FEATURES), "quality", *FEATURES).limit(sample).toArrow()
    x = np.stack([got.column(f).to_numpy() for f in FEATURES], 1) if got.num_rows else np.zeros((0, len(FEATURES)))
    return fit(x, got.column("quality").to_numpy().astype(float), MONOTONE)


def failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def judge(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, quality_score for each row of docs."""

    def run(parts):
        arrays.release()
        for b in parts:
            counts, x = measure(b.column(1))
            bad, score = failed(counts), forest.probability(x)
            yield pa.record_batch([b.column(0), *[pa.array(counts[k]) for k in BASE], pa.array(bad), pa.array(~bad & (score >= THRESHOLD)), pa.array(score)], names=["doc_id", *BASE, "base_failed", "kept", "quality_score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{k} long" for k in BASE) + ", base_failed boolean, kept boolean, quality_score double")


def keep(docs: DataFrame, forest: Forest) -> DataFrame:
    """The rows and columns of docs that the rules keep."""
    at = docs.columns.index("text")

    def run(parts):
        arrays.release()
        for b in parts:
            counts, x = measure(b.column(at))
            yield b.filter(pa.array(~failed(counts) & (forest.probability(x) >= THRESHOLD)))

    return docs.mapInArrow(run, docs.schema)

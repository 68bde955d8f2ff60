"""Operator 13: what five filters remove alone, together and in every order.

A relational word pipeline: words are exploded, counted by (document, word) and
then by document for totals and distinct words; the other flags are joined on
from the outside. A document's five flags make a mask of 0 to 31, and one
aggregation by part counts documents, good and toxic ones in 32 columns each.
All 120 orders of the filters and their steps follow from those columns.

Texts move once, to the words' aggregation: rows are dealt by (doc_id, 128 hash
bits of the text), so both counts by word and by document need no further
exchange, and the rows of a group of copies or of a hot source are dealt apart.
Repeated rows collapse before that exchange and are counted. The rest is
narrow: identical texts are found as the least doc_id of each text (partial
minima), joined back by (doc_id, text), which no group of copies makes hot.

Defined cases: a null text is empty, a null part the empty string; words are
runs of characters other than space and \\t \\n \\v \\f \\r, told apart by case;
a null doc_id is later than every other, so such a row is a copy wherever its
text has a doc_id; rows that share doc_id and text are not copies of each
other; repeated rows each count; a document is good (toxic) if any of its
labels says so; a label without a document counts nowhere; other columns are
ignored, whatever their names; an empty table gives no parts and no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
LEAST_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 2
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#$%&*|]"
MASKS = 1 << len(FILTERS)


def identified(docs: DataFrame, text: str, key: str, part: str) -> DataFrame:
    """doc, part, text, and u, v: 128 hash bits of the text."""
    own = F.coalesce(docs[f"`{text}`"].cast("string"), F.lit(""))
    found = docs.select(docs[f"`{key}`"].alias("doc"), F.coalesce(docs[f"`{part}`"].cast("string"), F.lit("")).alias("part"), own.alias("text"))
    return found.withColumns({"u": F.xxhash64("text"), "v": F.xxhash64(F.lit("v"), "text")})


def word_counts(rows: DataFrame) -> DataFrame:
    """doc, u, v, words, kinds: words and distinct words of each text."""
    texts = rows.groupBy("doc", "u", "v").agg(F.max("text").alias("text"))
    # splitting gives '' at the ends, so every text has a row
    words = texts.select("doc", "u", "v", F.explode(F.split("text", SPACE)).alias("word"))
    each = words.groupBy("doc", "u", "v", "word").agg(F.count("*").alias("n"))
    real = F.col("word") != ""
    return each.groupBy("doc", "u", "v").agg(F.sum(F.when(real, F.col("n")).otherwise(0)).alias("words"), F.count_if(real).alias("kinds"))


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def flags(docs: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """doc, part, copies (rows that are alike) and mask: bit i is set if the text fails filter i of ABCDE."""
    rows = identified(docs, text, key, part)
    capitals = 100 * F.regexp_count("text", F.lit("[A-Z]")) > CAPITAL_PERCENT * F.char_length("text")
    narrow = rows.select("doc", "part", "u", "v", capitals.alias("c"), F.col("text").rlike(SYMBOLS).alias("d"))
    narrow = narrow.groupBy("doc", "part", "u", "v").agg(F.count("*").alias("copies"), F.max("c").alias("c"), F.max("d").alias("d"))
    first = rows.select("doc", "u", "v").groupBy("u", "v").agg(F.min("doc").alias("fdoc")).select("fdoc", F.col("u").alias("fu"), F.col("v").alias("fv"))
    counts = word_counts(rows).select(F.col("doc").alias("wdoc"), F.col("u").alias("wu"), F.col("v").alias("wv"), "words", "kinds")
    out = narrow.join(counts, same("doc", "wdoc") & (F.col("u") == F.col("wu")) & (F.col("v") == F.col("wv")), "left")
    out = out.join(first, same("doc", "fdoc") & (F.col("u") == F.col("fu")) & (F.col("v") == F.col("fv")), "left")
    failed = [F.col("words") < LEAST_WORDS, 100 * F.col("kinds") < DISTINCT_PERCENT * F.col("words"), F.col("c"), F.col("d"), F.col("fu").isNull()]
    return out.select("doc", "part", "copies", sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0)).alias("mask"))


def conditional_counts(flagged: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """part, and n, good, toxic: for each of the 32 masks the documents, the good and the toxic ones of the part."""
    known = labels.select(labels[f"`{key}`"].alias("ldoc"), (labels["quality"] == 1).alias("good"), (labels["toxic"] == 1).alias("toxic")).where("ldoc is not null")
    known = known.groupBy("ldoc").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    rows = flagged.join(known, F.col("doc") == F.col("ldoc"), "left")
    count = lambda m, which: F.sum(F.when((F.col("mask") == m) & which, F.col("copies")).otherwise(0))
    kinds = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    wide = rows.groupBy("part").agg(*[count(m, which).alias(f"{k}{m}") for k, which in kinds.items() for m in range(MASKS)])
    return wide.select("part", *[F.array(*[F.col(f"{k}{m}") for m in range(MASKS)]).alias(k) for k in kinds])


def total(counts: str, which, weight=lambda m: F.lit(1)) -> Column:
    """The sum of an array of counts over the masks for which `which` holds, weighted."""
    return F.aggregate(F.filter(F.sequence(F.lit(0), F.lit(MASKS - 1)), which), F.lit(0).cast("long"), lambda a, m: a + F.get(counts, m) * weight(m))


def interactions(counts: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of `conditional_counts`."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    steps = [(order, k, sum(bit[f] for f in order[: k - 1]), bit[order[k - 1]]) for order in map("".join, permutations(FILTERS)) for k in range(1, len(FILTERS) + 1)]
    made = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(p).alias("prior"), F.lit(b).alias("own")) for o, k, p, b in steps])
    rows = counts.select("part", "n", "good", "toxic", F.explode(made).alias("s")).select("part", "n", "good", "toxic", "s.*")
    holds = lambda m, c: m.bitwiseAND(F.col(c)) != 0
    removed = lambda m: holds(m, "own") & ~holds(m, "prior")
    # of the orders of a mask's filters, a share of 1 / (filters that it fails) has this one first
    share = total("n", lambda m: holds(m, "own"), lambda m: (F.lit(len(steps) // len(FILTERS)) / F.bit_count(m)).cast("long"))
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: ~holds(m, "own") & ~holds(m, "prior")).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: holds(m, "own") & holds(m, "prior")).alias("redundant"),
        total("n", lambda m: m == F.col("own")).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        share.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """The interactions of the five filters over docs, for each part."""
    return interactions(conditional_counts(flags(docs, text, key, part), labels, key))

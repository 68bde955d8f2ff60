"""One search over several kinds of items: text and vector branches, fusion by typed keys, boosts, removal of repeats, context."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalar import quality_multiplier
from tessera.functions.text import tokens as words_of
from tessera.operators import fusion, vectors
from tessera.operators.index import Index
from tessera.operators.search import EXACT, SEMANTIC, expand_query, ranked

WEIGHTS = {"exact": (1.5, 0.5), "semantic": (0.5, 1.5), "mixed": (1.0, 1.0)}


def classify(query: str) -> str:
    """exact, semantic or mixed, of a query at hand; `search.classify_query` is the same for a column."""
    words = len(re.split(r"\s+", query))
    exact = sum(2 for p in EXACT if re.search(p, query)) + (words <= 2)
    semantic = sum(2 for p in SEMANTIC if re.search(p, query)) + (words >= 6)
    share = exact / (exact + semantic) if exact + semantic else 0.5
    return "exact" if share > 0.7 else "semantic" if share < 0.3 else "mixed"


@dataclass
class Kind:
    """A kind of items (chunks, image descriptions, extractions): its index, and its rows with `item` as the index has it, `document`, `text` and whatever else results should show."""

    index: Index
    items: DataFrame


@dataclass
class Engine:
    """kinds by name; vectors: (kind, item, embedding); quality: (document, quality) or (item, quality); repeated: (document, text) of header and footer lines."""

    kinds: dict[str, Kind]
    vectors: DataFrame | None = None
    quality: DataFrame | None = None
    repeated: DataFrame | None = None
    synonyms: dict[str, list[str]] = field(default_factory=dict)

    def text(self, query: str, limit: int, skip: tuple[str, ...] = ()) -> DataFrame:
        """dedup_key, kind, item, score, rank over the kinds that are not skipped."""
        merged = None
        for name, kind in self.kinds.items():
            if name in skip:
                continue
            one = kind.index.search(query, limit).select(F.lit(name).alias("kind"), F.col(kind.index.key).cast("long").alias("item"), "score")
            merged = one if merged is None else merged.unionByName(one)
        return ranked(merged.withColumn("dedup_key", typed_key()), "dedup_key", "score", limit)

    def nearest(self, vector: Column, limit: int, least: float, skip: tuple[str, ...] = ()) -> DataFrame:
        own = self.vectors.where(~F.col("kind").isin(*skip)) if skip else self.vectors
        near = vectors.top(own.withColumn("dedup_key", typed_key()), "dedup_key", "embedding", vector, limit, least)
        return ranked(near.select("dedup_key", "kind", "item", "score"), "dedup_key", "score", limit)

    def fused(self, query: str, vector: Column | None, fetch: int, mode: str, least: float, skip: tuple[str, ...], expand: bool, weights: tuple[float, float] | None) -> DataFrame:
        """dedup_key, score: both branches, each with its best `fetch`, in one plan."""
        words = expand_query(query, self.synonyms) if expand and self.synonyms else query
        lists = []
        a, b = weights or WEIGHTS[classify(query)]
        if mode in ("keyword", "hybrid"):
            lists.append((self.text(words, fetch, skip), a))
        if vector is not None and mode in ("semantic", "hybrid"):
            lists.append((self.nearest(vector, fetch, least, skip), b))
        if not lists:
            raise ValueError(f"no branch for mode {mode!r}")
        return fuse(lists, "dedup_key")

    def hits(self, fused: DataFrame) -> DataFrame:
        """The rows of fused keys, with all that their kinds show (null where a kind has no such column), weighted by quality, without header and footer lines."""
        rows = None
        for name, kind in self.kinds.items():
            one = kind.items.withColumns({"kind": F.lit(name), "item": F.col("item").cast("long")})
            rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
        # a result list: its rows are at most what the branches fetch
        hits = rows.withColumn("dedup_key", typed_key()).join(F.broadcast(fused), "dedup_key")
        if self.quality is not None:
            by = "item" if "item" in self.quality.columns else "document"
            hits = hits.join(self.quality, by, "left").withColumn("score", F.col("score") * quality_multiplier(F.col("quality"))).drop("quality")
        if self.repeated is not None:
            lines = self.repeated.select("document", F.lower(F.trim("text")).alias("_line"))
            hits = hits.withColumn("_line", F.lower(F.trim("text"))).join(lines, ["document", "_line"], "left_anti").drop("_line")
        return hits.withColumn("_order", F.struct(F.negative("score").alias("s"), "dedup_key"))

    def search(self, query: str, vector: Column | None = None, limit: int = 10, mode: str = "hybrid", least: float = 0.0, chunk_filters: bool = False, per_document: int = 3, expand: bool = True, weights: tuple[float, float] | None = None) -> DataFrame:
        """dedup_key, kind, item, document, text, score, rank.

        Each branch fetches twice the limit. Filters that only chunks can meet
        leave the other kinds out when the plan is made. The words are expanded
        by synonyms; branches are weighted by the class of the query, or as
        given; quality weights what is fused; texts that repeat a header or
        footer line, copies and more than `per_document` of one document go.
        """
        skip = tuple(k for k in self.kinds if k != "chunk") if chunk_filters else ()
        hits = self.hits(self.fused(query, vector, 2 * limit, mode, least, skip, expand, weights))
        hits = fusion.first_by_hash(hits.withColumn("_hash", F.sha2("text", 256)), "_hash", "_order")
        kept = fusion.diverse(hits, "document", "_order", per_document)
        return ranked(kept, "dedup_key", "score", limit).select("dedup_key", "kind", "item", "document", "text", "score", "rank")

    def rag(self, question: str, vector: Column | None = None, limit: int = 5, per_document: int = 3, tokens: int | None = None, expand: bool = True) -> DataFrame:
        """dedup_key, kind, item, document, text, score, rank, tokens of what answers a question.

        Three times the limit is fused from both branches with equal weights;
        of hits of a document that overlap by more than half (items with `start`
        and `end`) the better one stays, then `per_document` of each document,
        then the limit; then hits in rank order while their tokens together are
        within a budget (the first always stays).
        """
        fused = ranked(self.fused(question, vector, 3 * limit, "hybrid", 0.0, (), expand, (1.0, 1.0)), "dedup_key", "score", 3 * limit).drop("rank")
        hits = self.hits(fused)
        if {"start", "end"} <= set(hits.columns):
            hits = without_overlaps(hits)
        kept = ranked(fusion.diverse(hits, "document", "_order", per_document), "dedup_key", "score", limit)
        kept = kept.withColumn("tokens", F.size(words_of("text")))
        if tokens is not None:
            # at most `limit` rows
            total = F.sum("tokens").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
            kept = kept.withColumn("_total", total).where((F.col("_total") <= tokens) | (F.col("rank") == 1))
        return kept.select("dedup_key", "kind", "item", "document", "text", "score", "rank", "tokens")


def without_overlaps(hits: DataFrame, share: float = 0.5) -> DataFrame:
    """Hits (document, start, end, _order) without those that share more than `share` of the shorter span with a better one that stays: a fold over each document's hits in order, on a result list."""
    shared = lambda a, b: F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"])
    shorter = lambda a, b: F.greatest(F.lit(1), F.least(a["end"] - a["start"], b["end"] - b["start"]))
    add = lambda kept, x: F.when(F.exists(kept, lambda k: shared(k, x) > share * shorter(k, x)), kept).otherwise(F.array_append(kept, x))
    placed = hits.where(F.col("start").isNotNull() & F.col("end").isNotNull())
    spans = placed.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("_order", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))).alias("own"))
    kept = spans.select("document", F.explode(F.aggregate("own", F.filter("own", lambda x: F.lit(False)), add)).alias("k")).select("document", F.col("k._order.dedup_key").alias("dedup_key"))
    good = placed.join(kept, ["document", "dedup_key"], "left_semi")
    return good.unionByName(hits.where(F.col("start").isNull() | F.col("end").isNull()))


def context_of(hits: DataFrame, title: Column, most: int) -> DataFrame:
    """context, results: the hits (rank, score, text) in rank order as one markdown text, cut at `most` characters."""
    line = F.concat(F.lit("### Result "), F.col("rank").cast("string"), F.lit(" (Score: "), F.round("score", 3).cast("string"), F.lit(")\n**Source:** "), title, F.lit("\n> "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n> ")), F.lit("\n"))
    rows = hits.agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("all"))
    found = F.concat(F.lit("## Relevant Document Excerpts\n\n"), F.array_join(F.transform("all", lambda x: x["line"]), "\n"))
    text = F.when(F.size("all") == 0, "## Relevant Document Excerpts\n\nNo relevant documents found for the given question.").otherwise(found)
    return rows.select(F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text).alias("context"), F.size("all").cast("long").alias("results"))


def typed_key() -> Column:
    return F.concat("kind", F.lit(":"), F.col("item").cast("string"))


def fuse(lists: list[tuple[DataFrame, float]], key: str, k: int = 60) -> DataFrame:
    """key, score: reciprocal rank fusion of any number of weighted lists."""
    every = None
    for df, weight in lists:
        one = df.select(key, (F.lit(weight) / (k + F.col("rank"))).alias("part"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy(key).agg(F.sum("part").alias("score"))


def compact(results: DataFrame, mode: str) -> DataFrame:
    """The columns a short answer has; the score is named after the mode."""
    name = {"keyword": "bm25_score", "semantic": "similarity_score", "hybrid": "rrf_score"}[mode]
    shown = [c for c in ("rank", "document", "kind", "item", "page_number", "text") if c in results.columns]
    return results.select(*shown, F.col("score").alias(name))


def truncated(results: DataFrame, rank: str, text: str, most: int) -> DataFrame:
    """Results in rank order while their texts together have at most `most` bytes (the first always stays). A result list is short, so one window orders it."""
    total = F.sum(F.octet_length(text)).over(Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    return results.withColumn("_total", total).where((F.col("_total") <= most) | (F.col(rank) == 1)).drop("_total")

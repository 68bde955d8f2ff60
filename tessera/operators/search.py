"""Ranked full-text search: BM25 with a boolean query language, phrases, filters, quality weighting."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalar import quality_multiplier
from tessera.functions.text import matches, parse_query, query_terms, stem_word, stemmed_tokens, tokens

K1, B, FLOOR = 1.2, 0.75, 1e-6
#: Words that a worker remembers while it looks for a query's.
KNOWN = 1 << 16

# Patterns of query classification.
EXACT = (r"""^["'].*["']$""", r"\b[A-Z]{2,}-\d+\b", r"\b\d{4}-\d{2}-\d{2}\b", r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", r"\b\d{3,}\b", r"[@#$%]\w+")
SEMANTIC = (r"(?i)\b(about|regarding|related to|similar to|like|concerning)\b", r"(?i)\b(what|how|why|when|where|who)\b", r"(?i)\b(documents?|files?|papers?|records?) (about|on|regarding)\b")
TABLE = (r"(?i)\b(table|tables|tabular)\b", r"(?i)\b(column|columns|row|rows|cell|cells)\b", r"(?i)\b(spreadsheet|grid|matrix)\b", r"(?i)\b(header|headers)\s+(of|in|from)\b")


def analyzed(docs: DataFrame, key: str, text: str | Column, stem: bool = True) -> DataFrame:
    """key and the tokens of its text: folded and stemmed, or (stem=False) as they are. For repeated searches write an `index.Index` instead."""
    return docs.select(key, (stemmed_tokens(text if isinstance(text, Column) else F.col(text)) if stem else tokens(text)).alias("tokens"))


def postings(analyzed_docs: DataFrame, key: str) -> DataFrame:
    """key, term, tf, doc_len: the inverted index, to be written partitioned by term for repeated searches."""
    sized = analyzed_docs.select(key, F.size("tokens").alias("doc_len"), F.explode("tokens").alias("term"))
    return sized.groupBy(key, "term", "doc_len").agg(F.count("*").alias("tf"))


def occurrences(own: str, word: str) -> Column:
    """How often a word stands in an array."""
    return F.size(F.filter(own, lambda t: t == F.lit(word)))


def idf_of(n: Column, df: Column) -> Column:
    idf = F.ln((n - df + 0.5) / (df + 0.5))
    return F.when(idf <= 0, F.lit(FLOOR)).otherwise(idf)


def term_score(idf: Column, tf: Column, doc_len: Column, mean: Column) -> Column:
    """A term's part of a score, worked out from left to right as the SQL twins do, so that both round alike."""
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * doc_len / mean))


def bm25(analyzed_docs: DataFrame, key: str, query: str, phrase: bool = False, stem: bool = True) -> DataFrame:
    """key, score of each row that satisfies the query. Corpus statistics are one row (a scalar subquery); rows are scored where they lie. stem: as the rows were analyzed."""
    word = stem_word if stem else str.lower
    if phrase:
        words = [word(w) for w in re.findall(r"[^\W_]+", query.lower())]
        if not words:
            raise ValueError("the query has no words")
    parsed = [[("", words)]] if phrase else parse_query(query, word)
    terms = query_terms(parsed)
    counted = analyzed_docs.select("*", F.size("tokens").alias("doc_len"), *[occurrences("tokens", w).alias(f"tf_{i}") for i, w in enumerate(terms)])
    stats = counted.agg(F.struct(F.count("*").alias("n"), F.avg("doc_len").alias("mean"), *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(terms))])).toDF("s").scalar()
    found = counted.where(matches(parsed, F.col("tokens"))).withColumn("s", stats)
    score = F.lit(0.0)
    for i in range(len(terms)):
        score = score + term_score(idf_of(F.col("s.n"), F.col(f"s.df_{i}")), F.col(f"tf_{i}"), F.col("doc_len"), F.col("s.mean"))
    return found.select(key, score.alias("score"))


def found_terms(parsed: list[list[tuple[str, list[str]]]], scored: list[str]):
    """A pandas UDF of a text: its tokens, 1 if it satisfies the query or else 0, and how often it has each of the scored terms. Words are looked up as they are; of a text only the places of the query's words are kept."""
    every = sorted({w for a in parsed for _, own in a for w in own})
    place = {w: i for i, w in enumerate(every)}
    shown = [place[w] for w in scored]
    clauses = [[(sign, [place[w] for w in own]) for sign, own in a] for a in parsed]
    known: dict[str, int] = {}
    # folding and stemming leave an ASCII letter or digit at the start of a word as it is
    firsts = {w[0] for w in every}

    def has(at: list[list[int]], words: list[int]) -> bool:
        if not all(at[w] for w in words):
            return False
        others = [set(at[w]) for w in words[1:]]
        return any(all(p + i + 1 in x for i, x in enumerate(others)) for p in at[words[0]])

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(text: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[int]:
            at: list[list[int]] = [[] for _ in every]
            words = re.findall(r"[^\W_]+", (t or "").lower())
            for i, w in enumerate(words):
                if w[0] not in firsts and w[0].isascii():
                    continue
                k = known.get(w)
                if k is None:
                    if len(known) >= KNOWN:
                        known.clear()
                    k = known[w] = place.get(stem_word(w), -1)
                if k >= 0:
                    at[k].append(i)
            ok = any(all(has(at, own) != bool(sign) for sign, own in a) for a in clauses)
            return [len(words), int(ok), *(len(at[k]) for k in shown)]

        return text.map(one)

    return run


def bm25_texts(docs: DataFrame, key: str, text: str | Column, query: str, phrase: bool = False) -> DataFrame:
    """The same as `bm25` over stemmed tokens, of texts where they lie: of each text only counts leave the worker."""
    if phrase:
        words = [stem_word(w) for w in re.findall(r"[^\W_]+", query.lower())]
        if not words:
            raise ValueError("the query has no words")
    parsed = [[("", words)]] if phrase else parse_query(query, stem_word)
    # parts are added in the order of the query's words: sums of three or more round by their order
    terms = list(dict.fromkeys(w for a in parsed for s, own in a if not s for w in own))
    own = found_terms(parsed, terms)(text if isinstance(text, Column) else F.col(text))
    counted = docs.select(key, own.alias("_f"))
    tf = lambda i: F.get("_f", F.lit(i + 2))
    stats = counted.agg(F.struct(F.count("*").alias("n"), F.avg(F.get("_f", F.lit(0))).alias("mean"), *[F.count_if(tf(i) > 0).alias(f"df_{i}") for i in range(len(terms))])).toDF("s").scalar()
    found = counted.where(F.get("_f", F.lit(1)) == 1).withColumn("s", stats)
    score = F.lit(0.0)
    for i in range(len(terms)):
        score = score + term_score(idf_of(F.col("s.n"), F.col(f"s.df_{i}")), tf(i), F.get("_f", F.lit(0)), F.col("s.mean"))
    return found.select(key, score.alias("score"))


def weighted(scored: DataFrame, key: str, quality: DataFrame | None) -> DataFrame:
    if quality is None:
        return scored
    return scored.join(quality, key, "left").select(key, (F.col("score") * quality_multiplier(F.col("quality"))).alias("score"))


def ranked(scored: DataFrame, key: str, score: str, limit: int) -> DataFrame:
    """The best rows (ties by key) with their rank: a top-k, then ranks over those k."""
    best = scored.orderBy(F.desc(score), F.asc(key)).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.asc(key))).cast("long"))


def search(docs: DataFrame, key: str, text: str | Column, query: str, limit: int = 20, quality: DataFrame | None = None, phrase: bool = False) -> DataFrame:
    """key, score, rank. quality: (key, quality) with a score of 0 to 5, weighting results before they are ranked."""
    return ranked(weighted(bm25_texts(docs, key, text, query, phrase), key, quality), key, "score", limit)


def metadata_filter(docs: DataFrame, **contains: str) -> DataFrame:
    """Rows whose columns hold a substring, in either case."""
    for column, part in contains.items():
        docs = docs.where(F.contains(F.lower(column), F.lit(part.lower())))
    return docs


def quality_filter(docs: DataFrame, key: str, quality: DataFrame, least: float | None) -> DataFrame:
    """Rows of known quality of at least `least`; all rows where it is none or 0."""
    return docs if not least else docs.join(quality.where(F.col("quality") >= least).select(key), key, "left_semi")


def cluster_filter(docs: DataFrame, key: str, members: DataFrame, cluster: object) -> DataFrame:
    return docs.join(members.where(F.col("cluster") == cluster).select(key), key, "left_semi")


@dataclass
class ChunkFilter:
    """Predicates over chunks, all of which hold. content_types: any of them (every=False) or all."""

    content_types: tuple[str, ...] = ()
    every: bool = False
    section: str | None = None
    heading: str | None = None
    pages: tuple[int, int] | None = None
    atomic: bool | None = None
    levels: tuple[int, int] | None = None

    def column(self) -> Column:
        c = F.lit(True)
        if self.content_types:
            own = F.array(*map(F.lit, self.content_types))
            c = c & (F.size(F.array_except(own, "content_types")) == 0 if self.every else F.arrays_overlap("content_types", own))
        if self.section:
            c = c & F.startswith("section_path", F.lit(self.section))
        if self.heading:
            c = c & F.contains(F.lower("heading"), F.lit(self.heading.lower()))
        if self.pages:
            c = c & F.col("page_number").between(*self.pages)
        if self.atomic is not None:
            c = c & (F.col("is_atomic") == self.atomic)
        if self.levels:
            c = c & F.col("heading_level").between(*self.levels)
        return c


def classify_query(query: str | Column) -> Column:
    """exact, semantic or mixed."""
    q = F.col(query) if isinstance(query, str) else query
    hits = lambda patterns: sum((F.when(F.rlike(q, F.lit(p)), 2).otherwise(0) for p in patterns), F.lit(0))
    words = F.size(F.split(q, r"\s+"))
    exact = hits(EXACT) + F.when(words <= 2, 1).otherwise(0)
    semantic = hits(SEMANTIC) + F.when(words >= 6, 1).otherwise(0)
    share = exact / (exact + semantic)
    return F.when(exact + semantic == 0, "mixed").when(share > 0.7, "exact").when(share < 0.3, "semantic").otherwise("mixed")


def is_table_query(query: str | Column) -> Column:
    q = F.col(query) if isinstance(query, str) else query
    c = F.lit(False)
    for p in TABLE:
        c = c | F.rlike(q, F.lit(p))
    return c


def fusion_weights(kind: Column) -> tuple[Column, Column]:
    """Weights of text and vector search by the query's class."""
    return F.when(kind == "exact", 1.5).when(kind == "semantic", 0.5).otherwise(1.0), F.when(kind == "exact", 0.5).when(kind == "semantic", 1.5).otherwise(1.0)


def expand_query(query: str, synonyms: dict[str, list[str]], corpus: dict[str, list[str]] | None = None, columns: list[str] | None = None, limit: int = 20) -> str:
    """The words, their synonyms, terms of clusters and matching table columns: distinct, cleaned, the first `limit`, joined by OR."""
    words = query.lower().split()
    own = [*words, *(s for w in words for s in synonyms.get(w, [])), *(s for w in words for s in (corpus or {}).get(w, [])[:3])]
    own += [c for c in columns or [] if any(w in c.lower() or c.lower() in w for w in words)][:5]
    clean = [re.sub(r"""['"()*:^~+{}\[\]\;@<>#!$%&|,./`?-]""", "", w) for w in own]
    return " OR ".join(list(dict.fromkeys(w for w in clean if w and w not in ("AND", "OR", "NOT")))[:limit])


def explain_expansion(query: str, synonyms: dict[str, list[str]], corpus: dict[str, list[str]] | None = None, columns: list[str] | None = None) -> dict[str, object]:
    """What an expansion is made of: the words, what each source adds, and the query that comes out."""
    words = query.lower().split()
    return {
        "original": query,
        "synonyms": {w: synonyms[w] for w in words if synonyms.get(w)},
        "corpus_terms": {w: (corpus or {})[w][:3] for w in words if (corpus or {}).get(w)},
        "table_columns": [c for c in columns or [] if any(w in c.lower() or c.lower() in w for w in words)][:5],
        "expanded": expand_query(query, synonyms, corpus, columns),
    }


def cluster_terms(clusters: DataFrame, words: list[str], least: float = 0.3, per_word: int = 3) -> DataFrame:
    """word, terms: other top terms of coherent clusters that hold the word. clusters: (coherence, top_terms)."""
    each = clusters.where(F.col("coherence") > least).select("top_terms", F.explode(F.array(*map(F.lit, words))).alias("word")).where("array_contains(top_terms, word)")
    other = each.select("word", F.explode("top_terms").alias("term")).where("term != word").distinct()
    return other.groupBy("word").agg(F.slice(F.array_sort(F.collect_set("term")), 1, per_word).alias("terms"))


def across(results: dict[str, DataFrame], score: str, limit: int) -> DataFrame:
    """Results of several corpora: scores min-max normalised in each (1 where all are equal), merged, ranked, capped."""
    merged = None
    for name, df in results.items():
        df = df.withColumn("database_name", F.lit(name))
        merged = df if merged is None else merged.unionByName(df)
    own = Window.partitionBy("database_name")
    low, high = F.min(score).over(own), F.max(score).over(own)
    scaled = merged.withColumn("normalized_score", F.when(high == low, F.lit(1.0)).otherwise((F.col(score) - low) / (high - low)))
    return scaled.orderBy(F.desc("normalized_score"), "database_name", *[c for c in ("doc_id",) if c in scaled.columns]).limit(limit)


def overlap(results: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys that several result lists share, with the lists' names."""
    merged = None
    for name, df in results.items():
        df = df.select(key, F.lit(name).alias("database_name"))
        merged = df if merged is None else merged.unionByName(df)
    return merged.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("database_name")), ",").alias("databases"), F.count_distinct("database_name").alias("n")).where("n > 1")


def index_status(analyzed_docs: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """Rows, indexed rows, and whether the index is stale (a gap over a tenth)."""
    a = analyzed_docs.agg(F.count("*").alias("n_rows"))
    b = indexed.agg(F.count_distinct(key).alias("n_indexed"))
    return a.withColumn("n_indexed", b.scalar()).withColumn("stale", F.abs(F.col("n_rows") - F.col("n_indexed")) > 0.1 * F.col("n_rows"))

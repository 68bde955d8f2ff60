"""Vector search and similarity of documents."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import clamped_dot, cosine, dot, norm, quality_multiplier
from tessera.operators.iterate import bounded
from tessera.operators.pairs import similar

MOST = 100
#: Centroids that are compared with each other, or sent to every task.
CENTRES = 10_000


def top(vectors: DataFrame, key: str, vec: str, query: Column, limit: int, least: float = 0.0, quality: str | None = None) -> DataFrame:
    """key, distance, similarity, score: the 3 x limit nearest, then those within the threshold on raw distance, weighted by quality, then the best."""
    limit, least = max(1, min(MOST, limit)), max(0.0, min(1.0, least))
    near = vectors.withColumn("_q", query).withColumn("distance", 1 - cosine(F.col(vec), F.col("_q"))).drop("_q").orderBy("distance", key).limit(3 * limit)
    kept = near.where(F.col("distance") <= 1 - least).withColumn("similarity", 1 - F.col("distance"))
    weighted = kept.withColumn("score", F.col("similarity") * (quality_multiplier(F.col(quality)) if quality else F.lit(1.0)))
    return weighted.orderBy(F.desc("score"), key).limit(limit)


def adaptive(candidates: DataFrame, similarity: str, low: float = 0.15, high: float = 0.5) -> DataFrame:
    """Candidates at or above mean minus population deviation, clamped."""
    cut = candidates.agg(F.greatest(F.lit(low), F.least(F.lit(high), F.avg(similarity) - F.stddev_pop(similarity))).alias("cut")).scalar()
    return candidates.withColumn("threshold", cut).where(F.col(similarity) >= F.col("threshold"))


def summed(vectors: DataFrame, group: str, vec: str | Column) -> DataFrame:
    """group, n, mean (array): a vector a group and task goes through the exchange, not a row a number."""
    own = (F.col(vec) if isinstance(vec, str) else vec).cast("array<double>")
    return vectors.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), vector_to_array(Summarizer.mean(array_to_vector(own))).alias("mean"))


def centroids(vectors: DataFrame, group: str, vec: str) -> DataFrame:
    """group, n, centroid: element-wise means, scaled to unit length."""
    mean = summed(vectors, group, vec)
    size = norm(F.col("mean"))
    return mean.select(group, "n", F.when(size > 0, F.transform("mean", lambda x: x / size)).otherwise(F.col("mean")).alias("centroid"))


def similar_groups(vectors: DataFrame, group: str, vec: str, centre: DataFrame, target: object, limit: int, least: float) -> DataFrame:
    """Groups by the mean similarity of their vectors among the nearest to a group's centroid."""
    own = centre.where(F.col(group) == target).select("centroid").scalar()
    near = vectors.where(F.col(group) != target).withColumn("_q", own).withColumn("similarity", cosine(F.col(vec), F.col("_q"))).orderBy(F.desc("similarity"), "vec_id").limit(min(MOST, 10 * limit))
    return near.groupBy(group).agg(F.avg("similarity").alias("avg_similarity"), F.count("*").alias("n")).where(F.col("avg_similarity") >= least).orderBy(F.desc("avg_similarity"), group).limit(limit)


def pairs(centre: DataFrame, key: str, vec: str, least: float, known: DataFrame | None = None) -> DataFrame:
    """a, b, similarity: pairs at `least` or more, without those in known (a, b). Above 0 any number of vectors (`pairs.similar`); at 0 every pair qualifies, so at most `CENTRES` of them, which is checked."""
    if least > 0:
        out = similar(centre, key, vec, least)
    else:
        out = matrix(centre, key, vec).where((F.col("a") < F.col("b")) & (F.col("similarity") >= least))
    if known is not None:
        out = out.join(known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")
    return out


def matrix(centre: DataFrame, key: str, vec: str) -> DataFrame:
    """a, b, similarity for every pair of centroids, both ways and with itself; bounded like `pairs`."""
    centre = bounded(centre.select(key, vec), CENTRES, "centroids")
    a, b = centre.select(F.col(key).alias("a"), F.col(vec).alias("va")), centre.select(F.col(key).alias("b"), F.col(vec).alias("vb"))
    return a.join(b, F.lit(True)).select("a", "b", clamped_dot(F.col("va"), F.col("vb")).alias("similarity"))


def assign(vectors: DataFrame, key: str, vec: str, centre: DataFrame, group: str) -> DataFrame:
    """key, the nearest centroid and its similarity. Centroids are one row (an array), so each vector is compared where it lies."""
    own = bounded(centre.select(group, "centroid"), CENTRES, "centroids").agg(F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), F.col("centroid").alias("c")))).alias("all")).scalar()
    each = vectors.withColumn("all", own).select(key, F.transform("all", lambda x: F.struct(clamped_dot(F.col(vec), x["c"]).alias("s"), (-x["g"]).alias("g"))).alias("t"))
    return each.select(key, (-F.array_max("t")["g"]).alias("cluster"), F.array_max("t")["s"].alias("similarity"))


def coherence(vectors: DataFrame, group: str, vec: str) -> DataFrame:
    """Mean pairwise cosine in each group, from the length of the sum of unit vectors; 1 for a single member."""
    unit = F.transform(vec, lambda x: x.cast("double") / F.greatest(norm(F.col(vec)), F.lit(1e-12)))
    out = summed(vectors, group, unit).select(group, "n", (F.col("n") * F.col("n") * dot(F.col("mean"), F.col("mean"))).alias("q"))
    return out.select(group, "n", F.when(F.col("n") < 2, F.lit(1.0)).otherwise((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("coherence"))


def silhouette(vectors: DataFrame, group: str, vec: str) -> DataFrame:
    """Mean cosine silhouette over vectors of unit length, from the groups' sums: a mean distance to a group is 1 - x.S / n, so no pair is formed. At most `CENTRES` groups."""
    rows = bounded(summed(vectors, group, vec), CENTRES, "groups").select(group, "n", F.transform("mean", lambda x: x * F.col("n")).alias("s"))
    all_groups = rows.agg(F.collect_list(F.struct(F.col(group).alias("g"), "n", "s")).alias("a")).scalar()
    own = F.filter("a", lambda x: x["g"] == F.col(group))[0]
    inside = F.when(own["n"] > 1, (own["n"] - dot(F.col(vec), own["s"]) - (1 - dot(F.col(vec), F.col(vec)))) / (own["n"] - 1))
    outside = F.array_min(F.transform(F.filter("a", lambda x: x["g"] != F.col(group)), lambda x: 1 - dot(F.col(vec), x["s"]) / x["n"]))
    score = F.when(own["n"] == 1, 0.0).otherwise((F.col("o") - F.col("i")) / F.greatest("o", "i"))
    return vectors.withColumn("a", all_groups).withColumn("i", inside).withColumn("o", outside).agg(F.coalesce(F.avg(score), F.lit(0.0)).alias("silhouette"))

"""Scalar expressions: quality, vectors, time buckets, hashes, cursors."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def quality_multiplier(score: Column) -> Column:
    """0.8 to 1 for a quality of 0 to 5; 0.9 where it is unknown."""
    return F.when(score.isNull(), F.lit(0.9)).otherwise(0.8 + 0.04 * F.greatest(F.lit(0.0), F.least(F.lit(5.0), score.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """True cosine; 0 for a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def clamped_dot(a: Column, b: Column) -> Column:
    """Similarity of unit vectors, negatives as 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b)))


def vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def bucket(ts: str | Column, unit: str) -> Column:
    """Calendar bucket as text: hour, day, week (weeks begin on Monday, days before the first are week 00) or month."""
    c = ts if isinstance(ts, Column) else F.col(ts)
    if unit == "week":
        week = F.floor((F.dayofyear(c) + 6 - F.weekday(c)) / 7)
        return F.concat(F.date_format(c, "yyyy"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))
    form = {"hour": "yyyy-MM-dd HH:00", "day": "yyyy-MM-dd", "month": "yyyy-MM"}
    if unit not in form:
        raise ValueError(f"no bucket {unit!r}")
    return F.date_format(c, form[unit])


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def slug_agent(processor: str) -> Column:
    return F.regexp_replace(F.lower(processor), r"[^a-z0-9_-]+", "_")


def chain_hash(content: Column, parent: Column) -> Column:
    """Hash of the content hash and the parent's chain hash, or of the content hash alone at a root."""
    return F.sha2(F.when(parent.isNull(), content).otherwise(F.concat(content, F.lit(":"), parent)), 256)


def encode_cursor(created_at: str, key: str) -> str:
    return base64.urlsafe_b64encode(json.dumps({"created_at": created_at, "id": key}).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[str, str]:
    try:
        x = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        return x["created_at"], x["id"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("not a cursor") from e


def block_confidence(types: Column, known: dict[str, float], other: float = 0.7) -> Column:
    """Mean confidence of a chunk's block types."""
    table = F.create_map(*[F.lit(x) for p in known.items() for x in p]) if known else None
    each = F.transform(types, lambda t: F.coalesce(table[t], F.lit(other))) if known else F.transform(types, lambda t: F.lit(other))
    return F.when(F.size(types) > 0, F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.size(types)).otherwise(F.lit(other))


def aspect_score(width: Column, height: Column, extreme: float = 3.5) -> Column:
    """1 up to 2:1, falling to 0.5 at the extreme ratio, then 0.1 less a unit, 0.1 at least."""
    ratio = F.greatest(width, height) / F.greatest(F.lit(1), F.least(width, height))
    return F.when(ratio <= 2, F.lit(1.0)).when(ratio <= extreme, 1 - 0.5 * (ratio - 2) / (extreme - 2)).otherwise(F.greatest(F.lit(0.1), 0.5 - 0.1 * (ratio - extreme)))


def size_score(width: Column, height: Column) -> Column:
    pixels = width.cast("long") * height
    return F.when(pixels < 50**2, F.lit(0.0)).when(pixels < 100**2, F.lit(0.2)).when(pixels < 200**2, F.lit(0.4)).when(pixels < 400**2, F.lit(0.7)).otherwise(F.lit(1.0))


def image_category(width: Column, height: Column, colors: Column, diversity: Column) -> Column:
    """Ordered rules: icon, logo, decorative, photo, chart, document, unknown."""
    most, ratio = F.greatest(width, height), F.greatest(width, height) / F.greatest(F.lit(1), F.least(width, height))
    return (
        F.when((most < 64) | ((colors < 8) & (most < 200)), "icon")
        .when((colors < 48) & (most < 400), "logo")
        .when(ratio > 6, "decorative")
        .when((diversity > 0.7) & (width.cast("long") * height > 200 * 200), "photo")
        .when((colors >= 48) & (colors < 256), F.when(ratio < 2, "chart").otherwise("document"))
        .when(colors >= 256, "photo")
        .otherwise("unknown")
    )


def color_diversity(colors: Column) -> Column:
    return F.when(colors <= 1, F.lit(0.0)).when(colors >= 256, F.lit(1.0)).otherwise(F.log2(colors) / 8)


def image_relevance(width: Column, height: Column, colors: Column) -> Column:
    """0.3 size, 0.2 aspect, 0.3 colours, 0.2 category."""
    d = color_diversity(colors)
    kind = image_category(width, height, colors, d)
    bonus = F.when(kind.isin("photo", "chart"), 1.0).when(kind == "document", 0.9).when(kind == "unknown", 0.5).when(kind == "logo", 0.2).otherwise(0.1)
    return 0.3 * size_score(width, height) + 0.2 * aspect_score(width, height) + 0.3 * d + 0.2 * bonus


def worth_describing(width: Column, height: Column, colors: Column) -> Column:
    """Is an image worth the model call?"""
    kind, relevance = image_category(width, height, colors, color_diversity(colors)), image_relevance(width, height, colors)
    return ~((F.greatest(width, height) < 50) | kind.isin("icon", "decorative") | ((kind == "logo") & (relevance < 0.4)) | (relevance < 0.35))

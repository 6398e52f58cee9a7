"""Similarities, scores and budget decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of topic, structure, body, entities and sources, and the score of a duplicate.
WEIGHTS = {"plan": (0.42, 0.23, 0.15, 0.20, 0.0), "article": (0.22, 0.20, 0.25, 0.23, 0.10)}
DUPLICATE = {"plan": 48, "article": 58}


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def clamp(x: Column, low: float = 0, high: float = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def overlap(a: Column, b: Column) -> Column:
    """Common elements over the smaller set; 0 if either is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    return overlap_of(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


def overlap_of(both: Column, n: Column, m: Column) -> Column:
    """The same from how many elements two sets share, and their sizes."""
    return F.coalesce(both / F.nullif(F.least(n, m), F.lit(0)), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either is empty."""
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)))


def jaccard_of(both: Column, n: Column, m: Column) -> Column:
    """The same for sets, from how many elements they share, and their sizes."""
    return F.when((n == 0) | (m == 0), 0.0).otherwise(both / F.nullif(n + m - both, F.lit(0)))


def novelty(topic: Column, structure: Column, body: Column, entities: Column, sources: Column, same_core: Column, stage: str) -> tuple[Column, Column]:
    """(score in hundredths, whether it is a duplicate)."""
    topic = F.greatest(topic, F.when(same_core, 0.95).otherwise(0.0))
    parts = zip((topic, structure, body, entities, sources), WEIGHTS[stage])
    score = half_up(100 * sum(((c * w) for c, w in parts), F.lit(0.0)))
    if stage == "plan":
        other = (topic >= 0.68) & (entities >= 0.42)
    else:
        other = ((entities >= 0.5) & (body >= 0.34) & (sources >= 0.6)) | ((topic >= 0.78) & (structure >= 0.45))
    return score, same_core | (score >= DUPLICATE[stage]) | other


def visual_scores(edge: Column, colour: Column, contrast: Column, occupied: Column) -> dict[str, Column]:
    """Scores of 0 to 100 from shares of edges, colour and occupied area, and contrast."""
    e, c, k, o = clamp(edge / 0.18 * 100), clamp(colour / 0.42 * 100), clamp(contrast / 72 * 100), clamp(occupied / 0.72 * 100)
    balance = clamp(100 - F.abs(occupied - 0.52) * 150)
    return {"richness": clamp(e * 0.55 + c * 0.2 + o * 0.25), "quality": clamp(k * 0.4 + balance * 0.35 + c * 0.25), "density": clamp(e * 0.7 + o * 0.3 - c * 0.18)}


def aspect(ratio: Column, tolerance: float = 0.025) -> Column:
    """The nearest of three shapes, if within the tolerance."""
    shapes = (("16:9", 16 / 9), ("4:3", 4 / 3), ("A4", 2**0.5))
    errors = F.array(*[F.struct(F.abs(ratio / v - 1).alias("e"), F.lit(n).alias("n")) for n, v in shapes])
    best = F.array_min(errors)
    return F.when(best["e"] <= tolerance, best["n"]).otherwise("other")


def budget(daily_calls: Column, monthly_calls: Column, daily_cost: Column, monthly_cost: Column, calls: Column, cost: Column, limits: tuple[int, int, float, float]) -> Column:
    """The first limit that the next calls would break; null if none."""
    n = F.greatest(F.lit(1), calls)
    return (
        F.when(daily_calls + n > limits[0], "daily_calls")
        .when(monthly_calls + n > limits[1], "monthly_calls")
        .when(daily_cost + cost > limits[2], "daily_cost")
        .when(monthly_cost + cost > limits[3], "monthly_cost")
    )

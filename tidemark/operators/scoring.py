"""Article quality: ten criteria in [0, 1], a weighted score, levels, strengths and weaknesses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Criteria with default weights, and levels with their lower bounds, worst first.
WEIGHTS = {"depth_of_reporting": 0.15, "originality_and_exclusivity": 0.10, "source_quality_and_transparency": 0.15, "accuracy_and_fact_checking_rigor": 0.15, "clarity_and_accessibility": 0.10,
           "balance_and_fairness": 0.10, "narrative_and_engagement": 0.05, "timeliness_and_relevance": 0.05, "ethical_considerations_and_sensitivity": 0.10, "rhetorical_quality_and_style": 0.05}
LEVELS = (("POOR", 0.0), ("FAIR", 0.4), ("AVERAGE", 0.6), ("GOOD", 0.75), ("EXCELLENT", 0.9))


def final_score(scores: dict[str, Column], weights: dict[str, float] = WEIGHTS, divisor: float = 10.0) -> Column:
    total = sum((scores[c] * w for c, w in weights.items()), F.lit(0.0))
    return F.round(total, 3) / divisor


def quality_level(score: Column) -> Column:
    level = F.lit(LEVELS[0][0])
    for name, bound in LEVELS[1:]:
        level = F.when(score >= bound, name).otherwise(level)
    return level


def level_index(level: Column) -> Column:
    return F.array_position(F.array(*(F.lit(n) for n, _ in LEVELS)), level) - 1


def breakdown(scores: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """An array of (criterion, score, weight, contribution) in the criteria's order."""
    return F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("criterion"), scores[c].alias("score"), F.lit(w).alias("weight"), (scores[c] * w).alias("contribution")) for i, (c, w) in enumerate(weights.items())))


def extremes(parts: Column, n: int, best: bool) -> Column:
    """Names of the n best or worst criteria, ties in the criteria's order."""
    keyed = F.transform(parts, lambda p: F.struct((-p["score"] if best else p["score"]).alias("s"), p["i"].alias("i"), p["criterion"].alias("c")))
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda p: p["c"])

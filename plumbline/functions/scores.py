"""Score normalising over a result list or for a single distance."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from plumbline.functions.text import let
from plumbline.functions.vectors import clamp01


def list_of(*keys: str) -> WindowSpec:
    """The whole result list of one query. Lists are top-k results, so they are short."""
    return Window.partitionBy(*keys)


def exact_mean(score: Column) -> Column:
    """Mean to the millionth, halves up, as an aggregate: the same for any order of the rows.

    Scores are added as whole billionths and divided once; nulls do not count.
    """
    return mean_of(exact_sum(score), F.count(score))


def exact_sum(score: Column) -> Column:
    """Sum in whole billionths, as an aggregate; sums of parts add up to the sum of all."""
    return F.sum(F.round(score * 1e9).cast("decimal(19,0)")).cast("decimal(34,0)")


def mean_of(total: Column, count: Column) -> Column:
    """Mean to the millionth, halves up, from a sum in whole billionths."""
    n = count.cast("decimal(20,0)")
    twice, step = total * 2 + n * 1000, n * 2000
    millionths = (twice - F.pmod(twice, step)) / step
    return F.when(n > 0, millionths.cast("double") / 1e6)


def minmax(score: Column, result_list: WindowSpec) -> Column:
    """Scale to [0, 1] over the list; a constant list gets 1 everywhere, a null score stays null."""
    lo, hi = F.min(score).over(result_list), F.max(score).over(result_list)
    return F.when(score.isNull(), None).when(hi == lo, F.lit(1.0)).otherwise(clamp01((score - lo) / (hi - lo)))


def minmax_array(scores: Column) -> Column:
    """R6 for scores held in one array."""

    def scale(lo: Column, hi: Column) -> Column:
        return F.transform(
            scores,
            lambda s: F.when(s.isNull(), None)
            .when(hi == lo, F.lit(1.0))
            .otherwise(clamp01((s - lo) / (hi - lo))),
        )

    return let(F.array_min(scores), lambda lo: let(F.array_max(scores), lambda hi: scale(lo, hi)))


def by_rank(rank: Column, size: Column) -> Column:
    """Rank 1 gets 1, rank n gets 1/n."""
    return clamp01(1.0 - (rank - 1) / size)


def by_distance(distance: Column, space: Column | str = "cosine") -> Column:
    """Cosine distances are halved, every other space is clamped as it is."""
    name = F.lit(space) if isinstance(space, str) else space
    return F.when(name == "cosine", clamp01(distance / 2.0)).otherwise(clamp01(distance))

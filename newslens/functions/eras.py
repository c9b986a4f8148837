"""Era arithmetic. An era is a half-open date range between two consecutive boundaries."""

from functools import reduce

from pyspark.sql import Column, functions as F

from newslens.dims import ERA_BOUNDARIES


def era_of(date: Column, boundaries=ERA_BOUNDARIES) -> Column:
    """Era index. Early dates fall in the first era, late and NULL dates in the last."""
    last = len(boundaries) - 2
    if last == 0:
        return F.lit(0)
    ladder = F.when(date < F.lit(boundaries[1]).cast("date"), 0)
    ladder = reduce(
        lambda acc, e: acc.when(date < F.lit(boundaries[e + 1]).cast("date"), e),
        range(1, last),
        ladder,
    )
    return ladder.otherwise(last)


def in_era(date: Column, era: int, boundaries=ERA_BOUNDARIES) -> Column:
    """True inside the era's own range; dates outside all eras match none."""
    return (date >= F.lit(boundaries[era]).cast("date")) & (
        date < F.lit(boundaries[era + 1]).cast("date")
    )


def era_rows(boundaries=ERA_BOUNDARIES, labels=None) -> Column:
    """All eras as an array of (era, start, end, label), to be inlined into rows."""
    n = len(boundaries) - 1
    labels = labels or [f"{boundaries[e][:4]} – {boundaries[e + 1][:4]}" for e in range(n)]
    return F.array(*[
        F.struct(
            F.lit(e).alias("era"),
            F.lit(boundaries[e]).cast("date").alias("start"),
            F.lit(boundaries[e + 1]).cast("date").alias("end"),
            F.lit(labels[e]).alias("label"),
        )
        for e in range(n)
    ])

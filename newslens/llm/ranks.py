"""Gapless row numbers without sorting all rows in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F


def ranked(
    df: DataFrame, group: list[str], key: list[str], name: str, total: str,
    salt: str = "", copies: str | None = None, dealt: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Add ``name``: 0, 1, 2, ... within ``group`` in the order of a hash of ``key``; ``total``: its rows.

    Rows are numbered within buckets of the hash, and each bucket begins where the counts of those
    before it end. A hot group spreads over all buckets; their number follows the session's shuffle
    partitions. The numbers depend on the rows alone. Null keys are values like others; rows with
    equal keys take neighbouring numbers, in any order. With ``copies`` a row stands for so many rows
    and gets the first of their numbers. ``dealt`` adds columns for every row of a bucket to the table of
    buckets, which has the ``group`` with ``_`` before each name, ``_at``, ``_start`` and ``_rows``; rows are not
    shuffled again for them. With it the group's columns must not be null.
    """
    buckets = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = df.withColumn("_hash", F.xxhash64(F.lit(salt), *[F.col(c) for c in key])).withColumn(
        "_bucket", F.pmod(F.shiftright("_hash", 8), F.lit(buckets)).cast("int")
    )
    weight = F.col(copies) if copies else F.lit(1).cast("long")
    counts = hashed.groupBy(*group, "_bucket").agg(F.sum(weight).alias("_rows"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(g).alias(f"_{g}") for g in group], F.col("_bucket").alias("_at"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
        F.sum("_rows").over(whole).alias(total), *([F.col("_rows")] if dealt else []),
    )
    if dealt:
        starts = dealt(starts)
    earlier = Window.partitionBy(*group, "_bucket").orderBy("_hash", *key).rowsBetween(Window.unboundedPreceding, -1)
    numbered = hashed.withColumn("_row", F.coalesce(F.sum(weight).over(earlier), F.lit(0)))
    same = F.col("_bucket") == F.col("_at")
    for g in group:
        same = same & (F.col(g) == F.col(f"_{g}") if dealt else F.col(g).eqNullSafe(F.col(f"_{g}")))
    return numbered.join(starts, same).withColumn(name, F.col("_start") + F.col("_row")).drop(
        "_hash", "_bucket", "_row", "_at", "_start", "_rows", *[f"_{g}" for g in group]
    )

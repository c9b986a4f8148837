"""The served queries over a stored cube and its topic lists."""

import datetime as dt
import re

from pyspark.sql import DataFrame, functions as F

from newslens.dims import ERA_BOUNDARIES
from newslens.operators import rankings, timeline, topics


def _iso(code: str) -> str:
    if not re.match(r"^[A-Za-z]{3}$", code or ""):
        raise ValueError(f"invalid country code: {code!r}")
    return code.upper()


def _day(date: str) -> dt.date:
    if not re.match(r"^\d{4}-\d{2}-\d{2}$", date or ""):
        raise ValueError(f"invalid date: {date!r}")
    return dt.date.fromisoformat(date)


def available_dates(cube: DataFrame) -> DataFrame:
    return cube.select("date").distinct().orderBy("date")


def sentiment_by_date(cube: DataFrame, date: str) -> DataFrame:
    return cube.filter(F.col("date") == F.lit(_day(date))).select(
        "country_iso3", "avg_tone", "article_count"
    )


def era_countries(cube: DataFrame, boundaries=ERA_BOUNDARIES) -> DataFrame:
    return rankings.era_countries(cube, boundaries).orderBy(
        "era", F.desc("article_count"), "country_iso3"
    )


def country_timeline(cube: DataFrame, iso: str) -> DataFrame:
    """One country's series; filled silent days stay, days before the first tone do not."""
    return (
        cube.filter((F.col("country_iso3") == _iso(iso)) & F.col("avg_tone").isNotNull())
        .select("date", "avg_tone", "article_count")
        .orderBy("date")
    )


def global_timeline(cube: DataFrame) -> DataFrame:
    return timeline.global_timeline(cube).orderBy("date")


def topic_words(
    ranked: DataFrame, iso: str | None = None, era: int | None = None, fallback=(), **blend
) -> DataFrame:
    """Word list of one bucket: a country or the whole world, an era or all time.

    ``fallback`` words of (text, size) stand in for an empty bucket.
    """
    scope = F.col("scope") == "global" if iso is None else (
        (F.col("scope") == "country") & (F.col("country_iso3") == _iso(iso))
    )
    bucket = F.col("bucket") == ("all" if era is None else str(era))
    words = topics.word_blend(ranked.filter(scope & bucket), **blend).select(
        "position", "text", "size"
    )
    if fallback:
        spare = ranked.sparkSession.createDataFrame(
            [(i + 1, text, size) for i, (text, size) in enumerate(fallback)],
            "position int, text string, size bigint",
        )
        # Both lists are a few dozen words; the spare rows stay only if there are no others.
        best = words.withColumn("_spare", F.lit(0)).unionByName(spare.withColumn("_spare", F.lit(1)))
        first = F.min("_spare").over(timeline.everything())
        words = best.withColumn("_first", first).filter(F.col("_spare") == F.col("_first")).drop(
            "_spare", "_first"
        )
    return words.orderBy("position")

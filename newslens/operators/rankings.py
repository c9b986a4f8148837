"""Country rankings over the cube. Every frame here has one row per country (and era)."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from newslens.dims import ERA_BOUNDARIES
from newslens.functions import tone
from newslens.functions.eras import era_of

MIN_VOLUME = 100  # smallest article count for a country to be ranked by tone


def era_countries(cube: DataFrame, boundaries=ERA_BOUNDARIES) -> DataFrame:
    """Volume-weighted tone and articles per era and country."""
    return (
        cube.filter(tone.covered())
        .groupBy(era_of(F.col("date"), boundaries).alias("era"), "country_iso3")
        .agg(tone.weighted_tone().alias("avg_tone"), tone.volume().alias("article_count"))
    )


def country_tone(cube: DataFrame) -> DataFrame:
    return (
        cube.filter(tone.covered())
        .groupBy("country_iso3")
        .agg(tone.weighted_tone().alias("avg_tone"), tone.volume().alias("article_count"))
    )


def country_share(cube: DataFrame, k: int = 30) -> DataFrame:
    """Top countries by articles, with their share of the shown total and of all articles.

    The mean tone divides by all articles of a country, also those of days without any tone.
    """
    total = F.sum("article_count")
    shown = (
        cube.filter(F.col("article_count") > 0)
        .groupBy("country_iso3")
        .agg(
            total.alias("total_articles"),
            (F.sum(F.col("avg_tone") * F.col("article_count")) / total).alias("mean_tone"),
        )
        .withColumn("_all", F.sum("total_articles").over(Window.partitionBy()))
        .orderBy(F.desc("total_articles"), "country_iso3")
        .limit(k)
    )
    return shown.withColumn(
        "pct", 100 * F.col("total_articles") / F.sum("total_articles").over(Window.partitionBy())
    ).withColumn("pct_of_all", 100 * F.col("total_articles") / F.col("_all")).drop("_all")


def headline(cube: DataFrame) -> DataFrame:
    """Total articles, countries, weighted tone and covered date range."""
    return cube.filter(tone.covered()).agg(
        tone.volume().alias("total_articles"),
        F.count_distinct("country_iso3").alias("countries"),
        tone.weighted_tone().alias("avg_tone"),
        F.concat_ws(" to ", F.min("date").cast("string"), F.max("date").cast("string")).alias("date_range"),
    )


def _two_ends(df: DataFrame, value: str, k: int, low: str, high: str, label: str) -> DataFrame:
    """The k lowest and the k highest rows; with few rows a country may be in both lists."""
    up = F.row_number().over(Window.orderBy(value, "country_iso3"))
    down = F.row_number().over(Window.orderBy(F.desc(value), "country_iso3"))
    ends = F.array(
        F.struct(F.lit(low).alias(label), up.alias("rank")),
        F.struct(F.lit(high).alias(label), down.alias("rank")),
    )
    return (
        df.withColumn("_ends", ends).select(*df.columns, F.inline("_ends")).filter(F.col("rank") <= k)
    )


def opinion_changers(
    cube: DataFrame,
    early_until: str = "2021-01-01",
    late_from: str = "2021-01-01",
    k: int = 10,
    min_volume: int = MIN_VOLUME,
) -> DataFrame:
    """Countries whose tone moved most between two periods.

    ``direction`` names the end of the ranking, not the sign: the best of a falling field is
    still ``improved``. A country needs ``min_volume`` articles in both periods.
    """
    early = F.col("date") < F.lit(early_until).cast("date")
    late = F.col("date") >= F.lit(late_from).cast("date")
    moved = (
        cube.groupBy("country_iso3")
        .agg(
            tone.weighted_tone(early).alias("early"),
            tone.weighted_tone(late).alias("late"),
            tone.volume(early).alias("_n_early"),
            tone.volume(late).alias("_n_late"),
        )
        .filter((F.col("_n_early") >= min_volume) & (F.col("_n_late") >= min_volume))
        .withColumn("delta", F.col("late") - F.col("early"))
        .drop("_n_early", "_n_late")
    )
    return _two_ends(moved, "delta", k, "worsened", "improved", "direction")


def pos_neg_countries(cube: DataFrame, k: int = 10, min_volume: int = MIN_VOLUME) -> DataFrame:
    """The most negative and the most positive countries with enough articles."""
    toned = country_tone(cube).filter(F.col("article_count") >= min_volume)
    return _two_ends(toned, "avg_tone", k, "most_negative", "most_positive", "side")


def union_scale(pos_neg: DataFrame, value: str = "avg_tone", floor: float = 0.5) -> DataFrame:
    """One bar scale for both lists: the largest absolute tone of their union, at least ``floor``."""
    positive = pos_neg.filter(F.col("side") == "most_positive").select(value)
    negative = pos_neg.filter(F.col("side") == "most_negative").select(value)
    return positive.unionAll(negative).agg(
        F.greatest(F.lit(floor), F.max(F.abs(value))).alias("scale")
    )


def _extremes(ranked: DataFrame, tie: Column) -> DataFrame:
    """Lowest and highest tone per era; ``tie`` orders countries of equal tone."""
    pick = F.struct("country_iso3", "avg_tone", "article_count")
    low = F.min_by(pick, F.struct(F.col("avg_tone"), tie))
    high = F.min_by(pick, F.struct(-F.col("avg_tone"), tie))
    return (
        ranked.groupBy("era")
        .agg(low.alias("low"), high.alias("high"))
        .select(
            "era",
            F.col("low.country_iso3").alias("most_negative"),
            F.col("low.avg_tone").alias("negative_tone"),
            F.col("high.country_iso3").alias("most_positive"),
            F.col("high.avg_tone").alias("positive_tone"),
        )
    )


def era_extremes_published(era_stats: DataFrame, min_volume: int = MIN_VOLUME) -> DataFrame:
    """Most negative and most positive country of each era among those with enough articles."""
    return _extremes(era_stats.filter(F.col("article_count") >= min_volume), F.col("country_iso3"))


def top_volume_per_era(era_stats: DataFrame, k: int) -> DataFrame:
    """The k countries with most articles per era."""
    by_volume = Window.partitionBy("era").orderBy(F.desc("article_count"), "country_iso3")
    return era_stats.withColumn("rank", F.row_number().over(by_volume)).filter(F.col("rank") <= k)


def era_extremes_topvol(era_stats: DataFrame, k: int = 40) -> DataFrame:
    """Extremes among the k largest countries of each era; the larger one wins a tie."""
    return _extremes(top_volume_per_era(era_stats, k), F.col("rank"))


def top8_by_tone(era_stats: DataFrame, k: int = 8) -> DataFrame:
    """The k largest countries of each era, from most negative to most positive."""
    by_tone = Window.partitionBy("era").orderBy("avg_tone", "rank")
    return (
        top_volume_per_era(era_stats, k)
        .withColumn("position", F.row_number().over(by_tone))
        .orderBy("era", "position")
    )


def top_k(df: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows of an order, without sorting the rest."""
    return df.orderBy(*order).limit(k)


def first_match(df: DataFrame, by, order) -> DataFrame:
    """The first row of each group; each task keeps one row per group before the shuffle."""
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_first", first).filter(F.col("_first") == 1).drop("_first")


def summary_document(
    cube: DataFrame,
    boundaries=ERA_BOUNDARIES,
    early_until: str = "2021-01-01",
    late_from: str = "2021-01-01",
    k: int = 10,
    min_volume: int = MIN_VOLUME,
) -> DataFrame:
    """Headline, opinion changers, extreme countries overall and per era as one nested row.

    Tones are rounded to two decimals. Pass a stored cube: each part reads it once.
    """

    def listed(df, item, *order):
        ranked = F.array_sort(F.collect_list(F.struct(*order, item.alias("item"))))
        return df.agg(F.transform(ranked, lambda x: x["item"])).scalar()

    def rounded(column):
        return F.round(column, 2)

    moved = opinion_changers(cube, early_until, late_from, k, min_volume)
    change = F.struct(
        F.col("country_iso3").alias("iso"), rounded("early").alias("early"),
        rounded("late").alias("late"), rounded("delta").alias("delta"), "direction",
    )
    # Worsened first, as published.
    worsened_first = F.when(F.col("direction") == "worsened", 0).otherwise(1).alias("end")
    ends = pos_neg_countries(cube, k, min_volume)
    place = F.struct(
        F.col("country_iso3").alias("iso"), rounded("avg_tone").alias("tone"),
        F.col("article_count").alias("articles"),
    )
    sides = [
        listed(ends.filter(F.col("side") == side), place, "rank").alias(side)
        for side in ("most_positive", "most_negative")
    ]
    extremes = era_extremes_published(era_countries(cube, boundaries), min_volume)
    pair = F.struct(*[
        F.struct(F.col(side).alias("iso"), rounded(value).alias("tone")).alias(side)
        for side, value in (("most_negative", "negative_tone"), ("most_positive", "positive_tone"))
    ])
    total = headline(cube).withColumn("avg_tone", rounded("avg_tone"))
    return cube.sparkSession.range(1).select(
        listed(moved, change, worsened_first, "rank").alias("opinion_changers"),
        F.struct(*sides).alias("pos_neg"),
        listed(extremes, pair, "era").alias("era_countries"),
        total.select(F.struct(*total.columns)).scalar().alias("headline"),
    )

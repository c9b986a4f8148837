"""The country x day sentiment cube."""

from pyspark.sql import DataFrame, Window, functions as F

from newslens.functions import tone

CUBE_KEYS = ["date", "country_iso3"]


def daily_country_sentiment(df: DataFrame, key: str = "DocumentIdentifier") -> DataFrame:
    """Mean tone and distinct articles per date and country; a NULL key is one more article.

    The distinct count first groups by (date, country, article), so one hot country-day is
    spread over many tasks and repeated articles collapse before the shuffle.
    """
    null_key = F.max(F.when(F.col(key).isNull(), 1).otherwise(0))
    return df.groupBy(*CUBE_KEYS).agg(
        F.avg("tone").alias("avg_tone"),
        (F.count_distinct(key) + null_key).cast("bigint").alias("article_count"),
    )


def date_country_spine(daily: DataFrame) -> DataFrame:
    """Every day of the observed range for every observed country.

    The range is taken over one row per country, so ``daily`` is computed once.
    """
    seen = daily.groupBy("country_iso3").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    countries = Window.partitionBy()
    days = F.sequence(F.min("first").over(countries), F.max("last").over(countries))
    return seen.select("country_iso3", days.alias("days")).select(
        F.explode("days").alias("date"), "country_iso3"
    )


def gap_join(spine: DataFrame, daily: DataFrame) -> DataFrame:
    """Put the observations on the spine; silent days get NULLs."""
    return spine.join(daily, CUBE_KEYS, "left")


def forward_fill(joined: DataFrame) -> DataFrame:
    """Last known tone per country, and 0 articles on silent days."""
    so_far = (
        Window.partitionBy("country_iso3").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    )
    return joined.select(
        *CUBE_KEYS,
        F.last("avg_tone", ignorenulls=True).over(so_far).alias("avg_tone"),
        F.coalesce("article_count", F.lit(0)).cast("bigint").alias("article_count"),
    )


def fill_gaps(daily: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Spine, gap join and forward fill in one pass over ``daily``.

    Each observation is expanded into the days up to the country's next one, so ``daily`` is
    computed once and shuffled once, by country. ``bounds`` is a one-row frame of the first and
    last day; by default it is taken from ``daily``, whose shuffle then serves both. Observations
    without a date are on no day of the spine.
    """
    daily = daily.filter(F.col("date").isNotNull())
    if bounds is None:
        # Both read the same shuffle by country: the range asks for whole rows, date first, since
        # with fewer columns it would be another plan, and nothing be shared.
        daily = daily.repartition("country_iso3")
        row = F.struct("date", *[c for c in daily.columns if c != "date"])
        bounds = daily.agg(F.min(row).alias("low"), F.max(row).alias("high")).select(
            F.col("low.date").alias("first"), F.col("high.date").alias("last")
        )
    bounds = bounds.select(F.struct("first", "last")).scalar()
    first, last = bounds["first"], bounds["last"]
    by_date = Window.partitionBy("country_iso3").orderBy("date")
    so_far = by_date.rowsBetween(Window.unboundedPreceding, 0)
    runs = daily.select(
        "country_iso3",
        F.col("date").alias("seen"),
        F.last("avg_tone", ignorenulls=True).over(so_far).alias("known"),
        "article_count",
        # The country's first run also covers the days before it; they stay without tone.
        F.when(F.row_number().over(by_date) == 1, first).otherwise(F.col("date")).alias("run_start"),
        F.coalesce(F.date_sub(F.lead("date").over(by_date), 1), last).alias("run_end"),
    )
    return runs.select(
        "*", F.explode(F.sequence("run_start", "run_end")).alias("date")
    ).select(
        *CUBE_KEYS,
        F.when(F.col("date") >= F.col("seen"), F.col("known")).alias("avg_tone"),
        F.when(F.col("date") == F.col("seen"), F.col("article_count"))
        .otherwise(F.lit(0))
        .cast("bigint")
        .alias("article_count"),
    )


def cube_profile(cube: DataFrame) -> DataFrame:
    return cube.agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count_distinct("country_iso3").alias("countries"),
        F.count("*").alias("total_rows"),
        F.sum("article_count").alias("total_articles"),
    )


def coverage_spread(cube: DataFrame) -> DataFrame:
    """Countries reached so far, for every date that brings new ones.

    The running sum sees at most one row per country.
    """
    first_seen = (
        cube.filter(tone.covered()).groupBy("country_iso3").agg(F.min("date").alias("date"))
    )
    return first_seen.groupBy("date").agg(F.count("*").alias("new_countries")).withColumn(
        "countries_reached",
        F.sum("new_countries").over(
            Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        ),
    )


def article_volume(df: DataFrame, *by: str, key: str = "DocumentIdentifier") -> DataFrame:
    """Rows and distinct articles per date, country or any other grain."""
    return df.groupBy(*by).agg(
        F.count("*").alias("records"), F.count_distinct(key).alias("articles")
    )


def tone_counts(df: DataFrame, low=-10.0, high=10.0, bins: int = 20, by=tuple(CUBE_KEYS)) -> DataFrame:
    """Histograms of article tone per day and country, as one row per bin that has any.

    They add up: those of days or countries together are the sums of their bins, and a new day adds rows of its
    own, so any period's distribution comes from stored counts without the articles. Bin 0 lies below the range and
    bin ``bins + 1`` above it.
    """
    bin_of = F.width_bucket("tone", F.lit(low), F.lit(high), F.lit(bins)).alias("bin")
    return df.filter(F.col("tone").isNotNull()).groupBy(*by, bin_of).agg(F.count("*").alias("records"))


def merged_tone_counts(counts: DataFrame, low=-10.0, high=10.0, bins: int = 20, by=()) -> DataFrame:
    """The distribution over all rows of ``counts``, or one for each value of ``by``; the bins must be those they were counted with."""
    added = counts.groupBy(*by, "bin").agg(F.sum("records").alias("records"))
    return added.withColumn("bin_low", F.lit(low) + (F.col("bin") - 1) * F.lit((high - low) / bins))


def tone_distribution(df: DataFrame, low=-10.0, high=10.0, bins: int = 20) -> DataFrame:
    """Histogram of article tone. Bin 0 lies below the range and bin ``bins + 1`` above it."""
    return merged_tone_counts(tone_counts(df, low, high, bins, by=()), low, high, bins)

"""Daily country sentiment kept up to date from arriving article files.

The daily aggregate of the coverage job, run incrementally: the same tones and counts for every day
that the watermark has closed. Days still open come from the batch aggregate. Forward filling stays
a batch step over both.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from newslens.functions import fields
from newslens.operators import coverage, filters, geo
from newslens.plans import jobs

DAILY = "date DATE, country_iso3 STRING, avg_tone DOUBLE, article_count BIGINT"


def daily_sentiment_stream(
    articles: DataFrame, lateness: str = "1 day", strict: bool = True
) -> DataFrame:
    """Mean tone and distinct articles per UTC day and country of a streaming article table.

    As in the batch, every record's tone counts, an identifier counts once per day and country, and
    records without one count as one more article. A first aggregate per (day, country, article)
    spreads a hot country-day; a second adds its rows up. A day is emitted once the watermark has
    passed its end; records later than that are left out. ``strict`` raises on malformed tones, as
    the batch does.
    """
    toned = (
        articles.withColumn("event_time", fields.packed_instant(F.col("DATE")))
        .withWatermark("event_time", lateness)
        .withColumn("tone", fields.first_tone(F.col("V2Tone"), strict=strict))
    )
    per_article = (
        filters.valid_country(geo.outlet_country(toned))
        .groupBy(F.window("event_time", "1 day").alias("day"), "country_iso3", "DocumentIdentifier")
        .agg(F.sum("tone").alias("tones"), F.count("tone").alias("toned"))
    )
    date = F.date_from_unix_date(F.floor(F.unix_seconds("day.start") / 86400).cast("int"))
    return (
        per_article.groupBy(F.window(F.window_time("day"), "1 day").alias("day"), "country_iso3")
        .agg(
            F.try_divide(F.sum("tones"), F.sum("toned")).alias("avg_tone"),
            F.count("*").alias("article_count"),
        )
        .select(date.alias("date"), "country_iso3", "avg_tone", "article_count")
    )


def run_available(
    spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str, strict: bool = True
) -> DataFrame:
    """Process the files that have arrived, append the closed days to the sink, and read it.

    The checkpoint folder must be shared storage; a restarted query continues from it.
    """
    arriving = spark.readStream.schema(schema).parquet(source)
    query = (
        daily_sentiment_stream(arriving, strict=strict)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(sink)
    )
    query.awaitTermination()
    return spark.read.schema(DAILY).parquet(sink)


def with_open_days(closed: DataFrame, articles: DataFrame) -> DataFrame:
    """The closed days and, by the batch aggregate, those after the last of them."""
    last = closed.agg(F.coalesce(F.max("date"), F.lit("0001-01-01").cast("date"))).scalar()
    recent = jobs.located_articles(articles).filter(F.col("date") > last)
    return closed.unionByName(coverage.daily_country_sentiment(recent))

"""Outlet geography and country labels."""

from pyspark.sql import DataFrame, Window, functions as F

from newslens import dims
from newslens.functions import fields, tone


def outlet_country(
    df: DataFrame,
    source: str = "SourceCommonName",
    tlds: DataFrame | None = None,
    outlets: DataFrame | None = None,
) -> DataFrame:
    """Add ``country_iso3``: the outlet's ccTLD decides, else the curated domain table, else NULL.

    The built-in tables have a fixed size (about 200 rows each) and are broadcast. Tables given
    as ``tlds(tld, iso3)`` or ``outlets(domain, iso3)`` carry no hint: Spark broadcasts them by
    measured size, and otherwise sort-merges with adaptive skew splitting.
    """
    spark = df.sparkSession
    if tlds is None:
        tlds = F.broadcast(dims.pairs_frame(spark, dims.country_tlds(), "tld", "iso3"))
    else:
        tlds = tlds.filter(~F.col("tld").isin(*dims.GENERIC_TLDS)).groupBy("tld").agg(F.min("iso3").alias("iso3"))
    if outlets is None:
        outlets = F.broadcast(dims.pairs_frame(spark, dims.curated_outlets(), "domain", "iso3"))
    else:
        outlets = outlets.groupBy("domain").agg(F.min("iso3").alias("iso3"))
    tlds = tlds.select(F.col("tld").alias("_tld"), F.col("iso3").alias("_tld_iso3"))
    outlets = outlets.select(F.col("domain").alias("_domain"), F.col("iso3").alias("_domain_iso3"))
    # The keys are columns of their own, so that cleaning a name is not repeated in each join.
    keyed = df.withColumns({
        "_name": fields.domain_name(F.col(source)), "_label": fields.domain_tld(F.col(source))
    })
    return (
        keyed.join(tlds, keyed["_label"] == tlds["_tld"], "left")
        .join(outlets, keyed["_name"] == outlets["_domain"], "left")
        .withColumn("country_iso3", F.coalesce("_tld_iso3", "_domain_iso3"))
        .drop("_name", "_label", "_tld", "_tld_iso3", "_domain", "_domain_iso3")
    )


def distinct_outlets(df: DataFrame, source: str = "SourceCommonName") -> DataFrame:
    return df.select(source).dropna().distinct()


def location_counts(
    df: DataFrame, column: str = "V2Locations", field: int = 3, key: str = "DocumentIdentifier"
) -> DataFrame:
    """Articles per country mentioned. Records are split at ``;`` and fields at ``#``.

    ``field`` is the position of the country code in the public V2 record layout.
    """
    record = F.explode(F.split(column, ";")).alias("record")
    return (
        df.select(key, record)
        .select(key, fields.trimmed(F.split_part("record", F.lit("#"), F.lit(field))).alias("country"))
        .filter(F.col("country") != "")
        .groupBy("country")
        .agg(F.count("*").alias("mentions"), F.count_distinct(key).alias("articles"))
    )


def country_label_join(df: DataFrame, names: DataFrame, iso: str = "country_iso3") -> DataFrame:
    """Add ``country_name``; a country without a name keeps its code."""
    names = names.select(F.col("iso3").alias("_iso3"), F.col("name").alias("_name"))
    return (
        df.join(names, F.col(iso) == F.col("_iso3"), "left")
        .withColumn("country_name", F.coalesce("_name", iso))
        .drop("_iso3", "_name")
    )


def map_frame_join(names: DataFrame, frame: DataFrame) -> DataFrame:
    """Every country of the map with the frame's coverage, or the no-coverage default."""
    # The frame's largest count, at least 1, over its one row per country.
    scaled = frame.withColumn("_largest", F.max("article_count").over(Window.partitionBy()))
    joined = names.join(scaled, names["iso3"] == scaled["country_iso3"], "left").select(
        "iso3",
        "name",
        "avg_tone",
        F.coalesce("article_count", F.lit(0)).cast("bigint").alias("article_count"),
        F.greatest(F.lit(1), F.coalesce("_largest", F.lit(1))).alias("_largest"),
    )
    return joined.select(
        "iso3", "name", "avg_tone", "article_count",
        tone.tone_intensity(F.col("avg_tone"), F.col("article_count")).alias("tone_intensity"),
        tone.volume_ratio(F.col("article_count"), F.col("_largest")).alias("volume_ratio"),
    )

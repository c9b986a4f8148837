"""The sentiment cube and the exported documents."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from newslens import dims, schemas
from newslens.operators.rankings import summary_document
from newslens.operators.topics import topics_document
from newslens.sources import storage

COUNTRY_NAMES = T.StructType([
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("properties", T.StructType([
            T.StructField("ADM0_A3", T.StringType()),
            T.StructField("NAME", T.StringType()),
        ])),
    ]))),
])


def read_coverage(spark: SparkSession, folder: str, dataset: str) -> DataFrame:
    """A stored cube by dataset name. Cache it if several queries follow."""
    return spark.read.schema(schemas.COVERAGE).parquet(storage.dataset_path(folder, dataset))


_GROUP_ROWS, _PAGE_ROWS = 20_000, 1_000
_CURVE_BITS = 8  # of the date, in units of a month, and of the country
_UNIT_DAYS = 32


def _curve(date: Column, country: Column) -> Column:
    """Place on a Z-order curve over months and country codes: neighbours on it are close in both."""
    unit = F.unix_date(date) + F.lit(1 << 20)  # no negative days
    unit = F.floor(unit / _UNIT_DAYS)
    # The code as a number below 256 that keeps the order of the codes.
    code = sum((F.greatest(F.lit(0), F.least(F.lit(25), F.ascii(F.substring(country, i + 1, 1)) - 65)) * 26 ** (2 - i) for i in range(3)), F.lit(0))
    code = F.floor(F.coalesce(code, F.lit(0)) * ((1 << _CURVE_BITS) / 26**3))

    def bit(number: Column, i: int) -> Column:
        return F.pmod(F.floor(number / (1 << i)), F.lit(2))

    high = F.floor(unit / (1 << _CURVE_BITS)) * (1 << 2 * _CURVE_BITS)
    return sum((bit(unit, i) * (1 << 2 * i + 1) + bit(code, i) * (1 << 2 * i) for i in range(_CURVE_BITS)), high)


def write_coverage(cube: DataFrame, folder: str, topic: str, start: str, end: str) -> str:
    """Store a cube as ``<topic>-<start>-<end>``, along a curve through dates and countries.

    Row groups and pages are small and hold a few months of a few countries, so a filter on a date and a filter on a
    country both skip most of them.
    """
    path = storage.dataset_path(folder, f"{storage.slug(topic)}-{start}-{end}")
    columns = [F.col(f.name).cast(f.dataType) for f in schemas.COVERAGE]
    (
        cube.select(*columns)
        .withColumn("_at", _curve(F.col("date"), F.col("country_iso3")))
        .repartitionByRange("_at", "country_iso3", "date")
        .sortWithinPartitions("_at", "country_iso3", "date")
        .drop("_at")
        .write.mode("overwrite")
        .option("compression", "snappy")
        .option("parquet.block.row.count.limit", _GROUP_ROWS)
        .option("parquet.page.row.count.limit", _PAGE_ROWS)
        .parquet(path)
    )
    return path


def write_tone_counts(counts: DataFrame, folder: str, topic: str, start: str, end: str) -> str:
    """Store histograms per day and country, laid out as the cube is."""
    path = storage.dataset_path(folder, f"{storage.slug(topic)}-{start}-{end}-tones")
    at = _curve(F.col("date"), F.col("country_iso3"))
    placed = counts.withColumn("_at", at).repartitionByRange("_at", "country_iso3", "date", "bin")
    placed.sortWithinPartitions("_at", "country_iso3", "date", "bin").drop("_at").write.mode("overwrite").option(
        "parquet.block.row.count.limit", _GROUP_ROWS
    ).option("parquet.page.row.count.limit", _PAGE_ROWS).parquet(path)
    return path


def _write_document(document: DataFrame, path: str) -> str:
    """A one-row frame as one JSON document."""
    document.select(F.to_json(F.struct(*document.columns))).write.mode("overwrite").text(path)
    return path


def _write_rows(rows: DataFrame, path: str) -> str:
    """JSON Lines; NULLs stay visible."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def write_topics(topics: DataFrame, folder: str, topic: str, era_labels=dims.ERA_LABELS) -> str:
    """Store the ranked lists as one nested JSON document."""
    path = storage.dataset_path(folder, f"{storage.slug(topic)}-topics", ".json")
    return _write_document(topics_document(topics, era_labels), path)


def write_summary(cube: DataFrame, folder: str, topic: str, **periods) -> str:
    """Store the country summary of a stored cube as one nested JSON document."""
    path = storage.dataset_path(folder, f"{storage.slug(topic)}-summary", ".json")
    return _write_document(summary_document(cube, **periods), path)


def write_articles(feed: DataFrame, folder: str, topic: str) -> str:
    """Store the article feed."""
    return _write_rows(feed, storage.dataset_path(folder, f"{storage.slug(topic)}-articles", ".json"))


def write_timeline(timeline: DataFrame, folder: str, topic: str) -> str:
    """Store a daily series."""
    return _write_rows(timeline, storage.dataset_path(folder, f"{storage.slug(topic)}-timeline", ".json"))


def read_json_artifact(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, lines: bool = False
) -> DataFrame:
    """An exported JSON document or array of rows; ``lines`` for JSON Lines, which Spark can split."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """A topics document, flattened back into ranked rows."""
    document = spark.read.schema(schemas.TOPICS_DOCUMENT).json(path)
    everywhere = document.select(
        F.lit("global").alias("scope"), F.lit(None).cast("string").alias("country_iso3"),
        F.col("global").alias("buckets"),
    )
    countries = document.select(
        F.lit("country").alias("scope"), F.explode("byCountry").alias("country_iso3", "buckets")
    )
    listed = everywhere.unionByName(countries).select(
        "scope", "country_iso3", F.explode("buckets").alias("bucket", "lists")
    )
    signals = F.explode(F.create_map(
        F.lit("orgs"), F.col("lists.orgs"), F.lit("themes"), F.col("lists.themes")
    )).alias("signal", "items")
    return (
        listed.select("scope", "country_iso3", "bucket", signals)
        .select("scope", "country_iso3", "bucket", "signal", F.posexplode("items").alias("pos", "item"))
        .select(
            "scope", "country_iso3", "bucket", "signal",
            F.lower("item.name").alias("key"), "item.name", "item.count",
            (F.col("pos") + 1).alias("rank"),
        )
    )


def country_names(spark: SparkSession, path: str) -> DataFrame:
    """(iso3, name) of the GeoJSON features that carry both."""
    properties = F.col("feature.properties")
    return (
        spark.read.schema(COUNTRY_NAMES)
        .option("multiLine", True)
        .json(path)
        .select(F.explode("features").alias("feature"))
        .select(properties["ADM0_A3"].alias("iso3"), properties["NAME"].alias("name"))
        .filter((F.col("iso3") != "") & (F.col("name") != ""))
        .groupBy("iso3")
        .agg(F.max("name").alias("name"))
    )

"""Article tables derived from the warehouse tables (``lineitem``, ``events`` and their dimensions).

Each line item is one article record: shipped from a supplier's country (the outlet), about a part
(the URL, the themes) and priced (the tone). Several records share a URL. ``events`` gives a
dense month in the same layout.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The outlet TLD of each nation key.
NATION_TLDS = (
    "fr de co.uk us com net tv it es jp cn in br ca au org tr kr ua ru pl se ie za mx"
).split()

TONE_FACTOR = 1_285_737_123  # tone steps of 1e-15 per cent of price

# Eras that fit the years of the warehouse.
BOUNDARIES = (
    "1995-01-01", "1996-07-01", "1998-01-01", "1999-01-01", "2000-01-01", "2002-01-01",
)
ERA_LABELS = ("1995 – 1996", "1996 – 1998", "1998 – 1999", "1999 – 2000", "2000 – 2001")
EARLY_UNTIL, LATE_FROM = "1998-01-01", "1999-01-01"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _packed(date: Column, time_of_day: Column) -> Column:
    day = F.year(date) * 10_000 + F.month(date) * 100 + F.dayofmonth(date)
    return day.cast("bigint") * 1_000_000 + time_of_day


def _tone_text(amount: Column, origin: float) -> Column:
    """Packed tone whose first number is ``(amount - origin) * 0.0001285737123``, as exact text.

    Fifteen decimals keep averages away from the rounding ties that few decimals produce.
    """
    cents = F.round((amount - F.lit(origin)) * 100).cast("bigint") * F.lit(TONE_FACTOR)
    number = cents.cast("decimal(20,0)") * F.lit("0.000000000000001").cast("decimal(16,15)")
    return F.concat(number.cast("string"), F.lit(",1.5,2.5,4.0,20.1,0.5,310"))


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """The article table over all line items.

    Texts that follow from the part or the supplier alone are made once per part and supplier, before the joins, so a
    line item only puts them together. The narrow supplier is joined first: the second shuffle then carries no texts of parts.
    """
    def col(name):
        return F.col(name)

    outlet = F.concat(
        F.lit("outlet"), (col("s_suppkey") % 40).cast("string"), F.lit("."),
        _pick(NATION_TLDS, col("s_nationkey")),
    )
    source = (
        F.when((col("s_nationkey") == 4) & (col("s_suppkey") % 3 == 0), "CNN.com")
        .when((col("s_nationkey") == 4) & (col("s_suppkey") % 3 == 1), " theguardian.com ")
        .when((col("s_nationkey") == 5) & (col("s_suppkey") % 2 == 0), "faz.net")
        .when((col("s_nationkey") == 15) & (col("s_suppkey") % 2 == 0), F.lit(None))
        .otherwise(outlet)
    )
    name, kind = F.replace("p_name", F.lit(" "), F.lit("-")), F.lower("p_type")
    brand = F.substring_index("p_brand", "#", -1)
    size = col("p_size").cast("string")
    variant = col("p_partkey") % 5
    slug = (
        F.when(variant == 0, F.concat_ws("-", name, F.lit("restocked")))
        .when(variant == 1, F.concat(name, F.lit("-"), kind, F.lit("-from-brand-"), brand, F.lit(".html")))
        .when(variant == 2, F.concat(
            F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), kind, F.lit("_from.brand-"), brand,
            F.lit("-"), F.lpad(col("p_partkey").cast("string"), 9, "7"), F.lit("?page="), size,
        ))
        .when(variant == 3, F.concat(F.lit("caf%C3%A9-"), name, F.lit("-"), kind, F.lit("-"), size, F.lit(";s=1")))
        .otherwise(F.concat(name, F.lit("-"), kind, F.lit("-deadbeef0"), brand, F.lit("-back-in-stock/#top")))
    )
    url = F.concat(F.lit("https://wire.example/news/"), slug)

    topic = F.concat(F.lit("ECON_"), F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))))
    word = F.concat(
        _pick(["TAX_", "ENV_", "POLITICAL_", "", "SECURITY_"], col("p_size") % 5),
        F.upper(F.substring_index("p_name", " ", 1)),
    )
    category = F.when(col("p_size") > 40, F.concat_ws("_", "p_type", size)).otherwise(col("p_type"))

    part = table(spark, folder, "part").select(
        "p_partkey", "p_brand", F.upper("p_brand").alias("upper_brand"), url.alias("url"), topic.alias("topic"),
        F.concat(F.lit(";"), word, F.lit(",9;"), category, F.lit(",77;MEDICAL,20;")).alias("rest_of_themes"),
        F.concat_ws(";", topic, word, category).alias("themes"),
        F.concat(F.initcap("p_type"), F.lit(" Carter,12")).alias("person"),
        F.concat(F.lit("#X#48#2#FR;4#City, Place#N"), (col("p_size") % 25).cast("string"), F.lit("#X1#1#2#-99")).alias("place"),
    )
    supplier = table(spark, folder, "supplier").select(
        "s_suppkey", "s_name", source.alias("source"),
        F.concat(F.lit("1#Nation#N"), col("s_nationkey").cast("string")).alias("nation"),
    )
    line = table(spark, folder, "lineitem").select(
        "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount",
        F.col("l_shipdate").cast("date").alias("day"),
    )
    joined = line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"]).join(
        part, line["l_partkey"] == part["p_partkey"]
    )
    offset = (col("l_linenumber") * 10).cast("string")
    odd = col("l_linenumber") % 2 == 1
    return joined.select(
        _packed(col("day"), col("l_linenumber") * 10000 + 3015).alias("DATE"),
        col("source").alias("SourceCommonName"),
        F.when(col("l_linenumber") != 7, col("url")).alias("DocumentIdentifier"),
        F.when(
            ~((col("l_linenumber") == 6) & (col("l_discount") < 0.05)),
            _tone_text(col("l_extendedprice"), 50000.0),
        ).alias("V2Tone"),
        F.concat(
            F.when(odd, col("upper_brand")).otherwise(col("p_brand")), F.lit(","), offset,
            F.lit(";"), col("s_name"), F.lit(",44;Reuters,80; ,1"),
        ).alias("V2Organizations"),
        F.when(col("l_linenumber") != 6, F.concat(col("topic"), F.lit(","), offset, col("rest_of_themes"))).alias("V2Themes"),
        col("themes").alias("Themes"),
        F.when(col("l_suppkey") % 2 == 0, col("person")).otherwise("Ann Lee,7").alias("V2Persons"),
        F.concat("nation", "place").alias("V2Locations"),
        col("day").alias("partition_date"),
    )


def event_articles(spark: SparkSession, folder: str) -> DataFrame:
    """The dense month: every event is a record, its user's country the outlet."""
    tld = _pick(NATION_TLDS, F.col("user_id") % 25)
    return table(spark, folder, "events").select(
        _packed(F.col("ts"), F.hour("ts") * 10_000 + F.minute("ts") * 100 + F.second("ts")).alias("DATE"),
        F.concat(F.lit("daily."), tld).alias("SourceCommonName"),
        F.concat_ws("/", F.lit("https://wire.example"), "user_id", "event_type").alias("DocumentIdentifier"),
        _tone_text(F.col("value") * 1000, 20000.0).alias("V2Tone"),
        F.col("ts").cast("date").alias("partition_date"),
    )


def sentence_urls(spark: SparkSession, folder: str) -> DataFrame:
    """A URL for every sentence of every document: its words, joined by hyphens."""
    sentences = F.explode(F.split("text", r"[.!?\n]+"))
    slug = F.regexp_replace("sentence", r"[^\p{L}\p{N}]+", "-")
    return (
        table(spark, folder, "documents")
        .select("doc_id", sentences.alias("sentence"))
        .select("doc_id", F.concat(F.lit("https://wire.example/text/"), slug, F.lit(".html")).alias("url"))
    )


def country_geojson(spark: SparkSession, folder: str) -> DataFrame:
    """One GeoJSON document of the nations with their outlet's country code.

    The nation table is a 25-row dimension, so one document holds it. One nation has no name.
    """
    name = F.when(F.col("n_nationkey") != 7, F.col("n_name"))
    iso3 = _pick(NATION_ISO3, F.col("n_nationkey"))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(iso3.alias("ADM0_A3"), name.alias("NAME")).alias("properties"),
    )
    return table(spark, folder, "nation").agg(
        F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features")
    )


# Country code of each nation key; three nations have none.
NATION_ISO3 = (
    "FRA", "DEU", "GBR", "USA", None, None, "TUV", "ITA", "ESP", "JPN", "CHN", "IND", "BRA",
    "CAN", "AUS", None, "TUR", "KOR", "UKR", "RUS", "POL", "SWE", "IRL", "ZAF", "MEX",
)

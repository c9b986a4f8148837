"""Explicit schemas of the stored tables, so no reader has to infer one."""

from pyspark.sql import types as T


def _schema(*fields):
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


ARTICLES = _schema(
    ("DATE", T.LongType()),
    ("SourceCommonName", T.StringType()),
    ("DocumentIdentifier", T.StringType()),
    ("V2Tone", T.StringType()),
    ("V2Organizations", T.StringType()),
    ("V2Themes", T.StringType()),
    ("Themes", T.StringType()),
    ("V2Persons", T.StringType()),
    ("partition_date", T.DateType()),
)

# The columns a topic scan keeps; the other three only take part in filters.
SCAN_COLUMNS = [
    "DATE", "SourceCommonName", "DocumentIdentifier", "V2Tone", "V2Organizations", "V2Themes",
]

SCAN = T.StructType([ARTICLES[name] for name in SCAN_COLUMNS])

CSV_EXTRACT = _schema(
    ("DATE", T.LongType()),
    ("V2Tone", T.StringType()),
    ("V2Locations", T.StringType()),
    ("SourceCommonName", T.StringType()),
    ("DocumentIdentifier", T.StringType()),
    ("V2Themes", T.StringType()),
)

COVERAGE = _schema(
    ("date", T.DateType()),
    ("country_iso3", T.StringType()),
    ("avg_tone", T.DoubleType()),
    ("article_count", T.LongType()),
)

# A cube that grows also keeps each day's own tone, NULL on silent days, to fill it again from any day on.
GROWING_COVERAGE = T.StructType([*COVERAGE.fields, T.StructField("own_tone", T.DoubleType(), True)])

MENTIONS = _schema(
    ("signal", T.StringType()),
    ("country_iso3", T.StringType()),
    ("era", T.IntegerType()),
    ("key", T.StringType()),
    ("name", T.StringType()),
    ("count", T.LongType()),
)

FEED = _schema(
    ("title", T.StringType()),
    ("source", T.StringType()),
    ("iso", T.StringType()),
    ("date", T.StringType()),
    ("tone", T.DoubleType()),
)

_ITEMS = T.ArrayType(_schema(("name", T.StringType()), ("count", T.LongType())))
_BUCKETS = T.MapType(T.StringType(), _schema(("orgs", _ITEMS), ("themes", _ITEMS)))

TOPICS_DOCUMENT = _schema(
    ("eras", T.ArrayType(T.StringType())),
    ("global", _BUCKETS),
    ("byCountry", T.MapType(T.StringType(), _BUCKETS)),
)

_PLACE = _schema(("iso", T.StringType()), ("tone", T.DoubleType()))
_VOLUME_PLACES = T.ArrayType(_schema(
    ("iso", T.StringType()), ("tone", T.DoubleType()), ("articles", T.LongType()),
))

SUMMARY_DOCUMENT = _schema(
    ("opinion_changers", T.ArrayType(_schema(
        ("iso", T.StringType()),
        ("early", T.DoubleType()),
        ("late", T.DoubleType()),
        ("delta", T.DoubleType()),
        ("direction", T.StringType()),
    ))),
    ("pos_neg", _schema(("most_positive", _VOLUME_PLACES), ("most_negative", _VOLUME_PLACES))),
    ("era_countries", T.ArrayType(_schema(("most_negative", _PLACE), ("most_positive", _PLACE)))),
    ("headline", _schema(
        ("total_articles", T.LongType()),
        ("countries", T.LongType()),
        ("avg_tone", T.DoubleType()),
        ("date_range", T.StringType()),
    )),
)

"""The four composite jobs. Each is one lazy plan over the raw article table."""

from pyspark.sql import DataFrame, functions as F

from newslens.dims import ERA_BOUNDARIES
from newslens.functions import eras, fields, titles
from newslens.operators import coverage, feed, filters, geo, timeline, topics
from newslens.sources.sample_store import SampleStore


def located_articles(raw: DataFrame, outlets=None) -> DataFrame:
    """Articles with a date, a strict tone and a country."""
    parsed = raw.withColumns({
        "date": fields.packed_date(F.col("DATE")),
        "tone": fields.first_tone(F.col("V2Tone")),
    }).select("date", "tone", "SourceCommonName", "DocumentIdentifier")
    return filters.valid_country(geo.outlet_country(parsed, outlets=outlets))


def build_coverage(raw: DataFrame, outlets: DataFrame | None = None) -> DataFrame:
    """Raw articles to the gap-filled country x day cube.

    The articles are read once: the range of days comes from the daily aggregate's own shuffle.
    """
    return coverage.fill_gaps(coverage.daily_country_sentiment(located_articles(raw, outlets)))


def topic_articles(raw: DataFrame, boundaries=ERA_BOUNDARIES, outlets=None) -> DataFrame:
    """Articles with an era and, where the outlet has one, a country."""
    dated = raw.withColumn("era", eras.era_of(fields.packed_date(F.col("DATE")), boundaries))
    return geo.outlet_country(dated, outlets=outlets)


def build_topics(
    raw: DataFrame,
    keywords=(),
    boundaries=ERA_BOUNDARIES,
    org_stops=None,
    n: int = topics.TOP_N,
    threshold: int = topics.MIN_COUNTRY_MENTIONS,
    distinct_articles: bool = False,
    outlets: DataFrame | None = None,
) -> DataFrame:
    """Ranked organisations and themes per bucket, globally and for countries with enough mentions.

    ``distinct_articles`` counts each article once per bucket, however many eras or countries it
    is in; the threshold then is on a country's distinct articles. Articles without an identifier
    cannot be told apart and count for none.
    """
    signals = [
        s for s in topics.default_signals(keywords, org_stops) if s.column in raw.columns
    ]
    articles = topic_articles(raw, boundaries, outlets)
    measured = signals[0].name if signals else "orgs"
    if distinct_articles and signals:
        counted = topics.distinct_rollup(articles, signals, measured, len(boundaries) - 1)
        return topics.with_names(topics.listed_topics(counted, n, threshold, measured), articles, signals)
    # The rollup adds spellings up anyway, so plain mentions go to it without a merge of their own.
    return topics.ranked_topics(topics.entry_counts(articles, signals), n, threshold, measured)


def build_feed(
    raw: DataFrame, final: int = feed.FEED_ROWS, pool: int = feed.POOL, outlets=None
) -> DataFrame:
    """A time-balanced sample of headlines: title, source, country, date and tone."""
    title = titles.url_title(F.col("DocumentIdentifier"))
    return _feed(feed.pool_sample(feed_articles(raw), pool, derive={"title": title}), final, outlets)


def feed_articles(raw: DataFrame) -> DataFrame:
    """What the feed knows of an article: lenient tone, keys not NULL."""
    parsed = raw.select(
        "DocumentIdentifier",
        "SourceCommonName",
        fields.packed_date(F.col("DATE")).alias("date"),
        fields.first_tone(F.col("V2Tone"), strict=False).alias("tone"),
    )
    return filters.drop_null_keys(parsed, "DocumentIdentifier", "date")


def store_feed(raw: DataFrame, path: str) -> SampleStore:
    """Store the feed's articles in the order of its samples; :func:`stored_feed` then reads about as many rows as it pools."""
    usable = feed_articles(raw)
    store = SampleStore(raw.sparkSession, path, usable.schema)
    store.write(usable)
    return store


def stored_feed(store: SampleStore, final: int = feed.FEED_ROWS, pool: int = feed.POOL, outlets=None) -> DataFrame:
    """What :func:`build_feed` gives of the stored articles."""
    title = titles.url_title(F.col("DocumentIdentifier"))
    return _feed(store.pool(pool).withColumn("title", title), final, outlets)


def _feed(pooled: DataFrame, final: int, outlets) -> DataFrame:
    titled = geo.outlet_country(pooled.filter(F.col("title").isNotNull()), outlets=outlets)
    # The pool bounds this frame, so numbering its rows in one task is safe.
    picked = feed.even_pick_join(titled, final, ("date", "DocumentIdentifier"))
    return picked.select(
        "title",
        F.lower(F.coalesce("SourceCommonName", F.lit(""))).alias("source"),
        F.col("country_iso3").alias("iso"),
        fields.iso_date_text(F.col("date")).alias("date"),
        fields.round2(F.col("tone")).alias("tone"),
    ).orderBy("date", "title", "source")


def overview_series(cube: DataFrame, window: int = 90, target: int = 500) -> DataFrame:
    """The overview chart: smoothed, thinned series with its trend line and zero line."""
    smooth = timeline.smooth_timeline(timeline.global_timeline(cube), window)
    chart = timeline.tone_trend(timeline.downsample(smooth, target))
    low = F.least(F.min("avg_tone").over(timeline.everything()), F.lit(0.0))
    high = F.greatest(F.max("avg_tone").over(timeline.everything()), F.lit(0.0))
    return chart.withColumn("zero_offset", high / F.when(high != low, high - low).otherwise(1.0))

"""The registered queries, by operator name: each takes (session, table folder)."""

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from newslens import schemas
from newslens.functions import fields, labels, titles
from newslens.operators import candidates, coverage, feed, filters, frames, geo, rankings, timeline, topics
from newslens.plans import batch, jobs, views, warehouse as w
from newslens.session import case_sensitive
from newslens.sources import articles as article_store, datasets, storage
from newslens.streaming import daily as daily_stream

KEYWORDS = ["promo", "hot"]
STOPS = ["brand#7"]
MONTHS = ("1996-02", "1999-11")
DIGITS = 8
# Thresholds that some countries miss at sf0.01.
MIN_MENTIONS, MIN_ARTICLES, MIN_VOLUME, MIN_SHARED = 4800, 500, 618, 15


def _tidy(df: DataFrame) -> DataFrame:
    """Round doubles, whose last bits depend on the order of summation."""
    return df.select(*[
        F.round(f.name, DIGITS).alias(f.name) if isinstance(f.dataType, T.DoubleType) else f.name
        for f in df.schema
    ])


# --- Inputs ---------------------------------------------------------------------

def _located(spark, folder):
    return jobs.located_articles(w.articles(spark, folder))


def _daily(spark, folder):
    return coverage.daily_country_sentiment(_located(spark, folder))


def _cube(spark, folder):
    return jobs.build_coverage(w.articles(spark, folder))


def _dense_daily(spark, folder):
    return coverage.daily_country_sentiment(jobs.located_articles(w.event_articles(spark, folder)))


def _dense_cube(spark, folder):
    return jobs.build_coverage(w.event_articles(spark, folder))


def _served(spark, folder):
    """The cube as stored and read back, which the served queries answer from."""
    store = storage.scratch_folder(spark, "cube")
    datasets.write_coverage(_cube(spark, folder), store, "Parts", "1995-01", "2001-12")
    return datasets.read_coverage(spark, store, "parts-1995-01-2001-12")


def _timeline(spark, folder):
    return timeline.global_timeline(_served(spark, folder))


def _mentions(spark, folder):
    dated = jobs.topic_articles(w.articles(spark, folder), w.BOUNDARIES)
    return topics.mention_counts(dated, topics.default_signals(STOPS))


def _ranked(spark, folder):
    return jobs.build_topics(w.articles(spark, folder), STOPS, w.BOUNDARIES)


def _era_stats(spark, folder):
    return rankings.era_countries(_served(spark, folder), w.BOUNDARIES)


def _parsed(spark, folder):
    return jobs.feed_articles(w.articles(spark, folder))


def _sample_store(spark, folder):
    return jobs.store_feed(w.articles(spark, folder), storage.scratch_folder(spark, "samples"))


def _names(spark, folder):
    """Country names, by way of a GeoJSON document in scratch storage."""
    path = storage.scratch_folder(spark, "names")
    w.country_geojson(spark, folder).write.json(path)
    return datasets.country_names(spark, path)


# --- Sources and sinks ------------------------------------------------------------

def topic_scan(spark, folder):
    return article_store.topic_scan(w.articles(spark, folder), KEYWORDS, *MONTHS).select(
        "DATE", "SourceCommonName", "DocumentIdentifier"
    )


def csv_extract(spark, folder):
    path = storage.scratch_folder(spark, "extract")
    article_store.write_csv_extract(w.articles(spark, folder), path)
    return article_store.read_csv_extract(spark, path)


def materialize_scan(spark, folder):
    store = storage.scratch_folder(spark, "scans")
    request = (store, "Promo Hot", KEYWORDS, *MONTHS)
    raw = w.articles(spark, folder)
    article_store.materialize_scan(raw, *request)
    return article_store.materialize_scan(raw, *request).select("DATE", "V2Tone", "V2Themes")


def _growing(spark, folder):
    """The dense month as an article table by day, first as far as each delivery goes.

    Three weeks with half of some days missing, the days after, the missing halves.
    """
    path = storage.scratch_folder(spark, "days")
    raw = filters.with_optional_columns(w.event_articles(spark, folder), schemas.ARTICLES)
    day = F.col("partition_date")
    weak = day.between("2024-01-05", "2024-01-09")
    for arrived in ((day < "2024-01-22") & ~(weak & (F.col("DATE") % 2 == 1)), day >= "2024-01-22", weak):
        # Days are whole partitions, so a correction replaces those that it brings.
        raw.filter(arrived).hint("rebalance", "partition_date").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("partition_date").parquet(path)
        yield path


GROWING = ("Clicks", ["click"], "2024-01", "2024-01")


def incremental_scan(spark, folder):
    """The stored scan of a table that grew twice, each time reading the changed days alone."""
    store = storage.scratch_folder(spark, "scans")
    for path in _growing(spark, folder):
        scan = article_store.refresh_scan(spark, path, store, *GROWING)
    return scan.rows().select("DATE", "SourceCommonName", "DocumentIdentifier", "V2Tone")


def incremental_coverage(spark, folder):
    """The cube of that table, appended to and corrected in place."""
    store, scans = storage.scratch_folder(spark, "cubes"), storage.scratch_folder(spark, "scans")
    for path in _growing(spark, folder):
        cube, _, _ = batch.refresh_topic(spark, path, *GROWING, store, scans)
    return _tidy(cube.read())


def read_coverage(spark, folder):
    return _tidy(coverage.cube_profile(_served(spark, folder)))


def write_coverage(spark, folder):
    return _tidy(_served(spark, folder))


def write_topics(spark, folder):
    store = storage.scratch_folder(spark, "topics")
    path = datasets.write_topics(_ranked(spark, folder), store, "Parts", w.ERA_LABELS)
    return datasets.read_topics(spark, path)


def write_articles(spark, folder):
    store = storage.scratch_folder(spark, "feed")
    path = datasets.write_articles(jobs.build_feed(w.articles(spark, folder)), store, "Parts")
    return spark.read.schema(schemas.FEED).json(path)


def write_summary(spark, folder):
    """The summary document, read back and laid out as one row per listed country."""
    store = storage.scratch_folder(spark, "summary")
    path = datasets.write_summary(
        _served(spark, folder), store, "Parts", boundaries=w.BOUNDARIES,
        early_until=w.EARLY_UNTIL, late_from=w.LATE_FROM,
    )
    document = datasets.read_json_artifact(spark, path, schemas.SUMMARY_DOCUMENT, lines=True)
    changers = document.select(F.inline("opinion_changers")).select(
        F.col("direction").alias("part"), "iso", F.col("delta").alias("tone")
    )
    sides = [
        document.select(F.inline(f"pos_neg.{side}")).select(F.lit(side).alias("part"), "iso", "tone")
        for side in ("most_positive", "most_negative")
    ]
    eras = document.select(F.posexplode("era_countries").alias("era", "pair"))
    ends = [
        eras.select(F.concat(F.lit(f"{side} "), "era").alias("part"), f"pair.{side}.iso", f"pair.{side}.tone")
        for side in ("most_negative", "most_positive")
    ]
    total = document.select(
        F.lit("headline").alias("part"), F.col("headline.date_range").alias("iso"),
        F.col("headline.avg_tone").alias("tone"),
    )
    rows = changers
    for part in [*sides, *ends, total]:
        rows = rows.unionByName(part)
    return rows


def read_json_artifact(spark, folder):
    store = storage.scratch_folder(spark, "timeline")
    path = datasets.write_timeline(_tidy(_timeline(spark, folder)), store, "Parts")
    schema = "date DATE, avg_tone DOUBLE, article_count BIGINT"
    return datasets.read_json_artifact(spark, path, schema, lines=True)


def country_names(spark, folder):
    return _names(spark, folder)


# --- Filters ----------------------------------------------------------------------

def keyword_match(spark, folder):
    return filters.keyword_match(w.articles(spark, folder), ["promo"]).select(
        "DATE", "SourceCommonName", "Themes", "V2Persons"
    )


TOPICS = {"promo": ["promo"], "hot promo": ["hot", "PROMO "], "rod": ["rod"], "old rod": ["old rod"], "hot": ["hot"], "none": ["no such word"]}


def topic_match(spark, folder):
    """Several topics from one scan, stored and read back."""
    scans = article_store.materialize_scans(w.articles(spark, folder), storage.scratch_folder(spark, "scans"), TOPICS, *MONTHS)
    named = [rows.select(F.lit(name).alias("topic"), "DATE", "SourceCommonName", "DocumentIdentifier") for name, rows in scans.items()]
    return functools.reduce(DataFrame.unionByName, named)


def partition_range(spark, folder):
    return filters.partition_range(w.articles(spark, folder), *MONTHS).select(
        "DATE", "partition_date", "SourceCommonName"
    )


def parse_packed_date(spark, folder):
    """``DATE`` and ``date`` differ by case alone: only a session that minds case can name them, or store both."""
    return w.articles(case_sensitive(spark), folder).select(
        "DATE", fields.packed_date(F.col("DATE")).alias("date"),
        fields.iso_date_text(fields.packed_date(F.col("DATE"))).alias("date_text"),
    )


def first_tone(spark, folder):
    return w.articles(spark, folder).select("DATE", fields.first_tone(F.col("V2Tone")).alias("tone"))


def valid_country(spark, folder):
    mapped = geo.outlet_country(w.articles(spark, folder))
    return filters.valid_country(mapped).groupBy("country_iso3").agg(F.count("*").alias("records"))


def era_of(spark, folder):
    return jobs.topic_articles(w.articles(spark, folder), w.BOUNDARIES).groupBy("era").agg(
        F.count("*").alias("records")
    )


def covered_only(spark, folder):
    return _tidy(filters.covered_only(_served(spark, folder)))


def drop_null_keys(spark, folder):
    return _tidy(_parsed(spark, folder))


def era_slice(spark, folder):
    return _tidy(filters.era_slice(_timeline(spark, folder), 2, w.BOUNDARIES))


def optional_columns(spark, folder):
    """A table without organisations: that signal is skipped, absent columns read as NULL."""
    raw = w.articles(spark, folder).drop("V2Organizations")
    padded = filters.with_optional_columns(raw, schemas.ARTICLES).select(
        F.count("*").alias("records"), F.count("V2Organizations").alias("organizations")
    )
    mentions = topics.mention_counts(jobs.topic_articles(raw, w.BOUNDARIES))
    counted = mentions.groupBy("signal").agg(F.sum("count").alias("records"))
    return counted.unionByName(
        padded.select(F.lit("articles").alias("signal"), "records")
    ).unionByName(padded.select(F.lit("orgs").alias("signal"), F.col("organizations").alias("records")))


# --- Joins ------------------------------------------------------------------------

def outlet_country(spark, folder):
    mapped = geo.outlet_country(w.articles(spark, folder))
    return mapped.groupBy("SourceCommonName", "country_iso3").agg(F.count("*").alias("records"))


def date_country_spine(spark, folder):
    return coverage.date_country_spine(_daily(spark, folder))


def gap_join(spark, folder):
    daily = _daily(spark, folder)
    return _tidy(coverage.gap_join(coverage.date_country_spine(daily), daily))


def stop_anti_join(spark, folder):
    themes = topics.theme_keyword_counts(_mentions(spark, folder))
    return topics.stop_anti_join(themes, ["hot", "old rod", "economy"])


def kept_country_semi_join(spark, folder):
    mentions = _mentions(spark, folder)
    kept = topics.kept_countries(mentions, MIN_MENTIONS)
    return topics.kept_country_semi_join(mentions, kept).drop("name")


def country_label_join(spark, folder):
    by_volume = rankings.country_tone(_served(spark, folder)).select("country_iso3", "article_count")
    return geo.country_label_join(by_volume, _names(spark, folder))


def map_frame_join(spark, folder):
    """A day on which some countries of the map are silent."""
    frame = filters.covered_only(views.sentiment_by_date(_served(spark, folder), "1998-03-14"))
    return _tidy(geo.map_frame_join(_names(spark, folder), frame))


def narrative_affinity(spark, folder):
    return _tidy(topics.narrative_affinity(_ranked(spark, folder), top=20, min_shared=MIN_SHARED))


def even_pick_join(spark, folder):
    single = feed.dedupe_articles(_parsed(spark, folder))
    return _tidy(feed.even_pick_join(single, 100, ("date", "DocumentIdentifier")))


# --- Aggregations ------------------------------------------------------------------

def daily_country_sentiment(spark, folder):
    sparse, dense = _daily(spark, folder), _dense_daily(spark, folder)
    return _tidy(sparse.unionByName(dense))


def mention_counts(spark, folder):
    return _mentions(spark, folder)


def distinct_article_mentions(spark, folder):
    dated = jobs.topic_articles(w.articles(spark, folder), w.BOUNDARIES)
    return topics.mention_counts(
        dated, topics.default_signals(STOPS), distinct_articles=True
    ).drop("name")


def topic_rollup(spark, folder):
    return topics.topic_rollup(_mentions(spark, folder))


def kept_countries(spark, folder):
    return topics.kept_countries(_mentions(spark, folder), MIN_MENTIONS)


def era_countries_grouped(spark, folder):
    return _tidy(_era_stats(spark, folder))


def frame_average(spark, folder):
    return _tidy(frames.frame_average(_dense_cube(spark, folder), ("date",)))


def country_share(spark, folder):
    return _tidy(rankings.country_share(_served(spark, folder), 12))


def cube_profile(spark, folder):
    return coverage.cube_profile(_served(spark, folder))


def headline(spark, folder):
    return _tidy(rankings.headline(_served(spark, folder)))


def opinion_changers(spark, folder):
    return _tidy(rankings.opinion_changers(_served(spark, folder), w.EARLY_UNTIL, w.LATE_FROM))


def pos_neg_countries(spark, folder):
    return _tidy(rankings.pos_neg_countries(_served(spark, folder), min_volume=MIN_VOLUME))


def era_extremes_published(spark, folder):
    return _tidy(rankings.era_extremes_published(_era_stats(spark, folder)))


def era_extremes_topvol(spark, folder):
    return _tidy(rankings.era_extremes_topvol(_era_stats(spark, folder), 15))


def topic_volume_rank(spark, folder):
    return topics.topic_volume_rank(_ranked(spark, folder))


def tone_trend(spark, folder):
    return _tidy(timeline.tone_trend(_timeline(spark, folder)))


def distinct_outlets(spark, folder):
    return geo.distinct_outlets(w.articles(spark, folder))


def tone_distribution(spark, folder):
    return _tidy(coverage.tone_distribution(_located(spark, folder), -5.0, 5.0, 25))


def tone_distribution_by_country(spark, folder):
    """Of one year, from stored counts per day and country."""
    bins = (-5.0, 5.0, 25)
    path = datasets.write_tone_counts(
        coverage.tone_counts(_located(spark, folder), *bins), storage.scratch_folder(spark, "tones"), "Parts", "1995-01", "2001-12"
    )
    year = spark.read.parquet(path).filter(F.col("date").between("1997-01-01", "1997-12-31"))
    return _tidy(coverage.merged_tone_counts(year, *bins, by=("country_iso3",)))


def article_volume(spark, folder):
    return coverage.article_volume(_located(spark, folder), "date")


def country_volume(spark, folder):
    return coverage.article_volume(_located(spark, folder), "country_iso3")


def axis_stats(spark, folder):
    return _tidy(timeline.axis_stats(_timeline(spark, folder)))


def theme_keyword_counts(spark, folder):
    return topics.theme_keyword_counts(_mentions(spark, folder))


def coverage_spread(spark, folder):
    return coverage.coverage_spread(_served(spark, folder))


def location_counts(spark, folder):
    return geo.location_counts(w.articles(spark, folder))


# --- Windows -----------------------------------------------------------------------

def forward_fill(spark, folder):
    daily = _daily(spark, folder)
    spine = coverage.date_country_spine(daily)
    return _tidy(coverage.forward_fill(coverage.gap_join(spine, daily)))


def rolling_country_frame(spark, folder):
    return _tidy(frames.rolling_country_frame(_served(spark, folder)))


def rolling_country_frame_fast(spark, folder):
    """After a jump, at triple speed."""
    cube = _served(spark, folder)
    return _tidy(frames.rolling_country_frame(cube, frames.FAST_WINDOW_DAYS, "1998-05-01", step=3))


def smooth_timeline(spark, folder):
    return _tidy(timeline.smooth_timeline(_timeline(spark, folder), 90))


def smooth_country_timelines(spark, folder):
    toned = _dense_cube(spark, folder).filter(F.col("avg_tone").isNotNull())
    return _tidy(timeline.smooth_timeline(toned, 7, ("country_iso3",)))


def top_n_per_group(spark, folder):
    return topics.top_n_per_group(topics.topic_rollup(_mentions(spark, folder)))


def downsample(spark, folder):
    return _tidy(timeline.downsample(_timeline(spark, folder)))


def rolling_30d(spark, folder):
    """Over the observed days of each country, many of which are missing."""
    return _tidy(timeline.rolling_mean(_daily(spark, folder), 30, ("country_iso3",)))


def era_spans(spark, folder):
    return _tidy(timeline.era_spans(_served(spark, folder), w.BOUNDARIES))


def sparkline_points(spark, folder):
    smooth = timeline.smooth_timeline(_timeline(spark, folder), 30)
    return _tidy(timeline.sparkline_points(smooth, w.BOUNDARIES))


def first_match(spark, folder):
    located = _located(spark, folder)
    return _tidy(rankings.first_match(
        located.filter(F.col("DocumentIdentifier").isNotNull() & F.col("tone").isNotNull()),
        ["date", "country_iso3"], ["DocumentIdentifier", "SourceCommonName", "tone"],
    ))


def url_title(spark, folder):
    """Headlines from the sentences of all documents, with the number of documents each is in."""
    return titles.with_title(w.sentence_urls(spark, folder), "url", "doc_id").groupBy("title").agg(
        F.count("*").alias("records"), F.count_distinct("doc_id").alias("documents")
    )


def theme_label(spark, folder):
    """Records by the label of their theme codes; codes that are no theme have none."""
    codes = w.articles(spark, folder).select(F.explode(F.split("Themes", ";")).alias("code"))
    return codes.groupBy(labels.theme_label(F.col("code")).alias("label")).agg(F.count("*").alias("records"))


def slugify(spark, folder):
    named = F.concat("p_name", F.lit(" / "), "p_brand", F.lit("--"), "p_type", F.lit(" Émile!"))
    return w.table(spark, folder, "part").select("p_partkey", fields.slugify(named).alias("slug"))


# --- Sorts, limits, sets, samples ----------------------------------------------------

def sorted_outputs(spark, folder):
    return _tidy(_daily(spark, folder).orderBy("date", "country_iso3"))


def top_k(spark, folder):
    return _tidy(rankings.top_k(
        _served(spark, folder), 60, F.desc("article_count"), "date", "country_iso3"
    ))


def top8_by_tone(spark, folder):
    return _tidy(rankings.top8_by_tone(_era_stats(spark, folder)))


def word_blend(spark, folder):
    return topics.word_blend(_ranked(spark, folder))


def dedupe_articles(spark, folder):
    return _tidy(feed.dedupe_articles(_parsed(spark, folder)))


def union_scale(spark, folder):
    return _tidy(rankings.union_scale(rankings.pos_neg_countries(_served(spark, folder))))


def pool_sample(spark, folder):
    return _tidy(feed.pool_sample(_parsed(spark, folder), 400))


def even_sample(spark, folder):
    return _tidy(feed.even_sample(feed.dedupe_articles(_parsed(spark, folder)), 150))


def pool_sample_stored(spark, folder):
    return _tidy(_sample_store(spark, folder).pool(400))


def even_sample_stored(spark, folder):
    return _tidy(_sample_store(spark, folder).even(150))


def random_extract(spark, folder):
    return feed.random_extract(
        w.articles(spark, folder).select(*schemas.CSV_EXTRACT.fieldNames())
    )


def ranked_words(spark, folder):
    return topics.ranked_words(_ranked(spark, folder))


# --- Served queries --------------------------------------------------------------------

def available_dates(spark, folder):
    return views.available_dates(_served(spark, folder))


def sentiment_by_date(spark, folder):
    return _tidy(views.sentiment_by_date(_served(spark, folder), "1998-03-14"))


def era_countries(spark, folder):
    return _tidy(views.era_countries(_served(spark, folder), w.BOUNDARIES))


def country_timeline(spark, folder):
    return _tidy(views.country_timeline(_served(spark, folder), "gbr"))


def global_timeline(spark, folder):
    return _tidy(views.global_timeline(_served(spark, folder)))


def topic_words(spark, folder):
    """From the stored topics document."""
    store = storage.scratch_folder(spark, "topics")
    path = datasets.write_topics(_ranked(spark, folder), store, "Parts", w.ERA_LABELS)
    return views.topic_words(datasets.read_topics(spark, path), "usa", 1, total=11)


# --- Composite jobs ----------------------------------------------------------------------

def build_coverage(spark, folder):
    return _tidy(_cube(spark, folder))


def build_topics(spark, folder):
    """With a threshold that some countries miss."""
    return jobs.build_topics(w.articles(spark, folder), STOPS, w.BOUNDARIES, threshold=MIN_MENTIONS)


def build_topics_candidates(spark, folder):
    """Only candidates are counted everywhere; summaries small enough that some buckets have to be counted in full."""
    articles = jobs.topic_articles(w.articles(spark, folder), w.BOUNDARIES)
    signals = topics.default_signals(STOPS)
    return candidates.top_topics(articles, signals, threshold=MIN_MENTIONS, tracked=2_000)


def build_topics_distinct(spark, folder):
    """Distinct articles at all grains, with a threshold that some countries miss."""
    return jobs.build_topics(
        w.articles(spark, folder), STOPS, w.BOUNDARIES, threshold=MIN_ARTICLES, distinct_articles=True
    )


def build_feed(spark, folder):
    """With a pool smaller than the articles."""
    return jobs.build_feed(w.articles(spark, folder), pool=700)


def build_feed_stored(spark, folder):
    """From articles stored in the order of the sample."""
    return jobs.stored_feed(_sample_store(spark, folder), pool=700)


def overview_series(spark, folder):
    return _tidy(jobs.overview_series(_served(spark, folder)))


# --- Streaming -----------------------------------------------------------------------------

def incremental_daily_sentiment(spark, folder):
    """The closed days of the stream and the days still open, against the batch over all days."""
    work = storage.scratch_folder(spark, "stream")
    w.event_articles(spark, folder).write.parquet(f"{work}/in")
    arrived = spark.read.parquet(f"{work}/in")
    closed = daily_stream.run_available(
        spark, f"{work}/in", arrived.schema, f"{work}/out", f"{work}/checkpoint"
    )
    return _tidy(daily_stream.with_open_days(closed, arrived))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every public function of this module, by name."""
    return {
        name: f
        for name, f in globals().items()
        if callable(f) and getattr(f, "__module__", None) == __name__
        and not name.startswith("_") and name != "registered"
    }

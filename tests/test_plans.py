"""What the plans must look like, on stored article tables."""

import re

import pytest
from pyspark.sql import functions as F

from newslens.operators import coverage, feed, topics
from newslens.plans import catalog, jobs, views, warehouse as w

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "articles")
    w.articles(spark, FOLDER).write.parquet(path)
    return spark.read.parquet(path)


def scans(text):
    return [line for line in text.splitlines() if "FileScan" in line]


def read_columns(text):
    return sorted(line.split("[", 1)[1].split("]")[0].count("#") for line in scans(text))


def test_outlet_lookup_is_broadcast(raw, plan):
    text = plan(jobs.located_articles(raw))
    assert text.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in text and "Exchange hash" not in text


def executed(df):
    """The final adaptive plan, without the plans it started from."""
    df.collect()
    kept, skipped = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        if not re.match(r"[ :]*[+:]- ", line):  # an expression with a line break in it
            continue
        depth = len(line) - len(line.lstrip(" :+-"))
        if skipped is not None and depth < skipped:
            skipped = None
        if skipped is None and "== Initial Plan ==" in line:
            skipped = depth
        if skipped is None:
            kept.append(line)
    return "\n".join(kept)


def test_coverage_reads_the_articles_once(raw, plan):
    df = jobs.build_coverage(raw)
    text = executed(df)
    assert read_columns(text) == [4]
    # The range of days reads the shuffle that the windows read.
    assert "ReusedExchange [date" in text and "ReusedSubquery" in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_distinct_count_spreads_a_hot_country_day(raw, plan):
    text = plan(coverage.daily_country_sentiment(jobs.located_articles(raw)))
    assert any("Exchange hashpartitioning" in line and "DocumentIdentifier" in line for line in text.splitlines())


def test_topics_read_once_and_clean_after_counting(raw, plan):
    text = plan(jobs.build_topics(raw, ["x"], w.BOUNDARIES))
    assert len(scans(text)) == 1
    lines = text.splitlines()
    count_entries = max(i for i, line in enumerate(lines) if "HashAggregate" in line and "partial_count(1)" in line)
    # Plans print downward: everything after this line runs before the count.
    before_count = "\n".join(lines[count_entries:])
    assert "regexp" not in before_count.lower() and "RLIKE" not in before_count
    assert text.count("WindowGroupLimit") == 2


def test_distinct_topics_shuffle_pairs_once_per_country(raw):
    """One scan for the pairs and one for the spellings; what is asked of the pairs reads their shuffle again."""
    text = executed(jobs.build_topics(raw, ["x"], w.BOUNDARIES, distinct_articles=True))
    assert "Expand" not in "\n".join(x for x in text.splitlines() if "DocumentIdentifier" in x)
    assert text.count("ReusedExchange") >= 2 and len(scans(text)) == 2
    assert not any("SortAggregate" in x and "DocumentIdentifier" in x for x in text.splitlines())


def test_distinct_topics_shuffle_records_and_not_their_entries(raw):
    """Of all that holds articles only the records are shuffled, once and before they are split; then only sums."""
    lines = executed(jobs.build_topics(raw, ["x"], w.BOUNDARIES, distinct_articles=True)).splitlines()
    moved = [i for i, x in enumerate(lines) if re.search(r"- Exchange .*DocumentIdentifier", x)]
    split = [i for i, x in enumerate(lines) if "Generate explode" in x and "DocumentIdentifier" in x]
    assert len(moved) == 1 and split and max(split) < moved[0]


def test_feed_samples_before_it_shuffles_whole_rows(raw, plan):
    df = jobs.build_feed(raw, pool=10)
    text = plan(df)
    assert "substring" in text and "TakeOrderedAndProject" in text
    # The whole rows, and for the cutoff the key and the date twice.
    assert read_columns(executed(df)) == [2, 2, 4]


def test_date_filter_reaches_the_scan(spark, raw, plan, tmp_path):
    path = str(tmp_path / "cube")
    jobs.build_coverage(raw).write.parquet(path)
    text = plan(views.sentiment_by_date(spark.read.parquet(path), "1998-01-01"))
    assert "EqualTo(date,1998-01-01)" in text
    series = plan(views.country_timeline(spark.read.parquet(path), "FRA"))
    pushed = series[series.index("PushedFilters"):]
    assert "EqualTo(country_iso3,FRA)" in pushed and "IsNotNull(avg_tone)" in pushed


def test_top_n_is_cut_before_the_shuffle(raw, plan):
    mentions = topics.mention_counts(jobs.topic_articles(raw, w.BOUNDARIES))
    text = plan(topics.top_n_per_group(topics.topic_rollup(mentions)))
    assert "Partial" in text and "WindowGroupLimit" in text


def test_even_sample_sorts_only_picked_slices(raw, plan):
    docs = raw.select("DocumentIdentifier", "partition_date").withColumnRenamed("partition_date", "date")
    text = plan(feed.even_sample(docs.filter(F.col("DocumentIdentifier").isNotNull()), 10))
    assert "BroadcastHashJoin" in text and "CartesianProduct" not in text


@pytest.mark.parametrize("name", sorted(catalog.registered()))
def test_no_python_workers_and_no_cross_joins(spark, plan, name):
    text = plan(catalog.registered()[name](spark, FOLDER))
    for banned in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert banned not in text, banned


def test_a_mention_is_cleaned_once(raw, plan):
    signals = topics.default_signals()
    kept = topics.mention_keys(jobs.topic_articles(raw), signals, "country_iso3", "era").filter(F.col("key").isNotNull())
    # The spelling and the key of each signal, the outlet's name and its label.
    assert plan(kept).count("trim(") <= 2 * len(signals) + 2


def test_distinct_mentions_without_names_are_hashed(raw, plan):
    counted = topics.mention_counts(jobs.topic_articles(raw), distinct_articles=True).drop("name")
    assert "SortAggregate" not in plan(counted)


def test_texts_of_a_part_are_made_before_the_join(spark, plan):
    text = plan(w.articles(spark, FOLDER).select("DocumentIdentifier"))
    assert text.index("Join") < text.index("wire.example") and text.count("wire.example") == 1


def test_places_of_the_sample_are_compared_as_digits(raw, plan):
    assert "conv(" not in plan(feed.pool_sample(jobs.feed_articles(raw), 20))


def test_titles_are_derived_once(spark, plan):
    assert plan(catalog.url_title(spark, FOLDER)).count("UrlCodec") == 1

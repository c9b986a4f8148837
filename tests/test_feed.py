import datetime as dt
import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from newslens.operators import feed
from newslens.plans import jobs
from newslens.sources.sample_store import SampleStore
from test_sources import rows_read

ARTICLE = "DocumentIdentifier string, SourceCommonName string, date date, tone double"


def md5(text):
    return hashlib.md5(f"7|{text}".encode()).hexdigest()


def hot_articles(spark, n=6000):
    """A third of all rows repeat one article."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("doc"), F.col("id") % 1500)).alias("DocumentIdentifier"),
        F.concat(F.lit("s"), F.col("id") % 7).alias("SourceCommonName"),
        F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("id") % 40).cast("int")).alias("date"),
        F.col("id").cast("double").alias("tone"),
    )


def deduped(rows):
    best = {}
    for r in sorted(rows, key=lambda r: (r.date, r.SourceCommonName, r.tone)):
        best.setdefault(r.DocumentIdentifier, tuple(r))
    return best


def test_dedupe(spark):
    frame = hot_articles(spark)
    got = {r.DocumentIdentifier: tuple(r) for r in feed.dedupe_articles(frame).collect()}
    assert got == deduped(frame.collect())


@pytest.mark.parametrize("n", [1, 250, 10_000])
def test_pool_sample(spark, n):
    frame = hot_articles(spark)
    best = deduped(frame.collect())
    expected = {best[d] for d in sorted(best, key=md5)[:n]}
    assert {tuple(r) for r in feed.pool_sample(frame, n).collect()} == expected


@pytest.mark.parametrize("margin, spare", [(0.3, 0), (1.0, 0), (1.25, 10)])
def test_pool_sample_is_exact_whatever_the_first_guess(spark, monkeypatch, margin, spare):
    monkeypatch.setattr(feed, "_MARGIN", margin)
    monkeypatch.setattr(feed, "_SPARE", spare)
    frame = hot_articles(spark)
    best = deduped(frame.collect())
    expected = {best[d] for d in sorted(best, key=md5)[:60]}
    assert {tuple(r) for r in feed.pool_sample(frame, 60).collect()} == expected


@pytest.mark.parametrize("n", [1, 700, 2500, 9000])
def test_random_extract_keeps_copies(spark, n):
    frame = hot_articles(spark).select("DocumentIdentifier", "date")
    table = sorted((tuple(r) for r in frame.collect()), key=lambda t: (md5(f"{t[0]}|{t[1]}"), t))
    assert Counter(tuple(r) for r in feed.random_extract(frame, n).collect()) == Counter(table[:n])


def test_samples_do_not_depend_on_partitioning(spark, rows):
    frame = hot_articles(spark)
    assert rows(feed.pool_sample(frame, 99)) == rows(feed.pool_sample(frame.repartition(13), 99))
    assert rows(feed.random_extract(frame, 99)) == rows(feed.random_extract(frame.repartition(13), 99))


def even_positions(n, final):
    return [int(i * (n / final)) for i in range(final)] if n > final else list(range(n))


@settings(max_examples=12, deadline=None)
@given(st.integers(1, 400), st.integers(1, 90), st.integers(1, 12))
def test_even_samples(spark, n, final, n_days):
    """A third of the rows fall on one date."""
    frame = spark.range(n).select(
        F.concat(F.lit("d"), "id").alias("DocumentIdentifier"),
        F.date_add(
            F.lit(dt.date(2020, 1, 1)), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % n_days).cast("int")
        ).alias("date"),
    )
    table = [tuple(r) for r in frame.collect()]
    by_key = sorted(table, key=lambda t: (t[1], md5(t[0])))
    expected = sorted(by_key[p] for p in even_positions(n, final))
    assert sorted(tuple(r) for r in feed.even_sample(frame, final).collect()) == expected
    by_name = sorted(table, key=lambda t: (t[1], t[0]))
    numbered = feed.even_pick_join(frame, final, ("date", "DocumentIdentifier")).collect()
    assert sorted(tuple(r) for r in numbered) == sorted(by_name[p] for p in even_positions(n, final))


def test_build_feed(spark):
    rows = [
        (20240103000000, "A.fr", "https://x.fr/one-two-three-four-five", "1.239,2"),
        (20240101000000, None, "https://x.com/this-is-a-longer-headline", ""),
        (20240102000000, "a.fr", "https://x.fr/123", "3"),
        (20240102000000, "a.fr", None, "3"),
        (20240105000000, "b.fr", "https://x.fr/one-two-three-four-five", "9"),
    ]
    raw = spark.createDataFrame(rows, "DATE long, SourceCommonName string, DocumentIdentifier string, V2Tone string")
    assert [tuple(r) for r in jobs.build_feed(raw).collect()] == [
        ("This Is A Longer Headline", "", None, "2024-01-01", None),
        ("One Two Three Four Five", "a.fr", "FRA", "2024-01-03", 1.24),
    ]
    assert jobs.build_feed(raw, final=1).count() == 1


@pytest.mark.parametrize("n", [1, 250, 10_000])
def test_stored_samples_are_the_same(spark, tmp_path, n):
    frame = hot_articles(spark)
    store = SampleStore(spark, str(tmp_path / "store"), frame.schema)
    store.write(frame)
    assert sorted(store.pool(n).collect()) == sorted(feed.pool_sample(frame, n).collect())
    even = feed.even_sample(feed.dedupe_articles(frame), n)
    assert sorted(store.even(n).collect()) == sorted(even.collect())
    empty = SampleStore(spark, str(tmp_path / "none"), frame.schema)
    empty.write(frame.limit(0))
    assert empty.pool(n).collect() == [] and empty.even(n).collect() == []


def test_stored_samples_read_little(spark, tmp_path):
    frame = spark.range(200_000).select(
        F.concat(F.lit("doc"), "id").alias("DocumentIdentifier"), F.lit("s").alias("SourceCommonName"),
        F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("id") % 500).cast("int")).alias("date"), F.col("id").cast("double").alias("tone"),
    )
    store = SampleStore(spark, str(tmp_path / "store"), frame.schema)
    store.write(frame)
    assert store.pool(1000).count() == 1000
    assert rows_read(store.pool(1000)) < 30_000  # a row group, and the counts
    assert rows_read(store.even(3)) < 80_000

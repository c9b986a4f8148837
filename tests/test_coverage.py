import datetime as dt

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from newslens import schemas
from newslens.operators import coverage
from newslens.plans import jobs

RAW = "DATE long, SourceCommonName string, DocumentIdentifier string, V2Tone string"


def day(n):
    return dt.date(2024, 1, n)


def article(n, source, doc, tone):
    return (20240100000000 + n * 1000000 + 93000, source, doc, tone)


def cube_of(spark, rows):
    return jobs.build_coverage(spark.createDataFrame(rows, RAW))


def test_fill(spark, rows):
    cube = cube_of(spark, [
        article(1, "a.fr", "1", "2,0"), article(3, "a.fr", "2", "4,0"), article(3, "a.de", "3", "1,0"),
        article(9, "unknown.com", "4", "7"), article(9, None, "5", "7"), article(9, "abc", "6", "7"),
    ])
    assert rows(cube.select("country_iso3", "date", "avg_tone", "article_count")) == [
        ("DEU", day(1), None, 0), ("DEU", day(2), None, 0), ("DEU", day(3), 1.0, 1),
        ("FRA", day(1), 2.0, 1), ("FRA", day(2), 2.0, 0), ("FRA", day(3), 4.0, 1),
    ]


def test_repeated_and_missing_articles(spark, rows):
    cube = cube_of(spark, [
        article(1, "a.fr", "1", "2"), article(1, "b.fr", "1", "4"),
        article(1, "a.de", None, "1"), article(1, "a.de", None, "3"), article(1, "a.de", "x", "5"),
    ])
    assert rows(cube.select("country_iso3", "avg_tone", "article_count")) == [("DEU", 3.0, 2), ("FRA", 3.0, 1)]


def test_day_without_any_tone_is_filled_but_counted(spark, rows):
    cube = cube_of(spark, [article(1, "a.fr", "1", "2"), article(2, "a.fr", "2", None)])
    assert rows(cube.select("date", "avg_tone", "article_count")) == [(day(1), 2.0, 1), (day(2), 2.0, 1)]


def test_strict_tone(spark):
    with pytest.raises(PySparkException):
        cube_of(spark, [article(1, "a.fr", "1", "")]).collect()


def test_empty_input(spark):
    assert cube_of(spark, []).collect() == []
    assert cube_of(spark, [article(1, "unknown.com", "1", "2")]).collect() == []


observations = st.lists(
    st.tuples(
        st.integers(1, 28), st.sampled_from(["FRA", "DEU", "USA"]), st.one_of(st.none(), st.integers(-5, 5))
    ),
    min_size=1, max_size=25, unique_by=lambda t: t[:2],
)


def by_hand(daily):
    """Spine, join and forward fill in plain Python."""
    seen = {(d, c): t for d, c, t in daily}
    days = range(min(d for d, _, _ in daily), max(d for d, _, _ in daily) + 1)
    out = []
    for country in sorted({c for _, c, _ in daily}):
        last = None
        for d in days:
            tone = seen.get((d, country))
            last = last if tone is None else float(tone)
            out.append((country, day(d), last, int((d, country) in seen)))
    return out


@settings(max_examples=12, deadline=None)
@given(observations)
def test_both_fills_equal_plain_python(spark, rows, daily):
    frame = spark.createDataFrame(
        [(day(d), c, None if t is None else float(t), 1) for d, c, t in daily], schemas.COVERAGE
    )
    columns = ["country_iso3", "date", "avg_tone", "article_count"]
    spine = coverage.date_country_spine(frame)
    stepwise = coverage.forward_fill(coverage.gap_join(spine, frame)).select(*columns)
    at_once = coverage.fill_gaps(frame).select(*columns)
    expected = sorted(by_hand(daily), key=lambda t: [(v is not None, str(v)) for v in t])
    assert rows(stepwise) == expected
    assert rows(at_once) == expected
    # Filling a filled cube changes nothing.
    assert rows(coverage.fill_gaps(at_once).select(*columns)) == expected


def test_counts_survive_the_fill(spark):
    daily = spark.createDataFrame(
        [(day(1), "FRA", 1.0, 3), (day(9), "DEU", 2.0, 4)], schemas.COVERAGE
    )
    profile = coverage.cube_profile(coverage.fill_gaps(daily)).first()
    assert (profile.first_date, profile.last_date, profile.countries) == (day(1), day(9), 2)
    assert profile.total_articles == 7 and profile.total_rows == 18


def test_coverage_spread(spark, rows):
    cube = spark.createDataFrame([
        (day(1), "FRA", 1.0, 1), (day(1), "DEU", None, 0), (day(2), "FRA", 1.0, 1), (day(2), "DEU", 1.0, 2),
        (day(2), "USA", 1.0, 2), (day(3), "ITA", None, 4),
    ], schemas.COVERAGE)
    assert rows(coverage.coverage_spread(cube)) == [(day(1), 1, 1), (day(2), 2, 3)]


def test_distribution_and_volume(spark, rows):
    toned = spark.createDataFrame(
        [("a", -11.0), ("b", -10.0), ("c", 0.0), ("c", 0.5), ("d", 10.0), ("e", None)], "DocumentIdentifier string, tone double"
    )
    bins = coverage.tone_distribution(toned, -10.0, 10.0, 4).select("bin", "records", "bin_low")
    assert rows(bins) == [(0, 1, -15.0), (1, 1, -10.0), (3, 2, 0.0), (5, 1, 10.0)]
    assert coverage.article_volume(toned).first() == (6, 5)


def test_session_time_zone_does_not_move_dates(spark, rows):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Pacific/Auckland")
    try:
        cube = cube_of(spark, [(20240101235959, "a.fr", "1", "2"), (20240102000000, "a.fr", "2", "3")])
        assert [r[0] for r in rows(cube.select(F.col("date").cast("string")))] == ["2024-01-01", "2024-01-02"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)

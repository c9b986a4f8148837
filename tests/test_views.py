import datetime as dt

import pytest

from newslens import schemas
from newslens.plans import views


@pytest.fixture(scope="module")
def cube(spark):
    d = [dt.date(2024, 1, n) for n in (1, 2, 3)]
    return spark.createDataFrame([
        (d[0], "FRA", None, 0), (d[1], "FRA", 1.0, 2), (d[2], "FRA", 1.0, 0),
        (d[0], "DEU", 3.0, 1), (d[1], "DEU", 3.0, 0), (d[2], "DEU", 4.0, 8),
    ], schemas.COVERAGE)


def test_available_dates(cube):
    assert [str(r.date) for r in views.available_dates(cube).collect()] == ["2024-01-01", "2024-01-02", "2024-01-03"]


def test_sentiment_by_date(cube, rows):
    assert rows(views.sentiment_by_date(cube, "2024-01-01")) == [("DEU", 3.0, 1), ("FRA", None, 0)]
    assert views.sentiment_by_date(cube, "2030-01-01").collect() == []
    for bad in ("2024-1-1", "", None, "2024-13-01", "2024-01-01; DROP"):
        with pytest.raises(ValueError):
            views.sentiment_by_date(cube, bad)


def test_country_timeline(cube):
    got = views.country_timeline(cube, "fra").collect()
    assert [(r.date.day, r.avg_tone, r.article_count) for r in got] == [(2, 1.0, 2), (3, 1.0, 0)]
    for bad in ("FR", "FRAN", "F1A", "", None):
        with pytest.raises(ValueError):
            views.country_timeline(cube, bad)


def test_a_country_series_equals_its_days(cube):
    by_day = [
        (d.date, r.avg_tone, r.article_count)
        for d in views.available_dates(cube).collect()
        for r in views.sentiment_by_date(cube, str(d.date)).filter("country_iso3 = 'DEU'").collect()
    ]
    assert by_day == [tuple(r) for r in views.country_timeline(cube, "DEU").collect()]


def test_global_and_era_views(cube):
    assert [(r.date.day, r.avg_tone) for r in views.global_timeline(cube).collect()] == [(1, 3.0), (2, 1.0), (3, 4.0)]
    got = views.era_countries(cube).collect()
    assert [(r.era, r.country_iso3, r.article_count) for r in got] == [(4, "DEU", 9), (4, "FRA", 2)]
